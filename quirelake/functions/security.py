"""Keys and passwords of the standard security handler, revisions 2 to 4, and RC4 decryption of objects."""

from __future__ import annotations

import hashlib

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from .codecs import rc4

#: Fixed value: the padding of passwords.
PADDING = bytes.fromhex("28bf4e5e4e758a4164004e56fffa01082e2e00b6d0683e802f0ca9fe6453697a")


def padded(password: bytes) -> bytes:
    return (password + PADDING)[:32]


def file_key(password: bytes, owner: bytes, permissions: int, file_id: bytes, revision: int, length: int = 5, metadata: bool = True) -> bytes:
    """Key of ``length`` bytes from the user password."""
    data = padded(password) + owner + (permissions & 0xFFFFFFFF).to_bytes(4, "little") + file_id
    if revision >= 4 and not metadata:
        data += b"\xff\xff\xff\xff"
    key = hashlib.md5(data).digest()
    if revision >= 3:
        for _ in range(50):
            key = hashlib.md5(key[:length]).digest()
    return key[: 5 if revision == 2 else length]


def user_entry(key: bytes, file_id: bytes, revision: int) -> bytes:
    if revision == 2:
        return rc4(key, PADDING)
    value = rc4(key, hashlib.md5(PADDING + file_id).digest())
    for i in range(1, 20):
        value = rc4(bytes(b ^ i for b in key), value)
    return value + bytes(16)


def _owner_key(password: bytes, revision: int, length: int) -> bytes:
    key = hashlib.md5(padded(password)).digest()
    if revision >= 3:
        for _ in range(50):
            key = hashlib.md5(key).digest()
    return key[: 5 if revision == 2 else length]


def owner_entry(owner: bytes, user: bytes, revision: int, length: int = 5) -> bytes:
    key, value = _owner_key(owner, revision, length), padded(user)
    for i in range(20 if revision >= 3 else 1):
        value = rc4(bytes(b ^ i for b in key), value)
    return value


def user_password(owner: bytes, entry: bytes, revision: int, length: int = 5) -> bytes:
    """The padded user password that an owner password opens."""
    key, value = _owner_key(owner, revision, length), entry
    for i in reversed(range(20 if revision >= 3 else 1)):
        value = rc4(bytes(b ^ i for b in key), value)
    return value


def authenticate(password: bytes, entries: dict, file_id: bytes) -> tuple[str, bytes] | None:
    """("user" or "owner", file key) if the password opens a document with these entries (O, U, P, R, Length)."""
    revision, length = entries["R"], entries.get("Length", 40) // 8
    for kind, candidate in (("user", password), ("owner", user_password(password, entries["O"], revision, length))):
        key = file_key(candidate, entries["O"], entries["P"], file_id, revision, length, entries.get("EncryptMetadata", True))
        n = 32 if revision == 2 else 16
        if user_entry(key, file_id, revision)[:n] == entries["U"][:n]:
            return kind, key
    return None


def object_key(key: bytes, num: int, gen: int, aes: bool = False) -> bytes:
    data = key + num.to_bytes(3, "little") + gen.to_bytes(2, "little") + (b"sAlT" if aes else b"")
    return hashlib.md5(data).digest()[: min(16, len(key) + 5)]


def decrypted(data: Column, key: Column, num: Column, gen: Column) -> Column:
    """Bytes of an RC4 stream. AES streams need no Python: ``aes_decrypt(data, object key, 'CBC', 'PKCS')`` reads their layout."""

    @F.pandas_udf("binary")
    def run(rows: pd.Series, keys: pd.Series, nums: pd.Series, gens: pd.Series) -> pd.Series:
        return pd.Series([None if d is None or k is None else rc4(object_key(bytes(k), int(n), int(g)), bytes(d)) for d, k, n, g in zip(rows, keys, nums, gens, strict=True)], dtype=object)

    return run(data, key, num, gen)
