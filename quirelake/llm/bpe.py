"""Byte-level BPE encoding and decoding with a two-tier lookup.

Tier one: a minimal perfect hash over the vocabulary resolves a pre-token that is a
vocabulary entry as a whole. Tier two: other pre-tokens are merged with a heap of
(rank, position) over linked bytes, lowest rank first and leftmost among equals; the
ranks of merges are a plain table.
A text is cut before every blank that follows a non-blank, which always is a
boundary of pre-tokens, and the ids of recent pieces and
pre-tokens are remembered in bounded tables, so that frequent words cost one lookup.

The work is one narrow pass over whole texts (no shuffle). The vocabulary has a
fixed size (its bytes are checked against ``MAX_VOCABULARY_BYTES``) and travels as a
broadcast. Defined results: null and empty text have no ids, and the digests of
nothing; repeated rows give repeated results; other columns are kept and clashing
output names get a suffix.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
import re
import struct

import numpy as np
import pandas as pd
import regex
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import fresh

MAX_VOCABULARY_BYTES = 64 << 20
REMEMBERED = 250_000
REMEMBERED_TOKENS = 400_000


def read_ranks(path: str) -> dict[bytes, int]:
    """Ranks of a vocabulary file with a base64 token and its rank in each line."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


def _slot(h: int, shift: int, size: int) -> int:
    x = ((h ^ (shift * 0x9E3779B97F4A7C15)) * 0xBF58476D1CE4E5B9) & 0xFFFFFFFFFFFFFFFF
    return (x ^ (x >> 29)) % size


class PerfectHash:
    """Minimal perfect hash of byte strings: buckets with a displacement, single keys with their slot itself."""

    def __init__(self, keys: list[bytes]):
        n = max(1, len(keys))
        self.size, self.buckets = n, max(1, n // 3)
        hashes = [xxhash.xxh3_64_intdigest(k) for k in keys]
        groups: dict[int, list[int]] = {}
        for i, h in enumerate(hashes):
            groups.setdefault(h % self.buckets, []).append(i)
        self.shift = [0] * self.buckets
        slots: list[int] = [-1] * n
        for b, members in sorted(groups.items(), key=lambda x: -len(x[1])):
            if len(members) == 1:
                break
            d = 0
            while True:
                at = [_slot(hashes[i], d, n) for i in members]
                if len(set(at)) == len(at) and all(slots[x] < 0 for x in at):
                    break
                d += 1
            self.shift[b] = d
            for i, x in zip(members, at, strict=True):
                slots[x] = i
        free = iter([x for x in range(n) if slots[x] < 0])
        for b, members in groups.items():
            if len(members) == 1:
                x = next(free)
                slots[x] = members[0]
                self.shift[b] = -1 - x
        self.slots = slots

    def slot(self, key: bytes) -> int:
        h = xxhash.xxh3_64_intdigest(key)
        d = self.shift[h % self.buckets]
        return -1 - d if d < 0 else _slot(h, d, self.size)


class Vocabulary:
    """Ranks behind a perfect hash, with the pattern that makes pre-tokens."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        if sum(map(len, ranks)) + 64 * len(ranks) > MAX_VOCABULARY_BYTES:
            raise ValueError("the vocabulary is too large to be broadcast")
        keys = list(ranks)
        self.hash = PerfectHash(keys)
        self.keys = [keys[i] if i >= 0 else None for i in self.hash.slots]
        self.ids = [ranks[k] if k is not None else -1 for k in self.keys]
        self.pattern = pattern
        self.prepared = False

    def __getstate__(self):
        return {k: v for k, v in self.__dict__.items() if k in ("hash", "keys", "ids", "pattern")} | {"prepared": False}

    def prepare(self) -> None:
        if not self.prepared:
            self.split = regex.compile(self.pattern).findall
            self.blank_run = re.compile(r"\s |^ ").search
            self.of_id = dict(zip(self.ids, self.keys, strict=True))
            self.merge_rank = {k: i for i, k in self.of_id.items()}.get
            self.byte_rank = [self.merge_rank(bytes([b]), -1) for b in range(256)]
            self.met: dict[str, bytes] = {}
            self.known: dict[str, bytes] = {}
            self.prepared = True

    def rank(self, token: bytes) -> int | None:
        s = self.hash.slot(token)
        return self.ids[s] if self.keys[s] == token else None

    def merged(self, token: bytes) -> list[int]:
        """Ids of a pre-token that is no entry: merge pairs from a heap over doubly linked parts.

        A heap entry is ``rank << bits | position``; it is stale once the pair at that
        position has another rank. The id of a merged pair is its rank.
        """
        n = len(token)
        bits = n.bit_length()
        low = (1 << bits) - 1
        get, pop, push = self.merge_rank, heapq.heappop, heapq.heappush
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        part = [self.byte_rank[b] for b in token]
        pair = [get(token[i : i + 2], -1) for i in range(n - 1)]
        pair.append(-1)
        heap = [r << bits | i for i, r in enumerate(pair) if r >= 0]
        heapq.heapify(heap)
        while heap:
            top = pop(heap)
            i = top & low
            if pair[i] != top >> bits:
                continue
            j = after[i]
            end = after[j]
            part[i] = top >> bits
            after[i] = end
            pair[j] = -1
            r = -1
            if end < n:
                before[end] = i
                r = get(token[i : after[end]], -1)
                if r >= 0:
                    push(heap, r << bits | i)
            pair[i] = r
            p = before[i]
            if p >= 0:
                pair[p] = r = get(token[p:end], -1)
                if r >= 0:
                    push(heap, r << bits | p)
        out, i = [], 0
        while i < n:
            out.append(part[i])
            i = after[i]
        return out

    def piece(self, text: str) -> bytes:
        """Ids of one piece as little-endian unsigned 32-bit integers."""
        out, met = [], self.met
        for token in self.split(text):
            ids = met.get(token)
            if ids is None:
                raw = token.encode()
                r = self.rank(raw)
                found = [r] if r is not None else self.merged(raw)
                ids = struct.pack(f"<{len(found)}I", *found)
                if len(token) <= 64:
                    if len(met) >= REMEMBERED_TOKENS:
                        met.clear()
                    met[token] = ids
            out.append(ids)
        return b"".join(out)

    def encode(self, text: str) -> bytes:
        """Ids of a whole text, packed as in ``piece``."""
        self.prepare()
        if not text:
            return b""
        if self.blank_run(text):
            pieces = re.split(r"(?<=\S)(?= )", text)
        else:
            first, *rest = text.split(" ")
            pieces = [first, *[" " + x for x in rest]]
        known = self.known
        try:
            return b"".join([known[p] for p in pieces])
        except KeyError:
            pass
        out = []
        for p in pieces:
            ids = known.get(p)
            if ids is None:
                ids = self.piece(p)
                if len(p) <= 64:
                    if len(known) >= REMEMBERED:
                        known.clear()
                    known[p] = ids
            out.append(ids)
        return b"".join(out)

    def decode(self, ids: bytes) -> bytes:
        self.prepare()
        return b"".join(map(self.of_id.__getitem__, np.frombuffer(ids, "<u4").tolist()))


def with_ids(docs: DataFrame, vocabulary: Vocabulary, text: str = "text") -> DataFrame:
    """``docs`` with ``ids``: the array of token ids of each whole text."""
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)

    @F.pandas_udf("array<int>")
    def ids(texts: pd.Series) -> pd.Series:
        v = shared.value
        return pd.Series([np.frombuffer(v.encode(x or ""), "<u4").astype(np.int32) for x in texts], dtype=object)

    return docs.withColumn(fresh(docs, "ids"), ids(F.col(text)))


def decoded(ids: Column, vocabulary: Vocabulary, spark) -> Column:
    """Bytes of an array of token ids; null gives null."""
    shared = spark.sparkContext.broadcast(vocabulary)

    @F.pandas_udf("binary")
    def text(rows: pd.Series) -> pd.Series:
        return pd.Series([None if x is None else shared.value.decode(np.asarray(x, "<u4").tobytes()) for x in rows], dtype=object)

    return text(ids)


def round_trip(docs: DataFrame, vocabulary: Vocabulary, text: str = "text") -> DataFrame:
    """``docs`` with ``n_tokens``, ``ids_sha256`` and, decoded from those ids, ``decoded_sha256``."""
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)

    @F.pandas_udf("n_tokens long, ids_sha256 string, decoded_sha256 string")
    def digests(texts: pd.Series) -> pd.DataFrame:
        v, rows = shared.value, []
        for x in texts:
            ids = v.encode(x or "")
            rows.append((len(ids) // 4, hashlib.sha256(ids).hexdigest(), hashlib.sha256(v.decode(ids)).hexdigest()))
        return pd.DataFrame(rows, columns=["n_tokens", "ids_sha256", "decoded_sha256"])

    made = fresh(docs, "_bpe")
    out = docs.withColumn(made, digests(F.col(text)))
    return out.select(*[F.col(f"`{c}`") for c in docs.columns], *[F.col(made)[c].alias(fresh(docs, c)) for c in ("n_tokens", "ids_sha256", "decoded_sha256")])
