"""Removal of long repeated byte strings across documents, by distributed prefix doubling.

The 50-byte strings that may repeat are ranked by their first 8 bytes, then by pairs of
ranks at offsets 8 and 16, that is by 16 and 32 bytes, and last by a pair at offset 18,
that is by all 50. Strings that a round has shown to be unique leave. Ranks begin with the
bytes themselves and are dense numbers from then on, so no hash decides what is removed.

Before that, what can't repeat is left out, without loss:

* Each 50-byte string has a least hash among its 26 half-strings of 25 bytes: equal strings
  have equal ones. Only these names, about one position in thirteen, are exchanged first; a
  string whose name occurs in one document only can't repeat.
* A text with the digest (128 bits of SHA-256) of a smaller id's text goes as a whole.

Documents lie in blocks, by a hash of id and text. A block sends each distinct name once, as
a sorted, delta-coded run for each range of names. Of the strings left it sends the bytes:
neighbouring strings of one name overlap, so a run of them is one short context, again once
a block, with the least id that holds it. Equal strings have equal names and meet in one
range, where they are ranked; each block is answered with a bit a string (another document,
or a smaller id, has it). So a passage that a third of all documents share is sent once a block.
The texts are shuffled once, by block, and that shuffle serves both rounds and the removal.
Spark partitions and exchanges; pairs of ranks are sorted with numpy within a range, because a
row for each position would take more disk than the input several times over.

Defined results: null text is empty; strings never cross documents and are judged on the
input; among rows with equal ids none is the smaller; a null id is larger than all
others; texts of under 50 bytes are kept whole; rows that repeat are treated each; a very
long text is one run of bytes in the task of its block; an empty table gives an empty result;
columns that are not carried do not matter.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import empty_text, tidied

HALF = 25
THRESHOLD = 2 * HALF
ROUNDS = ((8, 16), (16, 32), (18, THRESHOLD))  # offset of the second rank, bytes that the pair covers
SLICE = 1 << 18
BLOCK_BYTES, MAX_BLOCK_BYTES, MANY_BLOCKS = 4 << 20, 64 << 20, 2000
RANGE_BYTES = 4 << 20  # bytes of text for each range of names
NAMES_A_RUN = 16  # fewer in a run would be more rows than names are worth
SPARE_BITS = 7
SHARES = 8  # bits of a name by which a range is ranked in parts
LONGEST_RUN = 1 << 10
NAMES, TEXTS, STRINGS = 0, 1, 2  # kinds of runs
LAST = np.iinfo(np.int64).max

_table = np.random.default_rng(50).integers(1, 2**63, 256, dtype=np.uint64)
_powers: list[np.ndarray] = []


def _mixed(h: np.ndarray) -> np.ndarray:
    h ^= h >> np.uint64(32)
    h *= np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(29)
    return h


def _power_tables() -> list[np.ndarray]:
    if not _powers:
        n = SLICE + 2 * THRESHOLD
        base = 0x9E3779B97F4A7C15
        for p in (base, pow(base, -1, 2**64)):
            _powers.append(np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(n, p, np.uint64)]), dtype=np.uint64))
    return _powers


def least_halves(data: np.ndarray) -> np.ndarray:
    """For each 50-byte string of ``data``: the least hash of the half-strings inside it."""
    power, inverse = _power_tables()
    n = len(data)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(_table[data] * power[:n], out=sums[1:])
    least = _mixed((sums[HALF:] - sums[:-HALF]) * inverse[: n - HALF + 1])
    for step in (1, 2, 4, 8):  # 2, 4, 8, 16 half-strings
        least = np.minimum(least[:-step], least[step:])
    return np.minimum(least[: len(least) - 10], least[10:])  # 26


def _spread(least: np.ndarray) -> np.ndarray:
    """Names from least hashes, which are mostly small ones: one to one, and spread over all numbers."""
    return _mixed(least * np.uint64(0xC2B2AE3D27D4EB4F))


def _runs_of(values: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """value, value + 1 ... for each value, as many as its size."""
    return np.arange(sizes.sum()) + np.repeat(values - np.cumsum(sizes) + sizes, sizes)


class Block:
    """Documents of one block in order of id, as one run of bytes."""

    def __init__(self, table: pa.Table):
        ids = table.column("doc_id").to_pylist()
        self.null = np.array([x is None for x in ids], bool)
        ids = np.array([LAST if i is None else i for i in ids], np.int64)
        self.order = np.argsort(ids, kind="stable")
        self.ids = ids[self.order]
        raw = table.column("text").to_pylist()
        self.raw = [raw[i] for i in self.order]
        self.bytes = b"".join(self.raw)
        self.data = np.frombuffer(self.bytes, np.uint8)
        self.ends = np.cumsum([len(x) for x in self.raw])

    def slices(self):
        """(first, document, is inside one document, least half) of runs of starts."""
        for a in range(0, len(self.data) - THRESHOLD + 1, SLICE):
            least = least_halves(self.data[a : a + SLICE + THRESHOLD - 1])
            starts = np.arange(a, a + len(least))
            doc = np.searchsorted(self.ends, [a, a + len(least)], side="right")
            ends = self.ends[doc[0] : doc[1] + 1]
            counts = np.diff(np.concatenate([[a], np.minimum(ends, a + len(least))]))
            own = np.repeat(np.arange(doc[0], doc[0] + len(counts)), counts)
            yield a, own, starts + THRESHOLD <= self.ends[own], least

    def text_names(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Distinct digests (two numbers) of the texts that could go; the least id that has each; each text's place among them, or -1."""
        long = [i for i, x in enumerate(self.raw) if len(x) >= THRESHOLD]
        digests = np.frombuffer(b"".join(hashlib.sha256(self.raw[i]).digest()[:16] for i in long), ">u8").reshape(-1, 2).astype(np.uint64)
        order = np.lexsort((digests[:, 1], digests[:, 0]))  # stable, so ids rise among equal ones
        sorted_ = digests[order]
        new = np.concatenate([[True], (sorted_[1:] != sorted_[:-1]).any(axis=1)]) if len(order) else np.empty(0, bool)
        place = np.full(len(self.raw), -1)
        place[np.array(long, np.int64)[order]] = np.cumsum(new) - 1
        return sorted_[new], self.ids[np.array(long, np.int64)[order[new]]], place

    def mark_copies(self, earlier: np.ndarray) -> None:
        """Find the texts that a smaller id has too, by the answers for ``text_names``."""
        _, least, place = self.text_names()
        self.copy = np.zeros(len(self.raw), bool)
        at = np.flatnonzero(place >= 0)
        self.copy[at] = earlier[place[at]] | (least[place[at]] < self.ids[at])

    def half_names(self, shift: int) -> tuple[np.ndarray, np.ndarray]:
        """Sorted shortened names; whether a name is in documents of more than one id here."""
        names, docs = [], []
        for _, own, inside, least in self.slices():
            least, own = least[inside], own[inside]
            if len(least):
                new = np.concatenate([[True], (least[1:] != least[:-1]) | (own[1:] != own[:-1])])
                names.append(_spread(least[new]) >> np.uint64(shift))
                docs.append(self.ids[own[new]])
        if not names:
            return np.empty(0, np.uint64), np.empty(0, bool)
        names, docs = np.concatenate(names), np.concatenate(docs)
        order = np.argsort(names, kind="stable")
        names, docs = names[order], docs[order]
        first = np.flatnonzero(np.concatenate([[True], names[1:] != names[:-1]]))
        return names[first], np.minimum.reduceat(docs, first) != np.maximum.reduceat(docs, first)

    def find_contexts(self, shift: int, flags: np.ndarray) -> None:
        """Runs of neighbouring strings of one name that the first round leaves, and the distinct contexts among them.

        starts, sizes, own: first string, number of strings and document of each run.
        which: the context of each run. names, least, lengths, first: of each context its name,
        the least id that has it, its bytes and the run that it was first seen in.
        """
        names, _ = self.half_names(shift)
        kept, parts = names[flags], []
        for a, own, inside, least in self.slices():
            at = np.flatnonzero(inside & ~self.copy[own])
            if not len(at) or not len(kept):
                continue
            value, doc = least[at], own[at]
            new = np.flatnonzero(np.concatenate([[True], (value[1:] != value[:-1]) | (doc[1:] != doc[:-1]) | (at[1:] != at[:-1] + 1) | (at[1:] % LONGEST_RUN == 0)]))
            name = _spread(value[new])
            short = name >> np.uint64(shift)
            hit = np.flatnonzero(kept[np.minimum(np.searchsorted(kept, short), len(kept) - 1)] == short)
            parts.append((a + at[new[hit]], np.diff(new, append=len(at))[hit], doc[new[hit]], name[hit]))
        if not parts:
            none = np.empty(0, np.int64)
            parts = [(none, none, none, none.astype(np.uint64))]
        self.starts, self.sizes, self.own, name = (np.concatenate(x) for x in zip(*parts, strict=True))
        seen: dict[bytes, int] = {}
        ends = self.starts + self.sizes + THRESHOLD - 1
        self.which = np.array([seen.setdefault(self.bytes[a:b], len(seen)) for a, b in zip(self.starts.tolist(), ends.tolist(), strict=True)], np.int64)
        first = np.unique(self.which, return_index=True)[1]
        order = np.argsort(name[first], kind="stable")
        place = np.empty(len(first), np.int64)
        place[order] = np.arange(len(first))
        self.which, self.first = place[self.which], first[order]
        self.names, self.least = name[self.first], self.ids[self.own[self.first]]
        self.lengths = self.sizes[self.first] + THRESHOLD - 1

    def context_runs(self, block: int, bits: int) -> pa.Table:
        """A row for each range of names: contexts one after the other, and their lengths, shares and least ids."""
        which = (self.names >> np.uint64(64 - bits)).astype(np.int64)
        share = (self.names >> np.uint64(64 - bits - SHARES) & np.uint64((1 << SHARES) - 1)).astype(np.uint8)
        starts = self.starts[self.first]
        cuts = [0, *(np.flatnonzero(np.diff(which)) + 1).tolist(), len(which)]
        rows = []
        for a, b in zip(cuts, cuts[1:], strict=False):
            if a < b:
                found = self.data[_runs_of(starts[a:b], self.lengths[a:b])]
                rows.append((STRINGS, int(which[a]), block, found.tobytes(), self.lengths[a:b].astype("<u2").tobytes() + share[a:b].tobytes() + self.least[a:b].astype("<i8").tobytes()))
        return _run_table(rows)

    def removed(self, earlier: np.ndarray) -> np.ndarray:
        """Whether each byte is covered by a string that a smaller id has, by the answers for the contexts' strings."""
        matched = np.zeros(len(self.data), np.uint8)
        if len(self.starts):
            windows = self.lengths - THRESHOLD + 1
            answer = earlier[_runs_of((np.cumsum(windows) - windows)[self.which], self.sizes)]
            answer |= np.repeat(self.least[self.which] < self.ids[self.own], self.sizes)
            matched[_runs_of(self.starts, self.sizes)] = answer
        sums = np.cumsum(matched, dtype=np.int32)
        covered = sums > 0
        covered[THRESHOLD:] = sums[THRESHOLD:] > sums[:-THRESHOLD]
        return covered


def _pack(names: np.ndarray) -> bytes:
    """Sorted names as differences, byte plane by byte plane, which Spark's codec shrinks."""
    return np.ascontiguousarray(np.diff(names, prepend=np.uint64(0)).view(np.uint8).reshape(-1, 8).T).tobytes()


def _unpack(packed: bytes) -> np.ndarray:
    return np.cumsum(np.ascontiguousarray(np.frombuffer(packed, np.uint8).reshape(8, -1).T).view(np.uint64).ravel(), dtype=np.uint64)


_RUN = "kind int, range int, block long, names binary, flags binary"
_ANSWER = "block long, kind int, range int, n long, flags binary"


def _run_table(rows: list[tuple]) -> pa.Table:
    columns = list(zip(*rows, strict=True)) or [[]] * 5
    return pa.table([pa.array(c, t) for c, t in zip(columns, (pa.int32(), pa.int32(), pa.int64(), pa.binary(), pa.binary()), strict=True)], names=["kind", "range", "block", "names", "flags"])


def _runs(kind: int, block: int, names: np.ndarray, flags, shown, bits: int, width: int) -> pa.Table:
    """One row for each range of names (the ``bits`` first of ``width`` bits) that the block has, with ``shown(flags)``."""
    which = (names >> np.uint64(width - bits)).astype(np.int64)
    cuts = np.flatnonzero(np.diff(which)) + 1
    return _run_table([(kind, int(w[0]), block, _pack(n), shown(f)) for w, n, f in zip(np.split(which, cuts), np.split(names, cuts), np.split(flags, cuts), strict=True) if len(n)])


def _bits(flags: np.ndarray) -> bytes:
    return np.packbits(flags).tobytes()


def _answers(table: pa.Table, kind: int, sizes: np.ndarray, answer: np.ndarray) -> pa.Table:
    found = [_bits(x) for x in np.split(answer, np.cumsum(sizes)[:-1])]
    return pa.table([table.column("block"), pa.array([kind] * len(found), pa.int32()), table.column("range"), pa.array(sizes), pa.array(found, pa.binary())], names=["block", "kind", "range", "n", "flags"])


def _sorted(table: pa.Table) -> pa.Table:
    """Sort what all blocks have sent for one kind and range; answer each block with a bit for each item.

    Names: set where another block has the name, or a block has it in two documents.
    Digests of texts, and strings: set where a smaller id has the same.
    """
    kind = table.column("kind")[0].as_py()
    if kind == STRINGS:
        return _ranked(table)
    runs = [_unpack(x) for x in table.column("names").to_pylist()]
    sizes, extra = np.array([len(r) for r in runs]), table.column("flags").to_pylist()
    names = np.concatenate(runs)
    answer = np.empty(len(names), bool)
    if kind == NAMES:
        order = np.argsort(names, kind="stable")
        own = np.concatenate([np.unpackbits(np.frombuffer(f, np.uint8), count=s).astype(bool) for f, s in zip(extra, sizes, strict=True)])
        first = np.flatnonzero(np.diff(names[order].view(np.int64), prepend=~names[order[0]].view(np.int64)))
        count = np.diff(first, append=len(names))
        answer[order] = np.repeat(np.logical_or.reduceat(own[order], first) | (count > 1), count)
    else:
        pairs = [np.frombuffer(f, "<u8").reshape(-1, 2) for f in extra]
        low, least = np.concatenate([p[:, 0] for p in pairs]), np.concatenate([p[:, 1] for p in pairs]).astype(np.int64)
        order = np.lexsort((low, names))
        first = np.flatnonzero(np.concatenate([[True], (names[order][1:] != names[order][:-1]) | (low[order][1:] != low[order][:-1])]))
        answer[order] = np.repeat(np.minimum.reduceat(least[order], first), np.diff(first, append=len(names))) < least[order]
    return _answers(table, kind, sizes, answer)


def _ranked(table: pa.Table) -> pa.Table:
    """The answers for the strings of one range, ranked share by share of the names."""
    texts, about = table.column("names").to_pylist(), table.column("flags").to_pylist()
    n = [len(f) // 11 for f in about]
    lengths = np.concatenate([np.frombuffer(f, "<u2", k) for f, k in zip(about, n, strict=True)]).astype(np.int64)
    shares = np.concatenate([np.frombuffer(f, np.uint8, k, 2 * k) for f, k in zip(about, n, strict=True)])
    least = np.concatenate([np.frombuffer(f, "<i8", k, 3 * k) for f, k in zip(about, n, strict=True)])
    data = np.frombuffer(b"".join(texts), np.uint8)
    windows = lengths - THRESHOLD + 1
    begins, answers_at = np.cumsum(lengths) - lengths, np.cumsum(windows) - windows
    answer = np.zeros(int(windows.sum()), bool)
    by_share = np.argsort(shares, kind="stable")
    for own in np.split(by_share, np.flatnonzero(np.diff(shares[by_share])) + 1):
        if len(own) > 1:
            answer[_runs_of(answers_at[own], windows[own])] = in_smaller(data[_runs_of(begins[own], lengths[own])], lengths[own], least[own])
    row = np.repeat(np.arange(len(n)), n)
    return _answers(table, STRINGS, np.bincount(row, windows, len(n)).astype(np.int64), answer)


def in_smaller(data: np.ndarray, lengths: np.ndarray, least: np.ndarray) -> np.ndarray:
    """For each 50-byte string inside the contexts of ``data``, in order: does a context with a smaller id hold it?

    Prefix doubling: positions are ranked by 8 bytes, then by pairs of ranks at growing
    offsets; a position that is unique has no further part.
    """
    room = np.repeat(np.cumsum(lengths), lengths) - np.arange(len(data))
    at = np.flatnonzero(room >= 8)
    eight = np.lib.stride_tricks.sliding_window_view(data, 8)[at]
    rank, single, order, first = _ranks(np.ascontiguousarray(eight).view("<u8").ravel(), at, len(data))
    for offset, length in ROUNDS:
        at = np.flatnonzero(room >= length)
        at = at[~(single[at] | single[at + offset])]
        rank, single, order, first = _ranks(rank[at] << np.uint64(32) | rank[at + offset], at, len(data))
    out = np.zeros(len(data), bool)
    if len(order):
        own = np.repeat(least, lengths)[at[order]]
        out[at[order]] = np.repeat(np.minimum.reduceat(own, first), np.diff(first, append=len(order))) < own
    return out[room >= THRESHOLD]


def _ranks(keys: np.ndarray, at: np.ndarray, n: int):
    """Dense ranks of keys, put at their positions; whether a position is the only one of its rank; the keys' order and where ranks begin in it."""
    order = np.argsort(keys)
    keys = keys[order]
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.empty(0, np.int64)
    count = np.diff(first, append=len(keys))
    rank, single = np.zeros(n, np.uint64), np.ones(n, bool)
    rank[at[order]] = np.repeat(np.arange(len(first), dtype=np.uint64), count)
    single[at[order]] = np.repeat(count == 1, count)
    return rank, single, order, first


def _flags(answers: pa.Table, kind: int) -> np.ndarray:
    """A block's answers for one kind, in order of its items."""
    columns = [answers.column(c).to_pylist() for c in ("kind", "range", "n", "flags")]
    rows = sorted(r[1:] for r in zip(*columns, strict=True) if r[0] == kind)
    parts = [np.unpackbits(np.frombuffer(f, np.uint8), count=n) for _, n, f in rows]
    return np.concatenate(parts).astype(bool) if parts else np.empty(0, bool)


def in_blocks(docs: DataFrame, key: str, text: str, carried: list[str] | None = None) -> tuple[DataFrame, int, int]:
    """(block, doc_id, text, and a struct of carried columns) shuffled by block; the bytes of all texts and of a block.

    Blocks follow a hash of id and text, so neither null nor repeated ids crowd one.
    """
    rows = docs.select(F.col(key).cast("long").alias("doc_id"), empty_text(F.col(text)).cast("binary").alias("text"), F.struct(*carried).alias("carried") if carried else F.lit(0).alias("carried"))
    total = rows.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).head()[0]
    size = max(BLOCK_BYTES, min(MAX_BLOCK_BYTES, total // MANY_BLOCKS))
    block = F.pmod(F.xxhash64("doc_id", "text"), F.lit(max(1, -(-total // size))))
    return rows.select(block.alias("block"), "doc_id", "text", *(["carried"] if carried else [])).repartition(parts_for(docs, total), "block"), total, size


def parts_for(docs: DataFrame, total: int) -> int:
    return max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-total // (4 * BLOCK_BYTES)))


def range_bits(total: int, size: int) -> int:
    """Bits of a name that say its range: ranges of ``RANGE_BYTES`` of text, as long as runs keep ``NAMES_A_RUN`` names."""
    return max(1, min(-(-total // RANGE_BYTES), size // (HALF // 2 * NAMES_A_RUN))).bit_length()


def remove_repeats(docs: DataFrame, key: str = "doc_id", text: str = "text", carried: list[str] | None = None, as_text: bool = False) -> DataFrame:
    """One row for each row of ``docs``: doc_id, n_bytes, n_removed, n_spans, kept (binary), and a struct ``carried`` of the columns named.

    With ``as_text``, ``kept`` is a string without the characters that were cut apart.
    """
    blocks, total, size = in_blocks(docs, key, text, carried)
    width = min(64, max(1, total).bit_length() + SPARE_BITS)
    shift = 64 - width
    bits = min(width, range_bits(total, size))
    parts = parts_for(docs, total)

    def first_round(group, table):
        block, number = Block(table), group[0].as_py()
        names, many = block.half_names(shift)
        digests, least, _ = block.text_names()
        about = np.stack([digests[:, 1], least.astype(np.uint64)], axis=1)
        return pa.concat_tables([_runs(NAMES, number, names, many, _bits, bits, width), _runs(TEXTS, number, digests[:, 0], about, lambda x: x.astype("<u8").tobytes(), bits, 64)])

    def strings_left(table, answers):
        block = Block(table)
        block.mark_copies(_flags(answers, TEXTS))
        block.find_contexts(shift, _flags(answers, NAMES))
        return block

    def second_round(group, table, answers):
        return strings_left(table, answers).context_runs(group[0].as_py(), bits) if table.num_rows else _run_table([])

    def answered(runs):
        return runs.repartition(parts, "kind", "range").groupBy("kind", "range").applyInArrow(lambda table: tidied(_sorted, table), _ANSWER)

    first = answered(blocks.groupBy("block").applyInArrow(lambda group, table: tidied(first_round, group, table), _RUN))
    second = answered(blocks.groupBy("block").cogroup(first.groupBy("block")).applyInArrow(lambda group, table, answers: tidied(second_round, group, table, answers), _RUN))

    def remove(group, table, answers):
        block = strings_left(table, answers)
        covered = block.removed(_flags(answers, STRINGS))
        rows, a = [], 0
        for i, b in enumerate(block.ends.tolist()):
            gone = covered[a:b]
            if block.copy[i]:
                gone = np.ones(b - a, bool)
            n = int(gone.sum())
            spans = int(gone[:1].sum() + (gone[1:] & ~gone[:-1]).sum()) if n else 0
            kept = block.raw[i] if not n else block.data[a:b][~gone].tobytes()
            if as_text:
                kept = kept.decode("utf-8", "ignore")
            rows.append((None if block.null[block.order[i]] else int(block.ids[i]), b - a, n, spans, kept))
            a = b
        columns = list(zip(*rows, strict=True)) or [[]] * 5
        out = [pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string() if as_text else pa.binary()), strict=True)]
        if carried:
            out.append(table.column("carried").combine_chunks().take(pa.array(block.order)))
        return pa.table(out, names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept", *(["carried"] if carried else [])])

    schema = T.StructType([T.StructField(c, T.LongType()) for c in ("doc_id", "n_bytes", "n_removed", "n_spans")] + [T.StructField("kept", T.StringType() if as_text else T.BinaryType())])
    if carried:
        schema.add(blocks.schema["carried"])
    return blocks.groupBy("block").cogroup(first.unionAll(second).groupBy("block")).applyInArrow(lambda group, table, answers: tidied(remove, group, table, answers), schema)


def as_text(kept: Column) -> Column:
    """Bytes as text; a character that was cut apart is left out."""

    @F.pandas_udf("string")
    def read(rows: pd.Series) -> pd.Series:
        return pd.Series([None if x is None else x.decode("utf-8", "ignore") for x in rows], dtype=object)

    return read(kept)
