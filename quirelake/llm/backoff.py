"""Stupid-backoff scores from n-gram count tables that are partitioned by hash.

The score of a word is the first of

    count(w1..wn) / count(w1..wn-1),   0.4 * the score by the shorter n-gram,   ...

whose n-gram occurs at least ``MIN_COUNT`` times in the corpus; the shortest is
count(w) / all words. Log scores are summed for each document.

Documents lie in blocks. A block's n-grams are exploded, summed within the block, and
sent to the ranges of their hash, which hold the count tables; a range sums the counts
of all blocks and joins the totals back to each block that asked, and the block sums its
documents' scores. A row of these exchanges is the run of one (block, range): names
sorted and delta-coded with their counts beside them. One row for each n-gram of a document
would need about six times the input on disk. A gram that every document holds comes once
from each block, so no hot word makes a hot task. The texts are shuffled once, by block.

Defined results: null text is empty text; a document without words has 0 words, a total
of 0 and a null mean; words are what blanks separate, in lower case; rows that repeat
count as often as they occur and are scored each; an empty table gives an empty result;
extra columns are ignored.
"""

from __future__ import annotations

import struct

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .suffix_dedup import _pack, _unpack, in_blocks, parts_for, range_bits

ORDER, FACTOR, MIN_COUNT = 2, 0.4, 2
REMEMBERED = 250_000
_known: dict[str, bytes] = {}


def word_names(text: str) -> np.ndarray:
    """64-bit name of each word; those of recent words are remembered."""
    out = []
    for w in text.split():
        h = _known.get(w)
        if h is None:
            h = struct.pack("<Q", xxhash.xxh3_64_intdigest(w.lower()))
            if len(_known) >= REMEMBERED:
                _known.clear()
            _known[w] = h
        out.append(h)
    return np.frombuffer(b"".join(out), np.uint64)


class Grams:
    """The n-grams of one block of documents."""

    def __init__(self, table: pa.Table, order: int):
        self.ids = table.column("doc_id").to_pylist()
        words = [word_names(t.decode("utf-8", "replace")) for t in table.column("text").to_pylist()]
        self.sizes = np.array([len(w) for w in words], np.int64)
        ends = np.cumsum(self.sizes)
        place = np.arange(ends[-1] if len(ends) else 0) - np.repeat(ends - self.sizes, self.sizes)
        names = np.concatenate(words) if words else np.empty(0, np.uint64)
        self.names, self.at = [names], [np.arange(len(names))]
        for n in range(2, order + 1):  # the n-gram that ends at each word which has n - 1 before it
            whole = np.flatnonzero(place >= n - 1)
            longer = np.zeros(len(names), np.uint64)
            longer[self.at[-1]] = self.names[-1]
            h = longer[whole - 1] * np.uint64(0x9E3779B97F4A7C15) + names[whole]
            h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
            self.names.append(h ^ (h >> np.uint64(29)))
            self.at.append(whole)

    def runs(self, block: int, bits: int) -> pa.Table:
        rows = []
        for n, names in enumerate(self.names, 1):
            distinct, times = np.unique(names, return_counts=True)
            which = (distinct >> np.uint64(64 - bits)).astype(np.int64)
            cuts = np.flatnonzero(np.diff(which)) + 1
            for w, d, t in zip(np.split(which, cuts), np.split(distinct, cuts), np.split(times, cuts), strict=True):
                if len(d):
                    rows.append((n, int(w[0]), block, _pack(d), t.astype("<u4").tobytes()))
        columns = list(zip(*rows, strict=True)) or [[]] * 5
        return pa.table([pa.array(c, t) for c, t in zip(columns, (pa.int32(), pa.int32(), pa.int64(), pa.binary(), pa.binary()), strict=True)], names=["n", "range", "block", "names", "counts"])

    def log_scores(self, totals: list[np.ndarray], words: int, min_count: int) -> np.ndarray:
        """Natural log of each word's score; ``totals`` are the corpus counts of each size's grams, in place."""
        score = np.log(totals[0] / max(1, words))
        shorter = totals[0].astype(float)
        for at, counts in zip(self.at[1:], totals[1:], strict=True):
            by_context = np.log(counts / shorter[at - 1])
            score[at] = np.where(counts >= min_count, by_context, score[at] + np.log(FACTOR))
            shorter = np.ones(len(score))
            shorter[at] = counts
        return score


def _summed(table: pa.Table) -> pa.Table:
    """One range of a count table: sum the blocks' counts, then join the totals to each block's names."""
    runs = [_unpack(x) for x in table.column("names").to_pylist()]
    counts = np.concatenate([np.frombuffer(x, "<u4") for x in table.column("counts").to_pylist()])
    _, place = np.unique(np.concatenate(runs), return_inverse=True)
    total = np.bincount(place, weights=counts)[place].astype("<u8")
    parts = [x.tobytes() for x in np.split(total, np.cumsum([len(r) for r in runs])[:-1])]
    return pa.table([table.column("block"), table.column("n"), table.column("range"), pa.array(parts, pa.binary())], names=["block", "n", "range", "totals"])


def score(docs: DataFrame, key: str = "doc_id", text: str = "text", order: int = ORDER, min_count: int = MIN_COUNT) -> DataFrame:
    """One row for each row of ``docs``: doc_id, n_words, log_score (sum), mean_log_score."""
    blocks, total, size = in_blocks(docs, key, text)
    bits = range_bits(total, size)
    runs = blocks.groupBy("block").applyInArrow(lambda g, t: Grams(t, order).runs(g[0].as_py(), bits), "n int, range int, block long, names binary, counts binary")
    tables = runs.repartition(parts_for(docs, total), "n", "range").groupBy("n", "range").applyInArrow(_summed, "block long, n int, range int, totals binary")
    # the first word of a document is scored against all words: a count of one number for the corpus
    words = docs.select(F.size(F.filter(F.split(F.coalesce(F.col(text).cast("string"), F.lit("")), r"[\s\x1c-\x1f\x85\p{Z}]+"), lambda w: w != "")).cast("long").alias("n")).agg(F.sum("n")).head()[0] or 0

    def scored(group, table, answers):
        grams = Grams(table, order)
        rows = sorted(zip(answers.column("n").to_pylist(), answers.column("range").to_pylist(), answers.column("totals").to_pylist(), strict=True))
        totals = []
        for n, names in enumerate(grams.names, 1):
            found = np.frombuffer(b"".join(t for m, _, t in rows if m == n), "<u8")
            totals.append(found[np.unique(names, return_inverse=True)[1]] if len(names) else np.empty(0, np.uint64))
        logs = grams.log_scores(totals, words, min_count)
        ends = np.cumsum(grams.sizes)
        sums = [float(logs[e - s : e].sum()) for e, s in zip(ends, grams.sizes, strict=True)]
        means = [x / n if n else None for x, n in zip(sums, grams.sizes.tolist(), strict=True)]
        return pa.table([pa.array(grams.ids, pa.int64()), pa.array(grams.sizes), pa.array(sums, pa.float64()), pa.array(means, pa.float64())], names=["doc_id", "n_words", "log_score", "mean_log_score"])

    return blocks.groupBy("block").cogroup(tables.groupBy("block")).applyInArrow(scored, "doc_id long, n_words long, log_score double, mean_log_score double")
