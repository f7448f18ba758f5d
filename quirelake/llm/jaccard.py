"""N-gram Jaccard join with Bayesian pruning of candidates.

Texts are sets of hashed shingles of ``WIDTH`` words (runs of word characters, lower
case). Texts with equal sets are one class of copies and are compared once. The steps:

1. Each class has ``HASHES`` min-hash values. Two classes are candidates if they agree
   on one of ``BANDS`` bands of ``ROWS`` values; at a similarity of 0.8 a pair is
   missed with probability (1 - 0.8**5)**30, below 1e-5.
2. Min-hash values are compared ``STEP`` at a time. A pair is dropped once the posterior
   probability (uniform prior) that it reaches the threshold is below ``TOLERANCE``.
3. What is left is verified exactly on the shingle sets.

Buckets of up to ``SMALL`` classes make their pairs in a join. Larger buckets are not
expanded: each member is linked to the least one, linked members form a group, and a
group is cut into blocks of ``BLOCK_ROWS``; each pair of blocks is one task, which compares
values as in step 2 and returns only a spanning forest of its survivors. Groups of
survivors are then cut and verified in the same way, on shingle sets, and each task
returns link counts and a spanning forest. So all pairs are compared, none are
emitted, and no hot bucket or group lies in one task.

Defined results: a text without a word is alone in its class and has no links; one of
fewer than ``WIDTH`` words is a single shingle; null text is empty text; rows that
repeat are copies of each other; ids may repeat, and a row is told apart by its id and
text; a null id comes after all others, so a class has it only if all its ids are null;
a very long text is read whole in the task that holds it; an empty table gives an empty
result; extra columns do not matter.
"""

from __future__ import annotations

import math
import re
import struct

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import fresh, tidy, written
from .components import components

WIDTH, THRESHOLD = 5, 0.8
BANDS, ROWS, STEP = 30, 5, 30
HASHES = BANDS * ROWS
TOLERANCE = 1e-6
SMALL = 24
BLOCK_ROWS = 512
HOT = 1000
REMEMBERED = 250_000
_known: dict[str, bytes] = {}
_word = re.compile(r"\w+").findall
_factors = np.random.default_rng(20).integers(1, 2**63, HASHES, dtype=np.uint64) | np.uint64(1)
_steps = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F)


def word_hashes(text: str) -> np.ndarray:
    """64-bit hash of each word of a whole text; those of strings between blanks are remembered within a task."""
    out = []
    for piece in text.split():
        found = _known.get(piece)
        if found is None:
            words = _word(piece.lower())
            found = struct.pack(f"<{len(words)}Q", *[xxhash.xxh3_64_intdigest(w) for w in words])
            if len(_known) >= REMEMBERED:
                _known.clear()
            _known[piece] = found
        out.append(found)
    return np.frombuffer(b"".join(out), np.uint64)


def shingles(text: str, width: int = WIDTH) -> np.ndarray:
    """Sorted distinct hashes of a text's shingles."""
    words = word_hashes(text)
    if not len(words):
        return words
    n = max(1, len(words) - width + 1)
    h = np.full(n, len(words) if len(words) < width else width, np.uint64)
    for i in range(min(width, len(words))):
        h = (h ^ (h >> np.uint64(32))) * np.uint64(_steps[i % 5]) + words[i : i + n]
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return np.unique(h ^ (h >> np.uint64(32)))


def signature(found: np.ndarray) -> np.ndarray:
    """Min-hash values of a set of shingles."""
    least = np.full(HASHES, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(found), 1024):
        least = np.minimum(least, (found[at : at + 1024, None] * _factors).min(axis=0))
    return (least >> np.uint64(32)).astype(np.uint32)


def least_matches(threshold: float, tolerance: float = TOLERANCE) -> list[tuple[int, int]]:
    """(values compared, fewest agreements to go on): with m of n agreeing and a uniform
    prior, P(similarity >= t) = P(Binomial(n + 1, t) <= m)."""
    out = []
    for n in range(STEP, HASHES + 1, STEP):
        total, m = 0.0, -1
        while total < tolerance:
            m += 1
            total += math.comb(n + 1, m) * threshold**m * (1 - threshold) ** (n + 1 - m)
        out.append((n, m))
    return out


def pruned(one: np.ndarray, others: np.ndarray, limits: list[tuple[int, int]]) -> np.ndarray:
    """Rows of ``others`` that are still possible for ``one`` after all values."""
    left = np.arange(len(others))
    agree, before = np.zeros(len(others), np.int64), 0
    for n, least in limits:
        agree = agree + (others[left, before:n] == one[before:n]).sum(axis=1)
        keep = agree >= least
        left, agree, before = left[keep], agree[keep], n
        if not len(left):
            break
    return left


def _mark(key: str, text: str) -> Column:
    """A hash that rows of equal id and text share."""
    return F.xxhash64(F.col(key).isNull(), F.col(key).cast("long"), F.col(text).cast("string"))


def signed(docs: DataFrame, key: str, text: str, width: int = WIDTH) -> DataFrame:
    """(doc_id, mark, k, n, sig) of each row: class of equal shingle sets (null without a word), its size and min-hashes."""

    def sign(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part, rows = batch.slice(at, 512), []
                for t in part.column(2).to_pylist():
                    found = shingles(t or "", width)
                    rows.append((xxhash.xxh3_64_intdigest(found.tobytes()) - 2**63, len(found), signature(found).tobytes()) if len(found) else (None, 0, None))
                k, n, sig = zip(*rows, strict=True)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(k, pa.int64()), pa.array(n, pa.int64()), pa.array(sig, pa.binary())], names=["doc_id", "mark", "k", "n", "sig"])
        _known.clear()
        tidy()

    return docs.select(F.col(key).cast("long"), _mark(key, text), F.col(text).cast("string")).mapInArrow(sign, "doc_id long, mark long, k long, n long, sig binary")


def _blocks(members: DataFrame, payload: list[str]) -> DataFrame:
    """Members (k, root, ...) of groups, copied to each pair of blocks (root, i, j) of their group and sorted by it."""
    sizes = members.groupBy("root").agg((F.floor((F.count("*") - 1) / BLOCK_ROWS) + 1).cast("int").alias("blocks"))
    rows = members.join(sizes, "root").withColumn("own", F.pmod(F.xxhash64("k"), "blocks").cast("int"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    rows = rows.select("root", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "k", *payload)
    parts = int(members.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return rows.repartition(parts, "root", "i", "j").sortWithinPartitions("root", "i", "j", "k")


def _groups(batches):
    """Tables of the rows of one (root, i, j) each, from sorted batches."""
    held = None
    for batch in batches:
        table = pa.Table.from_batches([batch])
        table = pa.concat_tables([held, table]) if held is not None else table
        if not table.num_rows:
            continue
        keys = np.stack([table.column(c).to_numpy() for c in ("root", "i", "j")])
        cuts = np.flatnonzero((keys[:, 1:] != keys[:, :-1]).any(axis=0)) + 1
        starts = [0, *cuts.tolist()]
        for a, b in zip(starts, starts[1:], strict=False):
            yield table.slice(a, b - a)
        held = table.slice(starts[-1])
    if held is not None and held.num_rows:
        yield held


def _matrix(column, kind) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), kind).reshape(len(column), -1)


class _Forest:
    def __init__(self, n: int):
        self.label = np.arange(n)

    def join(self, one: int, others: np.ndarray) -> None:
        old = np.unique(np.append(self.label[others], self.label[one]))
        if len(old) > 1:
            self.label[np.isin(self.label, old[1:])] = old[0]


def _sets_meet(sets: list[np.ndarray]):
    """A function (row, rows) -> sizes of the intersections of sorted sets."""
    if len(sets) <= 16:
        return lambda i, js: np.array([len(np.intersect1d(sets[i], sets[j], assume_unique=True)) for j in js])
    sizes = np.array([len(s) for s in sets])
    _, place, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    shared = np.cumsum(count > 1) - 1  # a shingle of one set alone meets nothing
    width = int(shared[-1]) + 1
    bits = np.zeros((len(sets), -(-max(1, width) // 64) * 8), np.uint8)
    ends = np.cumsum(sizes)
    for r in range(len(sets)):
        own = place[ends[r] - sizes[r] : ends[r]]
        own = shared[own[count[own] > 1]]
        flags = np.zeros(bits.shape[1] * 8, bool)
        flags[own] = True
        bits[r] = np.packbits(flags)
    words = bits.view(np.uint64)
    return lambda i, js: np.bitwise_count(words[i] & words[js]).sum(axis=1)


def _compare(threshold: float, exact: bool):
    """The task of a pair of blocks. Rows out: k, root of its tree, documents linked (exact only)."""
    limits = least_matches(threshold)

    def task(batches):
        for table in _groups(batches):
            n = table.num_rows
            if n < 2:
                continue
            ks = table.column("k").to_numpy()
            own, i, j = table.column("own").to_numpy(), table.column("i")[0].as_py(), table.column("j")[0].as_py()
            sigs = _matrix(table.column("sig"), np.uint32)
            forest, links = _Forest(n), np.zeros(n, np.int64)
            if exact:
                sets = [np.frombuffer(x, np.uint64) for x in table.column("shingles").to_pylist()]
                sizes, copies, meet = np.array([len(s) for s in sets]), table.column("copies").to_numpy(), _sets_meet(sets)
            left, right = np.flatnonzero(own == i), np.flatnonzero(own == j)
            for a in left:
                others = right if i != j else right[right > a]
                if not len(others):
                    continue
                near = others[pruned(sigs[a], sigs[others], limits)]
                if exact and len(near):
                    both = meet(a, near)
                    sure = both >= threshold * (sizes[a] + sizes[near] - both) - 1e-9
                    near = near[sure]
                    links[a] += copies[near].sum()
                    links[near] += copies[a]
                if len(near):
                    forest.join(a, near)
            trees = np.bincount(forest.label, minlength=n)[forest.label] > 1
            at = np.flatnonzero(trees)
            if len(at):
                yield pa.RecordBatch.from_arrays([pa.array(ks[at]), pa.array(ks[forest.label[at]]), pa.array(links[at])], names=["a", "b", "links"])
        tidy()

    return task


_EDGES = "a long, b long, links long"


def _joined(docs: DataFrame, key: str, text: str, width: int, threshold: float) -> DataFrame:
    """(doc_id, mark, first, n_links) of each row; ``first`` is the first row (void, doc_id, mark) of its connected class."""
    rows = written(signed(docs, key, text, width))
    row = F.struct(F.col("doc_id").isNull().alias("void"), "doc_id", "mark")
    copies = written(rows.where("k is not null").groupBy("k").agg(F.min(row).alias("first"), F.count("*").alias("copies")))
    # rows of a class have equal sizes and values: one of each partition is enough, before any shuffle
    classes = written(rows.where("k is not null").groupBy("k").agg(F.first("n").alias("n"), F.first("sig").alias("sig")))

    bands = F.array(*[F.xxhash64(F.substring("sig", i * ROWS * 4 + 1, ROWS * 4), F.lit(i)) for i in range(BANDS)])
    bands = classes.select("k", "n", F.explode(bands).alias("bucket"))
    met = bands.groupBy("bucket").agg(F.count("*").alias("size"), F.min("k").alias("low")).where("size > 1")
    met = written(bands.join(met, "bucket"))

    small = met.where(F.col("size") <= SMALL).select("bucket", "k", "n")
    pairs = small.alias("x").join(small.alias("y"), (F.col("x.bucket") == F.col("y.bucket")) & (F.col("x.k") < F.col("y.k")) & (F.least("x.n", "y.n") >= threshold * F.greatest("x.n", "y.n") - 1e-9))
    pairs = pairs.select(F.col("x.k").alias("a"), F.col("y.k").alias("b")).distinct()
    pairs = pairs.join(classes.select(F.col("k").alias("a"), F.col("sig").alias("sa")), "a").join(classes.select(F.col("k").alias("b"), F.col("sig").alias("sb")), "b")
    limits = least_matches(threshold)

    def prune(batches):
        for batch in batches:
            if batch.num_rows:
                x, y = _matrix(batch.column("sa"), np.uint32), _matrix(batch.column("sb"), np.uint32)
                left, agree, before = np.arange(len(x)), np.zeros(len(x), np.int64), 0
                for n, least in limits:
                    agree = agree + (x[left, before:n] == y[left, before:n]).sum(axis=1)
                    keep = agree >= least
                    left, agree, before = left[keep], agree[keep], n
                yield batch.select(["a", "b"]).take(pa.array(left))

    edges = pairs.mapInArrow(prune, "a long, b long")

    groups = components(met.where(F.col("size") > SMALL).select(F.col("k").alias("a"), F.col("low").alias("b")))
    hot = groups.join(classes.select("k", "sig"), F.col("node") == F.col("k")).select("k", "root", "sig")
    edges = edges.unionAll(_blocks(hot, ["sig"]).mapInArrow(_compare(threshold, exact=False), _EDGES).select("a", "b"))

    groups = components(edges).join(copies, F.col("node") == F.col("k")).select("k", "root", F.col("first.mark").alias("mark"), "copies")
    # a class is one row here, however often its first row repeats
    chosen = docs.select(_mark(key, text).alias("mark"), F.col(text).cast("string").alias("text")).join(groups, "mark").dropDuplicates(["mark"])

    def shingled(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                found = [shingles(t or "", width) for t in part.column("text").to_pylist()]
                same = [len(f) > 0 and xxhash.xxh3_64_intdigest(f.tobytes()) - 2**63 == k for f, k in zip(found, part.column("k").to_pylist(), strict=True)]
                made = pa.RecordBatch.from_arrays([part.column("k"), part.column("root"), part.column("copies"), pa.array([signature(f).tobytes() if s else b"" for f, s in zip(found, same, strict=True)], pa.binary()), pa.array([f.tobytes() for f in found], pa.binary())], names=["k", "root", "copies", "sig", "shingles"])
                yield made.filter(pa.array(same))  # rows of another text whose mark is the same by chance
        _known.clear()
        tidy()

    chosen = chosen.mapInArrow(shingled, "k long, root long, copies long, sig binary, shingles binary")
    chosen = _blocks(chosen, ["copies", "sig", "shingles"])
    found = written(chosen.mapInArrow(_compare(threshold, exact=True), _EDGES))

    links = found.groupBy("a").agg(F.sum("links").alias("links"))
    roots = components(found.select("a", "b"))
    least = roots.join(copies, F.col("node") == F.col("k")).groupBy("root").agg(F.min("first").alias("least"))
    named = roots.join(least, "root").join(links, F.col("node") == F.col("a"), "left").select("node", "least", "links")
    named = copies.join(named, F.col("k") == F.col("node"), "left").select("k", F.coalesce("least", "first").alias("first"), (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), "copies")
    return _with_class(rows.select("doc_id", "mark", "k"), named).select("doc_id", "mark", "first", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"))


def _with_class(rows: DataFrame, named: DataFrame) -> DataFrame:
    """``rows`` with what their class is named: copies of a large class are not shuffled to one task.

    A class of over a ``HOT``-th of all rows is hot; there are fewer than ``HOT`` of them, which bounds their broadcast.
    """
    named = written(named)
    most = named.agg(F.sum("copies")).head()[0] or 0
    hot = named.where(F.col("copies") > most / HOT)
    marked = rows.join(F.broadcast(hot.select("k", F.lit(True).alias("hot"))), "k", "left")
    rest = marked.where("hot is null").drop("hot").join(named.where(F.col("copies") <= most / HOT), "k", "left")
    return rest.unionByName(rows.join(F.broadcast(hot), "k"))


def join(docs: DataFrame, key: str = "doc_id", text: str = "text", width: int = WIDTH, threshold: float = THRESHOLD) -> DataFrame:
    """One row for each row of ``docs``: doc_id, class_id, n_links.

    ``class_id`` is the least id of the connected class of links, ``n_links`` the number of
    other rows at a similarity of at least ``threshold``.
    """
    return _joined(docs, key, text, width, threshold).select("doc_id", F.coalesce("first.doc_id", "doc_id").alias("class_id"), "n_links")


def keep_one(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` without all but the first row of each class; texts without a word stay."""
    found = _joined(docs, key, text, WIDTH, THRESHOLD).where("first is not null")
    # of each row that is not the first, and of the first if it repeats
    found = found.groupBy("mark").agg(F.first(F.col("mark") != F.col("first.mark")).alias("gone"), F.count("*").alias("times")).where("gone or times > 1")
    mark, gone, at = fresh(docs, "_mark"), fresh(docs, "_gone"), fresh(docs, "_at")
    marked = docs.withColumn(mark, _mark(key, text)).join(found.select(F.col("mark").alias(mark), F.col("gone").alias(gone)), mark, "left")
    left = marked.where(F.col(gone).isNull() | ~F.col(gone))
    order = F.xxhash64(*[F.col(f"`{c}`") for c in docs.columns])
    left = left.withColumn(at, F.row_number().over(Window.partitionBy(mark).orderBy(order)))
    return left.where(F.col(gone).isNull() | (F.col(at) == 1)).select(*[F.col(f"`{c}`") for c in docs.columns])
