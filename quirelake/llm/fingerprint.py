"""Document fingerprints: invertible Bloom lookup sketches of paragraph digests.

A text is cut into pieces at line ends and after sentence ends, whatever the length of a line;
what is still longer than ``LONGEST`` code points is cut into runs of that length. Each
distinct piece has a 64-bit digest. A sketch has three equal tables; a digest goes to one
cell of each, which keeps a count, the xor of the digests and the xor of their checks. Two
sketches of equal size subtract cell by cell, and peeling (take the cells that hold
one digest, remove it from its other cells, table after table) recovers the digests in
which the texts differ. The first sketch of a pair has about the cells that the difference
of their smallest digests suggests. If cells are left over, both texts are sketched again
with three times as many, until they have ``ENOUGH`` times as many as there are digests. Should
even that not come apart, which takes digests that share all their cells, they are compared as sets.

Likeness is the Jaccard index of the two sets of pieces, from 0 to 1.

All of it is DataFrame functions: sketches are higher-order functions within a row,
without a shuffle. ``with_next`` gives each row its neighbour in descending id order by
one shuffle into ranges of ids; the first row of a range is also copied into the range
above it, so no window spans the table and no range waits for another.

Defined results: null text is empty text, whose only piece is the empty string;
rows with equal ids follow each other in order of a hash of the text; a null id sorts
last; a single row is its own neighbour; a very long text is one array of digests in its
row; an empty table gives an empty result; extra columns do not matter.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import empty_text

CELLS = 16  # of a table in the smallest sketch
GROWTH, ENOUGH = 3, 4
SMALLEST, SPARE = 16, 2.0  # digests that a guess looks at; cells for each digest that differs
LONGEST = 400
ROUNDS = 12
ROWS_PER_RANGE = 2000
MAX_RANGES = 10000
CHECK_SALT = 77
ENDS = r"\n|(?<=[.!?]) |(?<=[。！？])"


def paragraphs(text: Column) -> Column:
    """Distinct 64-bit digests of a text's pieces, sorted."""
    runs = lambda x: F.transform(F.sequence(F.lit(1), F.length(x), F.lit(LONGEST)), lambda i: F.substring(x, i, F.lit(LONGEST)))
    pieces = F.transform(F.split(text, ENDS), lambda x: F.when(F.length(x) > LONGEST, F.transform(runs(x), lambda y: F.xxhash64(y))).otherwise(F.array(F.xxhash64(x))))
    return F.sort_array(F.array_distinct(F.flatten(pieces)))


def _check(key: Column) -> Column:
    return F.xxhash64(key, F.lit(CHECK_SALT)).bitwiseAND(F.lit(0xFFFFFFFF))


def _entry(key: Column, count: Column, size: Column) -> Column:
    """A digest with its check and its cell in each table of ``size`` cells."""
    places = [F.pmod(F.xxhash64(key, F.lit(t)), size).cast("int").alias(f"p{t}") for t in range(3)]
    return F.struct(key.alias("x"), count.cast("int").alias("n"), _check(key).alias("c"), *places)


def _bound(value: Column, body) -> Column:
    """``body(value)`` with the value worked out once, not at each place where the body names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _minus(a: Column, b: Column) -> Column:
    return F.struct((a["n"] - b["n"]).alias("n"), a["x"].bitwiseXOR(b["x"]).alias("x"), a["c"].bitwiseXOR(b["c"]).alias("c"))


def _filled(entries: Column, table: int, size: Column) -> Column:
    """The cells of one table. Entries are dealt to groups of cells first, so none is looked at for each cell."""
    zero = F.struct(F.lit(0).alias("n"), F.lit(0).cast("long").alias("x"), F.lit(0).cast("long").alias("c"))
    put = lambda c, e: F.struct((c["n"] + e["n"]).alias("n"), c["x"].bitwiseXOR(e["x"]).alias("x"), c["c"].bitwiseXOR(e["c"]).alias("c"))
    width = F.ceil(F.sqrt(size)).cast("int")

    def group(g: Column, w: Column) -> Column:
        cells = F.sequence(g * w, F.least((g + 1) * w, size) - 1)
        return _bound(F.filter(entries, lambda e: F.floor(e[f"p{table}"] / w) == g), lambda mine: F.transform(cells, lambda i: F.aggregate(F.filter(mine, lambda e: e[f"p{table}"] == i), zero, put)))

    return _bound(width, lambda w: F.flatten(F.transform(F.sequence(F.lit(0), F.ceil(size / w).cast("int") - 1), lambda g: group(g, w))))


def sketch(digests: Column, size: Column) -> Column:
    """A sketch: a struct of three tables of ``size`` cells, each an array of (n, x, c)."""
    entries = F.transform(digests, lambda k: _entry(k, F.lit(1), size))
    return _bound(entries, lambda e: F.struct(*[_filled(e, t, size).alias(f"t{t}") for t in range(3)]))


def subtract(a: Column, b: Column) -> Column:
    return _bound(F.struct(a.alias("a"), b.alias("b")), lambda s: F.struct(*[F.zip_with(s["a"][f"t{t}"], s["b"][f"t{t}"], _minus).alias(f"t{t}") for t in range(3)]))


def peel(tables: Column, size: Column) -> Column:
    """The digests that two subtracted sketches differ in, or null if they don't come apart."""
    start = _bound(tables, lambda s: F.struct(*[s[f"t{i}"].alias(f"t{i}") for i in range(3)], F.array().cast("array<bigint>").alias("found"), F.lit(False).alias("over")))

    def step(state: Column, _: Column) -> Column:
        # the cells that hold one digest, of all tables; a digest may be alone in several
        single = F.filter(F.concat(*[state[f"t{t}"] for t in range(3)]), lambda c: (F.abs(c["n"]) == 1) & (c["c"] == _check(c["x"])))
        keys = lambda cells, n: F.transform(F.array_distinct(F.transform(F.filter(cells, lambda c: c["n"] == n), lambda c: c["x"])), lambda x: _entry(x, F.lit(n), size))
        made = lambda taken: _bound(
            F.concat(keys(taken, 1), keys(taken, -1)),
            lambda out: F.struct(
                *[F.zip_with(state[f"t{t}"], _filled(out, t, size), _minus).alias(f"t{t}") for t in range(3)],
                F.concat(state["found"], F.transform(out, lambda e: e["x"])).alias("found"),
                F.lit(False).alias("over"),
            ),
        )
        none = F.struct(*[state[x].alias(x) for x in ("t0", "t1", "t2", "found")], F.lit(True).alias("over"))
        return F.when(state["over"], state).otherwise(_bound(single, lambda taken: F.when(F.size(taken) == 0, none).otherwise(made(taken))))

    empty = lambda t: F.forall(t, lambda c: (c["n"] == 0) & (c["x"] == 0) & (c["c"] == 0))
    return F.aggregate(F.sequence(F.lit(0), F.lit(ROUNDS)), start, step, lambda s: F.when(empty(s["t0"]) & empty(s["t1"]) & empty(s["t2"]), s["found"]))


def expected_difference(a: Column, b: Column) -> Column:
    """About how many digests are in only one of two sorted arrays, from how many of their smallest are shared."""
    k = F.least(F.lit(SMALLEST), F.size(a), F.size(b))
    both = F.size(F.array_intersect(F.slice(a, F.lit(1), k), F.slice(b, F.lit(1), k)))
    shared = F.when(k == 0, F.lit(0.0)).otherwise(both / (2 * k - both))
    all_ = F.size(a) + F.size(b)
    return F.greatest(all_ * (1 - shared) / (1 + shared), F.abs(F.size(a) - F.size(b)))


def differing(a: Column, b: Column) -> Column:
    """Number of digests in only one of two sorted arrays, by sketches of growing sizes from about the expected one."""
    cells = F.greatest(F.lit(ENOUGH) * (F.size(a) + F.size(b)), F.lit(1))
    start = F.greatest(F.lit(CELLS), F.ceil(expected_difference(a, b) * SPARE / 3)).cast("int")

    def grown(start: Column) -> Column:
        tries = F.sequence(F.lit(0), F.greatest(F.lit(0), F.ceil(F.log(float(GROWTH), cells / (3 * start))).cast("int")))
        size = lambda i: (start * F.pow(F.lit(float(GROWTH)), i)).cast("int")
        attempt = lambda n: F.array_size(peel(subtract(sketch(a, n), sketch(b, n)), n))
        return F.aggregate(tries, F.lit(None).cast("int"), lambda d, i: F.when(d.isNotNull(), d).otherwise(_bound(size(i), attempt)))

    return F.coalesce(_bound(start, grown), F.size(F.array_except(a, b)) + F.size(F.array_except(b, a)))


def likeness(a: Column, b: Column) -> Column:
    """Jaccard index of two arrays of digests, by way of the digests they differ in."""
    all_ = F.size(a) + F.size(b)
    return F.when(all_ == 0, F.lit(1.0)).otherwise(_bound(differing(a, b), lambda d: (all_ - d) / (all_ + d)))


def fingerprint(digests: Column, size: int = CELLS) -> Column:
    """A sketch as text: number of pieces, then the cells."""
    cell = lambda c: F.concat_ws(",", c["n"].cast("string"), F.lower(F.hex(c["x"])), F.lower(F.hex(c["c"])))
    shown = _bound(sketch(digests, F.lit(size)), lambda s: F.concat_ws("|", *[F.concat_ws(";", F.transform(s[f"t{t}"], cell)) for t in range(3)]))
    return F.concat_ws("|", F.size(digests).cast("string"), shown)


def with_next(docs: DataFrame, key: str, carried: list[str]) -> DataFrame:
    """``docs`` with ``next_<c>`` for each carried column: that of the next row in descending order of ``key``."""
    spark = docs.sparkSession
    docs = docs.withColumn("_at", F.coalesce(F.col(key).cast("long"), F.lit(-(2**63))))
    n = docs.count()
    ranges = max(1, min(MAX_RANGES, max(2 * int(spark.conf.get("spark.sql.shuffle.partitions")), -(-n // ROWS_PER_RANGE))))
    bounds = docs.agg(F.percentile_approx("_at", [i / ranges for i in range(1, ranges)], 4 * MAX_RANGES)).head()[0] if ranges > 1 and n else []
    bounds = sorted(set(bounds or []))
    docs = docs.withColumn("_range", F.size(F.filter(F.lit(bounds).cast("array<bigint>"), lambda b: b < F.col("_at"))))
    heads = [(r[0], r[1]) for r in docs.groupBy("_range").agg(F.max("_at")).orderBy(F.desc("_range")).collect()]
    # at most MAX_RANGES + 1 rows: the first row of a range is a guest of the range above, the very first one of the last
    guests = [(at, heads[i - 1][0]) for i, (_, at) in enumerate(heads)]
    guests = spark.createDataFrame(guests, "_at long, _guest int")
    docs = docs.join(F.broadcast(guests), "_at", "left")
    docs = docs.withColumn("_to", F.explode(F.filter(F.array(F.struct(F.col("_range").alias("r"), F.lit(False).alias("g")), F.struct(F.col("_guest").alias("r"), F.lit(True).alias("g"))), lambda s: s["r"].isNotNull())))
    w = Window.partitionBy("_to.r").orderBy("_to.g", F.desc("_at"), F.xxhash64(*carried))
    docs = docs.select("*", *[F.lead(c).over(w).alias(f"next_{c}") for c in carried])
    return docs.where(~F.col("_to.g")).drop("_at", "_range", "_guest", "_to")


def compare_edits(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Fingerprints of each text and of its edit, whose last third is the start of the next text, with both likenesses."""
    rows = docs.select(F.col(key).alias("key"), empty_text(F.col(text)).alias("text"))
    rows = with_next(rows.withColumn("digests", paragraphs(F.col("text"))), "key", ["text", "digests"])
    n = F.length("text")
    cut = F.floor(n / 3).cast("int")
    rows = rows.select("key", "digests", "next_digests", n.cast("long").alias("n_chars"), F.concat(F.substring("text", F.lit(1), n - cut), F.substring("next_text", F.lit(1), cut)).alias("edited"))
    rows = rows.select("*", paragraphs(F.col("edited")).alias("edited_digests"))
    return rows.select(
        F.col("key").alias(key),
        "n_chars",
        F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"),
        fingerprint(F.col("digests")).alias("fingerprint"),
        fingerprint(F.col("edited_digests")).alias("edited_fingerprint"),
        likeness(F.col("digests"), F.col("edited_digests")).alias("near_edited"),
        likeness(F.col("digests"), F.col("next_digests")).alias("near_next"),
    )
