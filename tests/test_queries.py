import glob
import os
import random
import time
from collections import defaultdict

import duckdb
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quirelake.functions import scalars
from quirelake.operators import graph, labels, positional, sets, trees
from quirelake.plans import changes, registry, structure  # noqa: F401

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def duck():
    con = duckdb.connect()
    for f in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return con


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query_equals_its_sql(spark, duck, name):
    got, want = registry.QUERIES[name](spark, SF).toPandas(), duck.execute(registry.ORACLE_SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    rows = lambda df: sorted(repr([None if x is None or x != x else float(x) if isinstance(x, (int, float)) and not isinstance(x, bool) else x for x in r]) for r in df[sorted(df.columns)].astype(object).where(df[sorted(df.columns)].notna(), None).values.tolist())
    assert rows(got) == rows(want)


def plain_range(text, n):
    out = []
    number = lambda t: n if t == "z" else n + 1 - int(t[1:]) if t[0] == "r" else int(t)
    for part in text.split(","):
        part, _, parity = part.partition(":")
        a, _, b = part.partition("-")
        a, b = number(a), number(b or a)
        pages = list(range(a, b + 1)) if a <= b else list(range(a, b - 1, -1))
        out += pages[0::2] if parity == "odd" else pages[1::2] if parity == "even" else pages
    return out


token = st.sampled_from(["1", "2", "3", "z", "r1", "r2", "r3"])
entry = st.builds(lambda a, b, p: a + (f"-{b}" if b else "") + (f":{p}" if p else ""), token, st.none() | token, st.sampled_from([None, "odd", "even"]))


@settings(max_examples=12, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(entry, min_size=1, max_size=3).map(",".join))
def test_ranges_equal_a_plain_version(spark, text):
    rows = positional.resolve_range(spark.createDataFrame([(3,), (8,)], "n long"), text).collect()
    got = defaultdict(list)
    for r in sorted(rows, key=lambda r: r["out_pos"]):
        got[r["n"]].append(r["page"])
    assert {3: got[3], 8: got[8]} == {n: plain_range(text, n) for n in (3, 8)}


def test_range_errors(spark):
    for bad in ("0x", "1--2", "1:both", "r"):
        with pytest.raises(ValueError):
            positional.parse_range(bad)
    with pytest.raises(Exception, match="does not fit"):
        positional.resolve_range(spark.createDataFrame([(2,)], "n long"), "1-3").collect()
    with pytest.raises(ValueError):
        positional.collate(spark.range(1), "id", "id", 0)


def test_split_names(spark):
    rows = positional.split_chunks(spark.createDataFrame([(12,)], "n long"), 1, F.lit("a")).collect()
    assert rows[0]["name"] == "a-01.pdf" and rows[11]["name"] == "a-12.pdf"
    rows = positional.split_chunks(spark.createDataFrame([(5,)], "n long"), 2, F.lit("a")).orderBy("chunk").collect()
    assert [r["name"] for r in rows] == ["a-1-2.pdf", "a-3-4.pdf", "a-5-5.pdf"]


def test_labels(spark):
    v = spark.createDataFrame([(0,), (1,), (4,), (26,), (27,), (53,), (1994,), (100_001,)], "v long")
    got = v.select(labels.to_alpha(F.col("v")).alias("a"), labels.to_roman(F.col("v")).alias("r")).collect()
    assert [r["a"] for r in got[:6]] == ["", "a", "d", "z", "aa", "aaa"] and [r["r"] for r in got] == ["", "i", "iv", "xxvi", "xxvii", "liii", "mcmxciv", ""]
    ranges = spark.createDataFrame([(1, 0, "D", None, 1), (1, 5, "D", None, 6), (1, 8, "D", "", 9), (1, 9, "r", "", 1)], "doc long, start_idx long, style string, prefix string, start long")
    assert [r["start_idx"] for r in labels.merge_adjacent(ranges, "doc").orderBy("start_idx").collect()] == [0, 8, 9]


def equals_its_sql_over(spark, folder, name, table, rows):
    """Whether a query equals its SQL where ``table`` holds ``rows``."""
    rows.coalesce(1).write.mode("overwrite").parquet(f"{folder}/{table}.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{folder}/{table}.parquet/*.parquet'")
    got = registry.QUERIES[name](spark, str(folder))
    want = con.execute(f"SELECT {', '.join(got.columns)} FROM ({registry.ORACLE_SQL[name]})").fetchall()
    return sorted(map(repr, map(tuple, got.collect()))) == sorted(map(repr, want))


@pytest.mark.parametrize("name", ["label_render_alpha", "label_render_roman"])
def test_labels_of_large_and_null_numbers(spark, tmp_path, name):
    rows = spark.createDataFrame([(0,), (1,), (1994,), (100_000,), (100_001,), (1_234_567,), (None,)], "l_partkey long")
    assert equals_its_sql_over(spark, tmp_path, name, "lineitem", rows)


def test_rotation(spark):
    got = spark.createDataFrame([(45,), (44,), (-46,), (-45,), (405,)], "d int").select(scalars.snap_rotation(F.col("d")).alias("r")).collect()
    assert [r["r"] for r in got] == [90, 0, 270, 0, 90]


def test_unique_names(spark):
    names = ["n", "n", "n+1", "n", "m"]
    rows = spark.createDataFrame([(1, i, x) for i, x in enumerate(names)], "doc long, at long, name string")
    got = [r["unique_name"] for r in sets.unique_names(rows, "doc", "at", "name").orderBy("at").collect()]
    assert got == ["n", "n+1", "n+1+1", "n+2", "m"]


def plain_unique_names(rows):
    used, out = set(), {}
    for doc, at, base in sorted(rows, key=lambda r: r[1]):
        candidate, k = base, 0
        while (doc, candidate) in used:
            k += 1
            candidate = f"{base}+{k}"
        used.add((doc, candidate))
        out[at] = candidate
    return out


def test_unique_names_equal_a_plain_version(spark):
    rng = random.Random(4)
    sets_of = [["n", "n+1", "n+2"], ["n", "n+1", "n+1+1", "n+3", "n+2+1", "n+01", "m+1"], ["", "+1", "n+", "n", "n+1", "n+1+1", "n+1+2", "n+1+1+1", "n+4", "n+7", "n+12\n"]]
    rows = [(d, at, rng.choice(sets_of[d % 3])) for at in range(2400) for d in [rng.randrange(12)]]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "doc long, at long, name string").repartition(5)
    got = {r["at"]: r["unique_name"] for r in sets.unique_names(df, "doc", "at", "name").collect()}
    assert got == plain_unique_names(rows)


def test_many_equal_names_are_numbered_in_time(spark):
    rows = spark.range(60_000).select(F.lit(None).cast("long").alias("doc"), "id", F.lit("n").alias("name"))
    start = time.monotonic()
    got = sets.unique_names(rows, "doc", "id", "name").where("unique_name <> if(id = 0, 'n', concat('n+', id))").count()
    assert got == 0 and time.monotonic() - start < 60  # each name once tried all numbers before its own: minutes


def test_unique_field_names_of_nulls(spark, tmp_path):
    rows = spark.createDataFrame([(2, 1), (1, 1), (None, 1), (4, None), (5, None), (6, None)], "c_custkey long, c_nationkey int")
    assert equals_its_sql_over(spark, tmp_path, "unique_field_names", "customer", rows)


def test_closure_of_cycles_and_boundaries(spark):
    edges = spark.createDataFrame([(1, 2), (2, 3), (3, 1), (3, 4), (4, 5)], "src long, dst long")
    seeds = spark.createDataFrame([(1,), (4,)], "seed long")
    got = {(r["seed"], r["node"]) for r in graph.closure(seeds, edges).collect()}
    assert got == {(1, n) for n in range(1, 6)} | {(4, 4), (4, 5)}
    stopped = graph.closure(seeds, edges, spark.createDataFrame([(3,)], "node long")).where("seed = 1").collect()
    assert {r["node"] for r in stopped} == {1, 2, 3}


def test_tree_with_a_cycle(spark):
    rows = [(1, 1, None, 0, "a", "r"), (1, 2, 1, 1, None, None), (1, 3, 2, 0, None, "x"), (1, 8, 9, 0, "q", "q"), (1, 9, 8, 0, "q", "q")]
    nodes = spark.createDataFrame(rows, "doc long, id long, parent long, ordinal long, v string, t string")
    got = {r["id"]: (r["depth"], r["inherited"], r["full_name"]) for r in trees.walk(nodes, "v", "t").collect()}
    assert got == {1: (0, "a", "r"), 2: (1, "a", "r"), 3: (2, "a", "r.x")}


def test_upsert_and_freed(spark):
    old, new = spark.createDataFrame([(1, "a"), (2, "b")], "k long, v string"), spark.createDataFrame([(2, "c"), (3, "d")], "k long, v string")
    assert {tuple(r) for r in sets.upsert(old, new, ["k"]).collect()} == {(1, "a"), (2, "c"), (3, "d")}


def test_replaced_objects_of_numbers_in_use(spark, tmp_path):
    rows = [(1, 1, 10.0), (2, 30, 20.0), (1_000_001, 5, 30.0), (1_000_002, 26, 40.0), (2, 10, 50.0), (2, 30, 60.0), (None, 40, 70.0), (None, 1, 80.0), (3, None, 90.0)]
    parts = spark.createDataFrame(rows, "p_partkey long, p_size int, p_retailprice double")
    assert equals_its_sql_over(spark, tmp_path, "objects_replaced", "part", parts)


def test_upsert_of_null_keys(spark):
    old, new = spark.createDataFrame([(None, "a"), (2, "b")], "k long, v string"), spark.createDataFrame([(None, "c")], "k long, v string")
    assert {tuple(r) for r in sets.upsert(old, new, ["k"]).collect()} == {(None, "c"), (2, "b")}


def test_nulls_empties_and_ties_of_changes(spark):
    pages = spark.createDataFrame([("a", 1, 2, 90), ("a", 2, 2, None)], "doc string, page long, n long, rotate long")
    rotated = positional.rotate_pages(pages, "doc", "1-z", F.lit(180).cast("long")).orderBy("page").collect()
    assert [r["rotate"] for r in rotated] == [180, 180]
    assert positional.rotate_pages(pages.where("false"), "doc", "1", F.lit(0).cast("long")).count() == 0
    assert positional.duplicate_pages(pages, "doc", F.lit(0)).count() == 0
    assert [(r["page"], r["out_pos"]) for r in positional.remove_pages(pages, "doc", "1").collect()] == [(2, 1)]
    keys = spark.createDataFrame([("a", 1, "y"), ("a", 1, "x"), ("a", None, "z")], "doc string, key long, value string")
    found = labels.find(keys.select("doc", "key"), keys, "doc", "key", "value").collect()
    assert sorted(str(r["found_value"]) for r in found) == ["None", "x", "x"]
    new = graph.add_objects(keys.select("key").where("false"), spark.range(3), "key", "id")
    assert sorted(r["key"] for r in new.collect()) == [1, 2, 3]
    shared = spark.createDataFrame([("a", None), ("a", None), ("b", 1), ("b", 1)], "doc string, ref long")
    assert {r["doc"]: r["shared"] for r in graph.shares(shared, "doc").collect()} == {"a": False, "b": True}


def test_decode_levels_and_dictionaries_of_nulls(spark):
    row = spark.range(1).select(
        scalars.decodable(F.lit(None).cast("string")).alias("none"), scalars.decodable(F.lit("Fl")).alias("short"),
        scalars.decoded_at(F.array().cast("array<string>"), "none").alias("plain"), scalars.decoded_at(F.array(F.lit("RunLengthDecode")), "generalized").alias("run"),
        scalars.put(F.create_map(F.lit("b"), F.lit(1), F.lit("a"), F.lit(2)), F.lit("b"), F.lit(None).cast("int")).alias("out"),
        scalars.in_key_order(F.create_map(F.lit("b"), F.lit(1), F.lit("a"), F.lit(2), F.lit("c"), F.lit(None))).alias("order"),
    ).first()
    assert (row["none"], row["short"], row["plain"], row["run"], row["out"]) == (False, False, True, False, {"a": 2})
    assert [tuple(e) for e in row["order"]] == [("a", 2), ("b", 1)]
