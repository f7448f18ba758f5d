"""Queries of page changes, overlays, decode levels, tree lookup and field changes, each with its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from quirelake.functions import scalars as S
from quirelake.operators import forms, graph, labels, positional, sets

from .registry import PAGES, pages, query, read
from .structure import WALKED, _items

# pages


@query(f"""WITH {PAGES} SELECT conv_id, page, CASE WHEN page BETWEEN 1 AND n AND page % 2 = 1 THEN (CASE page % 3 WHEN 0 THEN 0 WHEN 1 THEN 90 ELSE 180 END + 90) % 360 ELSE CASE page % 3 WHEN 0 THEN 0 WHEN 1 THEN 90 ELSE 180 END END::BIGINT AS rotate FROM p""")
def pages_rotated(spark, sf_dir):
    rows = pages(spark, sf_dir).select("conv_id", "page", "n", (F.col("page") % 3 * 90).alias("rotate"))
    return positional.rotate_pages(rows, "conv_id", "1-z:odd", S.compose_rotation(F.col("rotate"), F.lit(90), F.lit(True))).select("conv_id", "page", "rotate")


@query(f"""WITH {PAGES}, t AS (SELECT conv_id, page, unnest(range(page % 3)) AS copy FROM p)
SELECT conv_id, page, copy, row_number() OVER (PARTITION BY conv_id ORDER BY page, copy) AS out_pos FROM t""")
def pages_duplicated(spark, sf_dir):
    return positional.duplicate_pages(pages(spark, sf_dir).select("conv_id", "page"), "conv_id", F.col("page") % 3)


@query("""WITH b AS (SELECT p_partkey, p_size % 4 * 90 AS r, p_size::DOUBLE AS a, 10.0::DOUBLE AS b, p_size + 200.0::DOUBLE AS c, 310.0::DOUBLE AS d FROM part)
SELECT p_partkey, CASE r WHEN 90 THEN b WHEN 270 THEN b ELSE a END AS llx, CASE r WHEN 90 THEN a WHEN 270 THEN a ELSE b END AS lly,
CASE r WHEN 90 THEN d WHEN 270 THEN d ELSE c END AS urx, CASE r WHEN 90 THEN c WHEN 270 THEN c ELSE d END AS ury FROM b""")
def rotation_flattened(spark, sf_dir):
    size = F.col("p_size").cast("double")
    box = [size, F.lit(10.0), size + 200, F.lit(310.0)]
    moved = S.transform_rectangle(S.rotation_matrix(F.col("p_size") % 4 * 90, *box), *box)
    return read(spark, sf_dir, "part").select("p_partkey", *[c.alias(n) for c, n in zip(moved, ("llx", "lly", "urx", "ury"))])


@query("""SELECT event_id, user_id AS page, event_type AS kind, row_number() OVER (PARTITION BY user_id ORDER BY CASE event_type WHEN 'underlay' THEN 0 ELSE 1 END, event_id) AS place
FROM (SELECT event_id, user_id, CASE event_type WHEN 'click' THEN 'underlay' ELSE 'overlay' END AS event_type FROM events)""")
def overlays_ordered(spark, sf_dir):
    kind = F.when(F.col("event_type") == "click", "underlay").otherwise("overlay")
    return positional.order_overlays(read(spark, sf_dir, "events").select("event_id", F.col("user_id").alias("page"), kind.alias("kind")), "page", "kind", "event_id")


# streams


@query("""SELECT p_partkey, p_size % 7 < 6 AS decodable, p_size % 7 < 4 AND p_size % 3 < 1 AS generalized, p_size % 7 < 5 AND p_size % 3 < 2 AS specialized, p_size % 7 < 6 AS "all" FROM part""")
def decode_levels(spark, sf_dir):
    size = F.col("p_size")
    first = F.element_at(F.array(*[F.lit(x) for x in (*S.DECODED_FROM, "JPXDecode")]), (size % 7 + 1).cast("int"))
    second = F.element_at(F.array(*[F.lit(x) for x in ("FlateDecode", "RunLengthDecode", "DCTDecode")]), (size % 3 + 1).cast("int"))
    return read(spark, sf_dir, "part").select("p_partkey", S.decodable(first).alias("decodable"), *[S.decoded_at(F.array(first, second), x).alias(x) for x in S.LEVELS[1:]])


@query("SELECT doc_id, md5(md5(text) || ' mark ' || coalesce(lang, '')) AS identifier FROM documents WHERE text IS NOT NULL")
def file_identifiers(spark, sf_dir):
    rows = read(spark, sf_dir, "documents").where("text is not null")
    return rows.select("doc_id", S.file_identifier(F.col("text").cast("binary"), " mark ", F.concat(F.coalesce("lang", F.lit("")), F.lit("\0after"))).alias("identifier"))


# trees and maps of users


@query("SELECT o_custkey AS doc, count(*) AS n_keys, min(o_orderkey) AS smallest, max(o_orderkey) AS largest FROM orders GROUP BY 1")
def tree_bounds(spark, sf_dir):
    return labels.key_bounds(read(spark, sf_dir, "orders").select(F.col("o_custkey").alias("doc"), F.col("o_orderkey").alias("key")), "doc", "key")


@query("""SELECT l_orderkey, l_linenumber, v AS found_value FROM lineitem LEFT JOIN (SELECT o_orderkey % 50 AS doc, o_orderkey AS key, min(o_totalprice) AS v FROM orders WHERE o_orderkey % 3 > 0 GROUP BY 1, 2)
ON doc = l_orderkey % 50 AND key = l_orderkey""")
def tree_find_exact(spark, sf_dir):
    keys = read(spark, sf_dir, "orders").where("o_orderkey % 3 > 0").select((F.col("o_orderkey") % 50).alias("doc"), F.col("o_orderkey").alias("key"), "o_totalprice")
    probes = read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", (F.col("l_orderkey") % 50).alias("doc"), F.col("l_orderkey").alias("key"))
    return labels.find(probes, keys, "doc", "key", "o_totalprice").select("l_orderkey", "l_linenumber", "found_value")


@query("""SELECT l_partkey // 50 + 1000000 AS container, count(DISTINCT l_suppkey) AS n_users, min(l_suppkey) AS first_user, max(l_suppkey) AS last_user FROM lineitem WHERE l_partkey % 3 = 0 GROUP BY 1""")
def users_of_members(spark, sf_dir):
    users = read(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("node"), F.col("l_suppkey").alias("user"))
    inside = users.where("node % 3 = 0").select("node").distinct().withColumn("container", F.floor(F.col("node") / 50) + 1000000)
    return graph.users_of_members(users, inside)


@query("""SELECT c_custkey AS key, c_acctbal AS dest FROM customer WHERE c_custkey % 4 > 1 UNION ALL SELECT s_suppkey, s_acctbal FROM supplier WHERE s_suppkey % 4 = 1""")
def destinations_edited(spark, sf_dir):
    old = read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("key"), F.col("c_acctbal").alias("dest"))
    new = read(spark, sf_dir, "supplier").where("s_suppkey % 4 = 1").select(F.col("s_suppkey").alias("key"), F.col("s_acctbal").alias("dest"))
    return sets.upsert(sets.delete(old, old.where("key % 4 < 2").select("key"), ["key"]), new, ["key"])


# fields


@query(f"WITH RECURSIVE {WALKED} SELECT doc, id, kind, CASE WHEN kind = 'signature' THEN NULL ELSE value END AS value FROM i")
def signature_values_stripped(spark, sf_dir):
    return forms.strip_signatures(forms.field_infos(_items(spark, sf_dir))).select("doc", "id", "kind", "value")


@query(f"WITH RECURSIVE {WALKED} SELECT doc, id, CASE WHEN id % 7 = 0 THEN 'new' || id ELSE name END AS name FROM f")
def fields_renamed(spark, sf_dir):
    rows = _items(spark, sf_dir).select("doc", "id", "name")
    return forms.rename(rows, rows.where("id % 7 = 0").select("doc", "id", F.concat(F.lit("new"), "id").alias("new_name")))


@query("""SELECT c_custkey, sum(CASE WHEN ascii(ch) % 5 > 0 THEN 250 + ascii(ch) END) * 12 / 1000 AS width FROM (SELECT c_custkey, unnest(string_split(c_name, '')) AS ch FROM customer) GROUP BY 1""")
def text_widths(spark, sf_dir):
    widths = spark.range(256).where("id % 5 > 0").select(F.col("id").cast("int").alias("code"), (F.col("id") + 250).alias("width"))
    return forms.text_width(read(spark, sf_dir, "customer").select("c_custkey", "c_name", F.lit(12).alias("size")), widths, ["c_custkey"], "c_name", "size")


@query("""SELECT l_orderkey, l_linenumber, 2 * l_quantity + 5 AS llx, 3 * l_linenumber::DOUBLE AS lly, 2 * (l_quantity + 10) + 5 AS urx, 3 * (l_linenumber + 4.0::DOUBLE) AS ury, l_suppkey + 100 AS page
FROM lineitem WHERE l_suppkey % 3 = 0""")
def annotations_copied(spark, sf_dir):
    rows = read(spark, sf_dir, "lineitem")
    x, y = F.col("l_quantity"), F.col("l_linenumber").cast("double")
    annotations = rows.select(F.col("l_suppkey").alias("page"), F.struct("l_orderkey", "l_linenumber").alias("annotation"), x.alias("llx"), y.alias("lly"), (x + 10).alias("urx"), (y + 4).alias("ury"))
    pairs = read(spark, sf_dir, "supplier").where("s_suppkey % 3 = 0").select(F.col("s_suppkey").alias("from_page"), (F.col("s_suppkey") + 100).alias("to_page"))
    copied = forms.copy_annotations(annotations, pairs, [F.lit(float(v)) for v in (2, 0, 0, 3, 5, 0)])
    return copied.select("annotation.*", "llx", "lly", "urx", "ury", "page")


# objects


@query(f"WITH {PAGES} SELECT conv_id, page, row_number() OVER (PARTITION BY conv_id ORDER BY page) AS out_pos FROM p WHERE page <> 1 AND page <> n")
def pages_removed(spark, sf_dir):
    return positional.remove_pages(pages(spark, sf_dir).select("conv_id", "page", "n"), "conv_id", "1,z").select("conv_id", "page", "out_pos")


@query("SELECT c_custkey, (SELECT max(o_orderkey) FROM orders) + row_number() OVER (ORDER BY c_custkey) AS num FROM customer")
def objects_added(spark, sf_dir):
    return graph.add_objects(read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("num")), read(spark, sf_dir, "customer").select("c_custkey"), "num", "c_custkey")


KINDS = ("stream", "signature", "encrypt", "dictionary", "array", "string", "stream")


@query("""WITH o AS (SELECT DISTINCT l_partkey AS num, CASE WHEN l_orderkey % 40 = 0 THEN 1 ELSE 0 END::BIGINT AS gen, ['stream', 'signature', 'encrypt', 'dictionary', 'array', 'string', 'stream'][(l_partkey % 7 + 1)::INT] AS kind FROM lineitem)
SELECT num, gen, kind FROM o WHERE gen = 0 AND kind IN ('dictionary', 'array', 'string') AND NOT EXISTS (SELECT 1 FROM o x WHERE x.num = o.num AND x.gen > 0)""")
def objects_compressible(spark, sf_dir):
    kind = F.element_at(F.array(*[F.lit(k) for k in KINDS]), (F.col("l_partkey") % 7 + 1).cast("int"))
    rows = read(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("num"), F.when(F.col("l_orderkey") % 40 == 0, 1).otherwise(0).cast("long").alias("gen"), kind.alias("kind")).distinct()
    return graph.compressible(rows)


@query("""SELECT doc, max(n) > 1 AS shared FROM (SELECT l_orderkey AS doc, ref, count(ref) AS n FROM (SELECT l_orderkey, CASE WHEN l_partkey % 4 > 0 THEN l_suppkey END AS ref FROM lineitem) GROUP BY 1, 2) GROUP BY 1""")
def resources_shared(spark, sf_dir):
    return graph.shares(read(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("doc"), F.when(F.col("l_partkey") % 4 > 0, F.col("l_suppkey")).alias("ref")), "doc")


@query("""SELECT p_partkey, 'Brand=' || p_brand || CASE WHEN p_size % 3 > 0 THEN ';Size=' || CASE WHEN p_size % 3 = 1 THEN 'new' ELSE p_size::VARCHAR END ELSE '' END || ';Type=' || p_type AS entries FROM part""")
def dictionary_changed(spark, sf_dir):
    size = F.col("p_size")
    entries = F.create_map(F.lit("Type"), F.col("p_type"), F.lit("Size"), size.cast("string"), F.lit("Brand"), F.col("p_brand"))
    changed = S.put(entries, F.lit("Size"), F.when(size % 3 == 1, "new").when(size % 3 == 2, size.cast("string")))
    return read(spark, sf_dir, "part").select("p_partkey", F.array_join(F.transform(S.in_key_order(changed), lambda e: F.concat(e["key"], F.lit("="), e["value"])), ";").alias("entries"))


@query("""SELECT p_partkey, CASE WHEN p_size % 7 IN (1, 2, 3) THEN 'RC4' WHEN p_size % 7 IN (4, 5) THEN CASE p_partkey % 4 WHEN 0 THEN 'RC4' WHEN 1 THEN 'AES-128' WHEN 2 THEN 'AES-256' ELSE 'none' END END AS cipher FROM part""")
def ciphers(spark, sf_dir):
    k = F.col("p_partkey") % 4
    method = F.when(k == 0, "V2").when(k == 1, "AESV2").when(k == 2, "AESV3")
    return read(spark, sf_dir, "part").select("p_partkey", S.cipher(F.col("p_size") % 7, method).alias("cipher"))
