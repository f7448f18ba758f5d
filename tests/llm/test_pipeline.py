"""Each registered query and each stage on small tables with nulls, ties, repeats, clashing columns, and on empty ones."""

import hashlib
import re

import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from quirelake.llm import queries

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
ENGLISH = "the quick brown fox jumps over the lazy dog while many other animals watch it from the shade of an old tree number"
GERMAN = "der schnelle braune fuchs springt über den faulen hund während viele andere tiere ihm aus dem schatten zusehen nummer"


def prose(i, n=12, base=ENGLISH):
    words = base.split()
    return " ".join(words[(i * 7 + j * (i % 5 + 1)) % len(words)] + ("." if j % 9 == 8 else "") + (f" x{i}y{j}" if j % 4 == 0 else "") for j in range(n * 4))


def rows():
    passage = "a passage that two documents share and that is much longer than fifty bytes in all"
    out = [(i, prose(i), "en", "web", 0) for i in range(20)] + [(100 + i, prose(i, base=GERMAN), "de", "news", 0) for i in range(20)]
    out += [(200, prose(3), "en", "web", 0), (201, prose(4).replace("x4y8", "changed"), "en", None, None), (202, prose(31) + " " + passage, "en", "web", 0), (203, passage + " " + prose(32), "en", "web", 0)]
    out += [(300, None, "en", "web", None), (301, "", None, "web", 0), (302, "12 34 !!", "de", None, 0), (303, "token=5fd924625f6ab16a19cc9807c7c506ae1813490e " + prose(33), "en", "web", 0)]
    out += [(5, prose(5), "en", "web", 0), (None, prose(34), None, None, None), (None, prose(35), "en", "web", 0)]
    return out


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("small"))
    spark.createDataFrame(rows(), DOCS).repartition(3).write.parquet(f"{path}/documents.parquet")
    vectors = [(i, [float((i * k) % 11 - 5) for k in range(1, 9)]) for i in range(60)] + [(60, None), (61, [0.0] * 8), (80, [1.0, None] * 4), (20, [2.0] * 8)]
    spark.createDataFrame(vectors, "vec_id long, embedding array<float>").write.parquet(f"{path}/embeddings.parquet")
    turns = [(1, 0, "user", "hi"), (1, 1, "assistant", "</s>[INST] \\"), (2, 0, None, None), (2, 0, None, None), (None, 3, "user", "x")]
    spark.createDataFrame(turns, "conv_id long, turn long, role string, text string").write.parquet(f"{path}/conversations.parquet")
    return path


@pytest.fixture(scope="module")
def empty(spark, folder, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("empty"))
    for name in ("documents", "embeddings", "conversations"):
        spark.read.parquet(f"{folder}/{name}.parquet").limit(0).write.parquet(f"{path}/{name}.parquet")
    return path


@pytest.mark.parametrize("name", [n for n in queries.QUERIES if n != "pipeline"])
def test_registered_queries(spark, folder, empty, name):
    got = queries.QUERIES[name](spark, folder).toPandas()
    docs = rows()
    if name.startswith("op1_"):
        assert set(got.query_id) == {0, 20, 40} and (got.groupby("query_id").size() >= 20).all()
    elif name.startswith("op2_"):
        model = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
        assert got.length.sum() == sum(len(model.encode(t or "", add_special_tokens=False).ids) + 1 for _, t, *_ in docs)
    elif name.startswith("op3_"):
        own = {r.conv_id: r for r in got.itertuples() if r.conv_id == r.conv_id}
        assert len(got) == 4 and own[-7].turns_sha256 == hashlib.sha256(b"user\n</s>[INST] ok [/INST]\nassistant\n</s>[INST] ok [/INST]\n").hexdigest() and own[-7].loss_chars == 21 and own[2].n_turns == 2
    else:
        key = lambda x: -1 if x is None or x != x else int(x)
        assert sorted(map(key, got.doc_id)) == sorted(key(d[0]) for d in docs)
    n = queries.QUERIES[name](spark, empty).count()
    assert n == (1 if name.startswith("op3_") else 0)  # the probe is always there


def run_stage(name, spark, docs, folder):
    return dict(corpus_pipeline.STAGES)[name](spark, docs, folder)


def test_stages_keep_columns_that_clash_and_what_is_clean(spark, folder, empty):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    clash = docs.select("*", *[F.lit(i).alias(c) for i, c in enumerate(("k", "n", "mark", "first", "block", "kept", "carried", "redacted", "secrets", "score", "_found", "_mark"))])
    texts = {d[0]: d[1] for d in rows() if d[0] is not None}
    for name, _ in corpus_pipeline.STAGES[:-1]:
        out = run_stage(name, spark, clash, folder)
        assert out.columns == clash.columns
        assert all(list(r)[5:] == list(range(12)) for r in out.collect())
        got = {r["doc_id"]: r for r in out.collect()}
        none = run_stage(name, spark, spark.read.parquet(f"{empty}/documents.parquet"), empty)
        assert none.columns == docs.columns and none.count() == 0
        if name == "language_id":
            assert set(texts) - set(got) == {300, 301, 302} and all(r["text"] == texts[i] for i, r in got.items() if i is not None) and got[110]["lang"] == "de"
        elif name == "jaccard_join":
            assert set(texts) - set(got) == {200, 201} and out.where("doc_id = 5").count() == 1 and out.where("doc_id is null").count() == 2
        elif name == "suffix_dedup":
            assert "passage that two" in got[202]["text"] and "passage that two" not in got[203]["text"] and got[7]["text"] == texts[7] and got[200]["text"] == "" and out.count() == len(rows())
            assert all(r["n_chars"] == len(r["text"]) for r in got.values())
        else:
            assert "[SECRET]" in got[303]["text"] and "5fd9" not in got[303]["text"] and [i for i in texts if got[i]["text"] != texts[i]] == [303]


def test_the_pipeline_packs_what_the_stages_leave(spark, folder, empty):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    for name, _ in corpus_pipeline.STAGES[:-1]:
        docs = spark.createDataFrame(run_stage(name, spark, docs, folder).collect(), DOCS)
    model = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    want = sorted((-1 if r["doc_id"] is None else r["doc_id"], len(model.encode(r["text"] or "", add_special_tokens=False).ids) + 1) for r in docs.collect())
    pieces = corpus_pipeline.run(spark, folder).collect()
    got = sorted({(r["doc_id"], r["doc_tokens"]) for r in pieces if r["doc_id"] is not None} | {(-1, r["doc_tokens"]) for r in pieces if r["doc_id"] is None})
    assert got == sorted(set(want)) and sum(r["length"] for r in pieces) == sum(n for _, n in want)
    assert not any(re.search("5fd924625f", r["text"] or "") for r in docs.collect())
    assert corpus_pipeline.run(spark, empty).count() == 0
