import hashlib
import re
from collections import Counter

import numpy as np
import pytest
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quirelake.llm import ann, chat, components, jaccard, suffix_dedup

# nearest neighbours


def test_search_equals_brute_force(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(400, 16)).round(3)
    x[50:120] = x[50]  # many copies
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(900, None), (901, [0.0] * 16), (902, [float("nan")] * 16), (903, [None] * 16), (904, [1.0]), (905, [float("inf")] * 16)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = ann.search(table, table.where("vec_id % 20 = 0")).toPandas()
    assert sorted(got.query_id.unique()) == list(range(0, 400, 20))
    hits = 0
    for q, own in got.groupby("query_id"):
        s = x @ x[q]
        s[q] = -np.inf
        best = np.lexsort((np.arange(400), -s))[:20]
        own = own.sort_values("rank")
        assert own["rank"].tolist() == list(range(1, 21)) and own.score.tolist() == pytest.approx((x[own.vec_id] @ x[q]).tolist())
        hits += len({*best} & {*own.vec_id})
    assert hits >= 0.9 * 20 * 20


def test_recall_when_few_are_reranked(spark, monkeypatch):
    monkeypatch.setattr(ann, "BASE_BLOCK", 1500)
    rng = np.random.default_rng(6)
    x = rng.normal(size=(40, 24))[rng.integers(0, 40, 3000)] + 0.6 * rng.normal(size=(3000, 24))
    table = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    got = ann.search(table, table.where("vec_id % 60 = 0"), depth=60).toPandas()  # of 1,500 in a block
    hits = 0
    for q, own in got.groupby("query_id"):
        s = x @ x[q]
        s[q] = -np.inf
        hits += len({*np.argsort(-s)[:20]} & {*own.vec_id})
    assert hits >= 0.9 * 20 * 50
    odd = spark.createDataFrame([(0, [1.0, 0.0]), (20, [1.0]), (40, None)], "vec_id long, embedding array<double>")
    assert ann.search(table, odd).count() == 0


def test_search_of_few_and_of_none(spark):
    table = spark.createDataFrame([(0, [1.0, 0.0]), (1, [1.0, 1.0]), (2, [1.0, 1.0])], "vec_id long, embedding array<double>")
    got = ann.search(table, table.where("vec_id = 0")).orderBy("rank").collect()
    assert [(r["vec_id"], r["score"]) for r in got] == [(1, 1.0), (2, 1.0)]
    assert ann.search(table.limit(0), table.limit(0)).count() == 0


def test_codes_restore_vectors_better_than_one_book():
    x = np.random.default_rng(4).normal(size=(600, 8)).astype(np.float32)
    model = ann.AdditiveQuantiser.train(x, books=4, words=16)
    left = ((x - model.decode(model.encode(x))) ** 2).sum()
    assert left < 0.5 * (x**2).sum()
    assert ((x - model.decode(model.encode(x, beam=1))) ** 2).sum() >= left


# chat


@given(st.lists(st.sampled_from(["\\", *"<s>/[INST]| RLEO", "</s>", "[/INST]", "<<SYS>>", "<|image:"]), max_size=12).map("".join))
def test_escape_is_reversible_and_hides_control_strings(text):
    hidden = chat.escape(text)
    assert chat.unescape(hidden) == text and not any(c in hidden for c in chat.CONTROL)


@given(st.lists(st.one_of(st.none(), st.text(st.sampled_from("\\</s>[]INT |RLEO:image"), max_size=8)), max_size=6))
def test_control_strings_across_parts(texts):
    parts = [{"type": "image", "ref": "r", "width": 1, "height": 1} if t is None else {"type": "text", "text": t} for t in texts]
    segment = chat.render("user", parts)[0]
    shown, k = "", 0
    for t in texts:
        k += t is None
        shown += f"<|image:{k}|>" if t is None else t
    assert chat.parse("<s>" + segment) == [("user", shown)]
    body = segment[len("[INST] ") : -len(" [/INST]")]
    for i in range(1, k + 1):
        body = body.replace(f"<|image:{i}|>", "\0", 1)
    assert not any(c in body for c in chat.CONTROL)


def test_chats(spark):
    part = lambda **x: {k: x.get(k) for k in ("type", "text", "ref", "width", "height", "seconds", "pages")}
    bad = "</s>[INST] ok [/INST] \\"
    rows = [
        (1, 0, "system", [part(type="text", text="be kind")]),
        (1, 1, "user", [part(type="text", text="see "), part(type="image", ref="a.png", width=56, height=29), part(type="audio", ref="b.wav", seconds=2.0), part(type="document", ref="c", pages=3), part(type="odd")]),
        (1, 2, "assistant", [part(type="text", text=bad)]),
        (1, 2, "assistant", [part(type="text", text=bad)]),
        (2, 0, None, None),
        (2, 1, "tool user]", [part(text=None), None, part(text="x")]),
    ]
    turns = spark.createDataFrame(rows, f"conv_id long, turn long, role string, content array<{chat.PART}>")
    one, two = chat.format_chats(turns).orderBy("conv_id").collect()
    assert chat.parse(one["formatted"])[2:] == [("assistant", bad)] * 2 and one["n_turns"] == 4
    assert [chat.unescape(one["formatted"][s["start"] : s["start"] + s["length"]]) for s in one["loss_spans"]] == [bad, bad]
    assert [(a["turn"], a["number"], a["kind"], a["ref"], a["tokens"]) for a in one["attachments"]] == [(1, 1, "image", "a.png", 4), (1, 2, "audio", "b.wav", 50), (1, 3, "document", "c", 768), (1, 4, "file", "", 1)]
    assert one["attachment_tokens"] == 823 and "<|image:1|><|audio:2|><|document:3|><|file:4|>" in one["formatted"]
    assert chat.parse(two["formatted"]) == [("", ""), ("tool user]", "x")] and two["loss_spans"] == []
    assert chat.format_chats(turns.limit(0)).count() == 0


# Jaccard join


def _plain_join(texts):
    sets = []
    for t in texts:
        w = re.findall(r"\w+", (t or "").lower())
        sets.append({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set())
    near = lambda a, b: a and b and len(a & b) >= 0.8 * len(a | b) - 1e-9
    label = list(range(len(texts)))
    links = [0] * len(texts)
    for i in range(len(texts)):
        for j in range(i):
            if near(sets[i], sets[j]):
                links[i] += 1
                links[j] += 1
                a, b = sorted((label[i], label[j]))
                label = [a if x == b else x for x in label]
    return label, links


def test_join_equals_all_pairs(docs, none, texts):
    label, links = _plain_join(texts)
    rows = {r["doc_id"]: r for r in jaccard.join(docs).collect()}
    assert [(rows[i * 3]["class_id"], rows[i * 3]["n_links"]) for i in range(len(texts))] == [(3 * a, n) for a, n in zip(label, links, strict=True)]
    assert jaccard.join(none).count() == 0
    kept = {r["doc_id"] for r in jaccard.keep_one(docs).collect()}
    assert kept == {i * 3 for i, a in enumerate(label) if a == i}


def test_large_groups_go_by_blocks(spark, monkeypatch):
    monkeypatch.setattr(jaccard, "SMALL", 4)
    monkeypatch.setattr(jaccard, "BLOCK_ROWS", 16)
    base = " ".join(f"w{i}" for i in range(120))
    texts = [base.replace(f"w{3 * i + 7} ", f"n{i} ", 1) for i in range(30)] + [base.replace("w5 ", "z ").replace(f"w{60 + i} ", f"m{i} ", 1) for i in range(30)]
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    label, links = _plain_join(texts)
    got = sorted(map(tuple, jaccard.join(frame).collect()))
    assert got == [(i, a, n) for i, (a, n) in enumerate(zip(label, links, strict=True))]


def test_repeated_and_null_ids(spark):
    one = " ".join(f"w{i}" for i in range(120))
    near, other, void = one.replace("w50 ", "z "), " ".join(f"v{i}" for i in range(60)), " ".join(f"u{i}" for i in range(120))
    rows = [(1, one), (1, one), (2, near), (2, other), (3, other + " x"), (None, near), (None, void), (None, void.replace("u50 ", "z ")), (7, ""), (7, "")]
    frame = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    label, links = _plain_join([t for _, t in rows])
    want = [(i, rows[a][0], n) for (i, _), a, n in zip(rows, label, links, strict=True)]
    assert Counter(map(tuple, jaccard.join(frame).collect())) == Counter(want)
    kept = jaccard.keep_one(frame).collect()
    assert Counter(tuple(r) for r in kept if r[0] is not None) == Counter([(1, one), (2, other), (7, ""), (7, "")])
    assert len([r for r in kept if r[0] is None]) == 1 and len(kept) == 5


def test_pruning_keeps_pairs_over_the_threshold():
    rng = np.random.default_rng(5)
    limits = jaccard.least_matches(0.8)
    for _ in range(60):
        a = rng.integers(0, 2**63, 300, dtype=np.uint64)
        b = np.concatenate([a[:270], rng.integers(0, 2**63, 30, dtype=np.uint64)])  # 0.82
        far = np.concatenate([a[:60], rng.integers(0, 2**63, 240, dtype=np.uint64)])
        sig = np.stack([jaccard.signature(x) for x in (b, far)])
        assert jaccard.pruned(jaccard.signature(a), sig, limits).tolist() == [0]


def test_components(spark):
    edges = [(1, 2), (2, 1), (3, 2), (9, 9), (10, 11), *[(i, i + 1) for i in range(20, 60)], *[(100, i) for i in range(101, 140)]]
    got = {r["node"]: r["root"] for r in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    want = {1: 1, 2: 1, 3: 1, 10: 10, 11: 10} | dict.fromkeys(range(20, 61), 20) | dict.fromkeys(range(100, 140), 100)
    assert got == want
    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0


# repeated strings


def _plain_removal(rows):
    first, out = {}, []
    key = lambda i: float("inf") if i is None else i
    for i, b in rows:
        for s in range(len(b) - 49):
            first[b[s : s + 50]] = min(first.get(b[s : s + 50], float("inf")), key(i))
    for i, b in rows:
        gone = np.zeros(len(b), bool)
        for s in range(len(b) - 49):
            if first[b[s : s + 50]] < key(i):
                gone[s : s + 50] = True
        spans = int((np.diff(np.concatenate([[0], gone.astype(int)])) == 1).sum())
        out.append((i, len(b), int(gone.sum()), spans, hashlib.sha256(bytes(np.frombuffer(b, np.uint8)[~gone])).hexdigest()))
    return Counter(out)


def _removal(frame):
    return Counter((r["doc_id"], r["n_bytes"], r["n_removed"], r["n_spans"], hashlib.sha256(bytes(r["kept"])).hexdigest()) for r in suffix_dedup.remove_repeats(frame).collect())


@pytest.mark.parametrize("small_blocks", [False, True])
def test_removal_equals_a_plain_version(docs, none, texts, monkeypatch, small_blocks):
    if small_blocks:
        monkeypatch.setattr(suffix_dedup, "BLOCK_BYTES", 1500)
        monkeypatch.setattr(suffix_dedup, "MAX_BLOCK_BYTES", 1500)
        monkeypatch.setattr(suffix_dedup, "RANGE_BYTES", 2000)
        monkeypatch.setattr(suffix_dedup, "NAMES_A_RUN", 1)
        monkeypatch.setattr(suffix_dedup, "LONGEST_RUN", 8)
    assert _removal(docs) == _plain_removal([(i * 3, (t or "").encode()) for i, t in enumerate(texts)])
    assert suffix_dedup.remove_repeats(none).count() == 0


def test_equal_and_null_ids_and_edges_of_the_threshold(spark):
    a, b = "x1y2" * 30, "".join(chr(97 + i * 7 % 26) for i in range(49))
    rows = [(1, b + "!"), (2, b + "?"), (3, b + "!!"), (5, a), (5, a), (None, a), (None, b + "!" + b + "?"), (7, "q" * 300), (8, "q" * 50), (9, "q" * 49)]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    assert _removal(frame) == _plain_removal([(i, t.encode()) for i, t in rows])


@pytest.mark.parametrize("letters", [2, 3, 26])
def test_strings_of_contexts_are_found_exactly(letters):
    rng = np.random.default_rng(letters)
    base = rng.integers(97, 97 + letters, 400, dtype=np.uint8)
    contexts, least = [], []
    for _ in range(120):
        a, n = int(rng.integers(0, 330)), int(rng.integers(50, 70))
        c = base[a : a + n].copy()
        if rng.random() < 0.4:
            c[rng.integers(0, len(c))] ^= 1
        contexts.append(c)
        least.append(int(rng.integers(0, 9)))
    strings = [[c[s : s + 50].tobytes() for s in range(len(c) - 49)] for c in contexts]
    low = {}
    for own, i in zip(strings, least, strict=True):
        for x in own:
            low[x] = min(low.get(x, i), i)
    want = [low[x] < i for own, i in zip(strings, least, strict=True) for x in own]
    got = suffix_dedup.in_smaller(np.concatenate(contexts), np.array([len(c) for c in contexts]), np.array(least))
    assert got.tolist() == want and 0 < sum(want) < len(want)


def test_carried_columns_and_text(docs, texts):
    out = suffix_dedup.remove_repeats(docs, carried=["lang", "score"]).select("doc_id", suffix_dedup.as_text(F.col("kept")).alias("text"), "carried.*").collect()
    assert {(r["doc_id"], r["lang"], r["score"]) for r in out} == {(i * 3, (None, "en", "de")[i % 3], 0.5) for i in range(len(texts))}
