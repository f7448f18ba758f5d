"""Secret scans: a random forest decides which candidate strings are secrets.

Candidates are runs of key characters that hold a digit, stand behind an assignment or
are very long, and behind an assignment to a secret word the whole value, of any
characters: what its quotes enclose, or else all up to a blank. The forest removes false positives by length, character transitions,
dictionary coverage, path and neighbouring words. It is trained on labelled findings: all
findings of all documents that strict rules (``rule_label``) are sure of, and a generated set
(``generated_findings``, ``generated_values``), each of which counts as often as makes the set
a third of the whole. Transitions and dictionary are counted over all documents. Features
are binned on fixed grids (``EDGES``), so findings of equal bins are one row with a count. The trees
grow a level at a time: Spark sums the counts of each node's bins, the driver picks the splits.
A model has a fixed size and is broadcast.

Scanning is one narrow pass over whole texts without a shuffle: memory is bounded by
``PART`` documents, and a lost task is simply run again.

Defined results: null and empty texts have no candidates and are kept as they are;
secrets do not overlap (a value and runs within it are candidates apart, and what is found
of them is one secret) and are reported from left to right; positions are code points;
redaction replaces each secret by ``MASK``; rows that repeat are scanned each and count each
in training; a very long text is scanned whole, in the task that holds it; an empty table
trains on the generated set alone and gives an empty result; all input columns are kept, and
clashing output names get a suffix.
"""

from __future__ import annotations

import math
import re
import uuid
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fresh, tidy, written

TREES, DEPTH, CUT = 40, 9, 0.5
PART = 256
TALLIED = 50_000  # different labelled findings in a task that counts for the trees
WORDS, HELD = 3000, 100_000  # of the dictionary; of words counted in a task before they are handed on
MASK = "[SECRET]"
SHORTEST, LONG = 6, 32  # of an assigned value; of a run that needs no digit

_run = re.compile(r"[A-Za-z0-9+/_\-]{12,}={0,2}")
_assigned = re.compile(r"""[=:]>?\s*["'`]?$""")
_before = re.compile(r"([A-Za-z_\-]{2,})\W{0,4}$")
_after = re.compile(r"^\W{0,4}([A-Za-z_\-]{2,})")
_hex = re.compile(r"[0-9a-f\-]+$", re.IGNORECASE)
_path = re.compile(r"(?:https?:/|www\.|[~.]?/)[^\s]*$|\.[a-z]{1,4}$", re.IGNORECASE)
SECRET_WORDS = ("password", "passwd", "pwd", "token", "secret", "apikey", "api_key", "api-key", "auth", "credential", "credentials", "bearer", "access_key", "private_key", "key")
_assign = re.compile(r"(?:=>|:=|={1,3}|:)[ \t]{0,8}")
_named = re.compile(rf"""(?:{"|".join(SECRET_WORDS)})(?:s|\d{{1,3}}|[_\-][a-z0-9_\-]{{0,30}})?["'`\]\\]{{0,3}}[ \t]{{0,8}}$""", re.IGNORECASE)
_value = re.compile(r"""(["'`])((?:\\.|(?!\1)[^\\\n]){%d,})\1|["'`]?(\S{%d,})""" % (SHORTEST, SHORTEST))
_reference = re.compile(r"\$[{(]|\$[A-Za-z_]+$|<[^>]*>|%\(|\{\{|https?:|[A-Za-z_.]+[(\[]|[A-Za-z_]+(?:\.[A-Za-z_]+)+$")
PLAIN_WORDS = ("commit", "sha", "md5", "checksum", "hash", "uuid", "version", "digest", "revision", "id", "order", "phone", "file", "example", "etag")
_provider = re.compile(r"(?:AKIA|ASIA)[0-9A-Z]{16}$|gh[pousr]_[0-9A-Za-z]{20,}$|xox[abpr]-[0-9A-Za-z\-]{10,}$|sk_(?:live|test)_[0-9A-Za-z]{16,}$|AIza[0-9A-Za-z_\-]{30,}$")


@dataclass(frozen=True)
class Finding:
    """A candidate with what stands around it."""

    value: str
    start: int
    left: str
    right: str
    named: bool = False  # a whole value behind an assignment to a secret word


def _values(text: str) -> list[Finding]:
    """Whole values of at least ``SHORTEST`` characters that are assigned to secret words."""
    out = []
    for m in _assign.finditer(text):
        if _named.search(text, max(0, m.start() - 80), m.start()) and (v := _value.match(text, m.end())):
            start, end = v.span(2 if v[2] is not None else 3)
            out.append(Finding(text[start:end], start, text[max(0, start - 40) : start], text[end : end + 24], True))
    return out


def candidates(text: str) -> list[Finding]:
    out = _values(text)
    seen = {(f.start, len(f.value)) for f in out}
    for m in _run.finditer(text):
        value, start = m[0], m.start()
        left = text[max(0, start - 40) : start]
        if (start, len(value)) in seen:
            continue
        if len(value) >= LONG or any("0" <= c <= "9" for c in value) or _provider.match(value) or _assigned.search(left):
            out.append(Finding(value, start, left, text[m.end() : m.end() + 24]))
    return sorted(out, key=lambda f: (f.start, -len(f.value)))


def _pairs(text: str) -> np.ndarray:
    """How often each of the 128 x 128 pairs of ASCII characters stands in the lower-case text."""
    codes = np.frombuffer(text.lower().encode("utf-32-le"), np.uint32)
    plain = (codes[:-1] < 128) & (codes[1:] < 128)
    return np.bincount((codes[:-1] * 128 + codes[1:])[plain], minlength=128 * 128)


def _words(text: str) -> list[str]:
    return [w for w in text.lower().split() if 3 <= len(w) <= 10 and w.isalpha()]


@dataclass(frozen=True)
class Prose:
    """Character transitions and frequent words of a sample."""

    transitions: np.ndarray  # log probabilities, 128 x 128
    words: frozenset

    @classmethod
    def of(cls, pairs: np.ndarray, words: list[str]) -> "Prose":
        counts = 0.1 + pairs.reshape(128, 128)
        return cls(np.log(counts / counts.sum(axis=1, keepdims=True)), frozenset(words))

    @classmethod
    def learn(cls, texts) -> "Prose":
        pairs, words = np.zeros(128 * 128), Counter()
        for text in texts:
            pairs += _pairs(text)
            words.update(_words(text))
        return cls.of(pairs, [w for w, _ in sorted(words.items(), key=lambda x: (-x[1], x[0]))[:WORDS]])

    def transition(self, value: str) -> float:
        codes = np.frombuffer(value.lower().encode("ascii", "replace"), np.uint8)
        return float(self.transitions[codes[:-1], codes[1:]].mean()) if len(codes) > 1 else 0.0

    def coverage(self, value: str) -> float:
        """Share of characters that a greedy reading from the left finds in frequent words."""
        value, at, found = value.lower(), 0, 0
        while at < len(value):
            for n in range(min(10, len(value) - at), 2, -1):
                if value[at : at + n] in self.words:
                    at, found = at + n, found + n
                    break
            else:
                at += 1
        return found / max(1, len(value))


def _word(pattern, text: str) -> str:
    m = pattern.search(text)
    return m[1].lower() if m else ""


def features(f: Finding, prose: Prose) -> list[float]:
    v, n = f.value, len(f.value)
    digits, upper, lower = (sum(test(c) for c in v) for test in (str.isdigit, str.isupper, str.islower))
    entropy = -sum(c / n * math.log2(c / n) for c in Counter(v).values())
    switches = sum((a.isdigit(), a.isupper()) != (b.isdigit(), b.isupper()) for a, b in zip(v, v[1:], strict=False))
    before, after = _word(_before, f.left), _word(_after, f.right)
    return [
        math.log(n), entropy, digits / n, upper / n, lower / n, switches / n,
        prose.transition(v), prose.coverage(v),
        float(bool(_hex.match(v))), float(v.count("-") + v.count("_")), float(v.count("/")), float(bool(_path.search(f.left))),
        float(f.right[:2] in (".p", ".j", ".c", ".g", ".h", ".t")), float(bool(_assigned.search(f.left))),
        float(f.named or any(w in before for w in SECRET_WORDS)), float(before in PLAIN_WORDS or after in PLAIN_WORDS),
        float(bool(_provider.match(v))), len(set(v)) / n,
        float(f.named), sum(map(str.isspace, v)) / n, sum(not (c.isalnum() or c.isspace()) for c in v) / n, float(bool(_reference.match(v))),
    ]


def rule_label(f: Finding) -> int | None:
    """1 or 0 where strict rules are sure, else None."""
    before = _word(_before, f.left)
    if _provider.match(f.value):
        return 1
    if f.named and _reference.match(f.value):
        return 0
    if any(c.isspace() for c in f.value):
        return None
    if len(set(f.value)) > 5 and any(c.isdigit() for c in f.value) and _assigned.search(f.left) and (f.named or any(w in before for w in SECRET_WORDS)):
        return 1
    if not any(c.isdigit() for c in f.value) or f.value.isdigit() or before in PLAIN_WORDS or _path.search(f.left):
        return 0
    return None


def generated_findings(n: int = 1500, seed: int = 9) -> list[tuple[Finding, int]]:
    """``n`` labelled findings of many kinds, secrets and lookalikes, the same at each call."""
    rng = np.random.default_rng(seed)
    pick = lambda letters, k: "".join(letters[i] for i in rng.integers(0, len(letters), k))
    upper, low, digit = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz", "0123456789"
    hexa, every = digit + "abcdef", upper + low + digit
    prose = ["see", "the", "and", "with", "value", "of", "is", "in", "was"]
    out = []
    for i in range(n):
        size, kind = int(rng.integers(14, 48)), i % 14
        word = lambda: prose[int(rng.integers(len(prose)))] + " "
        key = SECRET_WORDS[int(rng.integers(len(SECRET_WORDS)))]
        if kind == 0:
            row = (word(), "AKIA" + pick(upper + digit, 16), 1)
        elif kind == 1:
            row = (f"{key}=", pick(hexa, size), 1)
        elif kind == 2:
            row = (f'{key} = "', pick(every, size), 1)
        elif kind == 3:
            row = (f"{key}: ", pick(every + "+/", size) + "=", 1)
        elif kind == 4:
            row = (word(), ("ghp_", "xoxb-", "sk_live_")[i % 3] + pick(every, 36), 1)
        elif kind == 5:
            row = (f"{key} ", pick(every, size), 1)
        elif kind == 6:
            row = (PLAIN_WORDS[int(rng.integers(len(PLAIN_WORDS)))] + " ", pick(hexa, 40), 0)
        elif kind == 7:
            row = (word(), str(uuid.UUID(int=int(rng.integers(2**62)) << 64 | int(rng.integers(2**62)))), 0)
        elif kind == 8:
            row = ("https://example.org/", "/".join(pick(low, 7) for _ in range(3)) + str(i), 0)
        elif kind == 9:
            row = (word(), "-".join(["chapter", "section", "figure", "table"][j % 4] for j in range(3)) + f"-{i}", 0)
        elif kind == 10:
            row = (word(), pick(digit, size), 0)
        elif kind == 11:
            row = (f"{key}=", ("x" * size, "your_password_here", "changeme-changeme", "0" * size)[i // 14 % 4], 0)
        elif kind == 12:
            row = (word(), "_".join(["get", "value", "from", "record", "index"][: 2 + i % 4]) + f"_{i % 100}", 0)
        else:
            row = (word(), "".join(["tion", "ing", "heit", "ment", "able", "ung", "ante", "ere"][j] for j in rng.integers(0, 8, 9)), 0)
        out.append((Finding(row[1], len(row[0]), row[0], '" and' if row[0].endswith('"') else " and"), row[2]))
    return out


def generated_values(n: int = 1500, seed: int = 10) -> list[tuple[Finding, int]]:
    """``n`` labelled values behind assignments to secret words, short ones too, the same at each call."""
    rng = np.random.default_rng(seed)
    of = lambda kinds: kinds[int(rng.integers(len(kinds)))]
    pick = lambda letters, k: "".join(of(letters) for _ in range(k))
    low, digit, marks = "abcdefghijklmnopqrstuvwxyz", "0123456789", "!@#$%^&*.~?-_+"
    words = ["summer", "dragon", "hunter", "winter", "monkey", "letme", "river", "tiger", "coffee", "orange", "secure", "admin"]
    plain = ["required", "string", "undefined", "changeme", "password", "example", "optional", "invalid", "missing", "default", "primary", "enabled", "disabled", "nothing", "something", "whatever", "function"]
    prose = ["the", "value", "must", "not", "be", "empty", "is", "too", "short", "please", "enter", "a", "new", "one", "of", "your", "account", "has", "expired"]
    out = []
    for i in range(n):
        key, quote = of(SECRET_WORDS), of(["", '"', "'"])
        left = (of(["", "db_", "my-", "the "]) + key, (of(["", "DB_", "APP_"]) + key).upper())[i % 2] + of(["=", " = ", ": ", ":"]) + quote
        kind = i // 2 % 10
        if kind == 0:
            value, y = pick(low + low.upper() + digit + marks, int(rng.integers(6, 22))) + of(digit) + of(low), 1
        elif kind == 1:
            value, y = of([str.title, str.lower])(of(words)) + pick(digit, int(rng.integers(1, 5))) + of(["", "!", "#", "X9q", "$"]), 1
        elif kind == 2:
            value, y = (of(words).title() + of(marks) + of(words) + of(marks) + pick(digit, 2)).replace("o", "0", 1), 1
        elif kind == 3:
            value, y = pick(low + digit, int(rng.integers(7, 14))) + of(digit) + of(low), 1
        elif kind == 4:
            value, y = pick(low + low.upper() + digit, 4) + of("!#%&*?") + pick(low + low.upper() + digit, 4) + of("!#%&*?$") + of(digit) + of(low), 1
        elif kind == 5:
            value, y = of(plain) + of(["", ",", ".", ";", ")"]), 0
        elif kind == 6:
            value, y = of(["*", "x", "X", ".", "-", "0"]) * int(rng.integers(6, 16)), 0
        elif kind == 7:
            value, y = of(["${%s}", "os.environ[%s]", "process.env.%s", "get_%s()", "$%s", "<%s>", "{{%s}}", "config.%s", "https://example.org/%s"]) % of([str.lower, str.upper])(of([*plain, *SECRET_WORDS])), 0
        elif kind == 8:
            value, y = (" ".join(of(prose) for _ in range(int(rng.integers(2, 9)))) if quote else of(prose) + of(plain)), 0
        else:
            value, y = of(["your_", "my_", "some-", "new_", "user_"]) + of(plain) + of(["", "_here", "_name"]), 0
        out.append((Finding(value, len(left), left, quote + " and", True), y))
    return out


def _edges() -> np.ndarray:
    """Inner edges of each feature's ``BINS`` equal bins; what lies outside is in the first or last."""
    share, flag, marks = (0, 1), (0, 1), (0, 16)
    ranges = [(1.5, 7), (0, 6.5), *[share] * 4, (-12, 0), share, flag, marks, marks, *[flag] * 6, share, flag, share, share, flag]
    return np.array([np.linspace(low, high, BINS + 1)[1:-1] for low, high in ranges])


BINS = 64
EDGES = _edges()


def binned(x: np.ndarray) -> np.ndarray:
    return np.stack([np.searchsorted(e, x[:, i], side="right") for i, e in enumerate(EDGES)], axis=1).astype(np.uint8)


def _draws(codes: bytes, label: int, n: int, trees: int, seed: int) -> np.ndarray:
    """How often each tree's bootstrap holds ``n`` equal findings: the same wherever it is drawn."""
    return np.random.default_rng([seed, xxhash.xxh3_64_intdigest(codes + bytes([label]))]).poisson(n, trees)


def _tally(nodes: list, front: list, chosen: np.ndarray, codes: np.ndarray, labels: np.ndarray, draws: np.ndarray) -> np.ndarray:
    """Flat counts by node of ``front``, feature chosen there, bin and label."""
    per = chosen.shape[1]
    total = np.zeros(len(front) * per * BINS * 2)
    for t, tree in enumerate(nodes):
        slots = np.full(len(tree), -1)
        for i, (of, node) in enumerate(front):
            if of == t:
                slots[node] = i
        feature, cut, left, right = (np.array([n[c] for n in tree]) for c in range(4))
        at = np.zeros(len(codes), int)
        while (inner := feature[at] >= 0).any():
            go = codes[np.arange(len(codes)), np.maximum(feature[at], 0)] <= cut[at]
            at = np.where(inner, np.where(go, left[at], right[at]), at)
        rows = np.flatnonzero((slots[at] >= 0) & (draws[:, t] > 0))
        slot = slots[at[rows]]
        for j in range(per):
            cells = ((slot * per + j) * BINS + codes[rows, chosen[slot, j]]) * 2 + labels[rows]
            total += np.bincount(cells, draws[rows, t], len(total))
    return total


@dataclass(frozen=True)
class Forest:
    """Trees as arrays: feature (-1 in a leaf), threshold, left and right child, share of secrets."""

    trees: tuple

    @classmethod
    def train(cls, x: np.ndarray, y: np.ndarray, trees: int = TREES, depth: int = DEPTH, seed: int = 5) -> "Forest":
        """Fit on rows held here."""
        rows, n = np.unique(np.column_stack([binned(x), y.astype(np.uint8)]), axis=0, return_counts=True)
        codes, labels = np.ascontiguousarray(rows[:, :-1]), rows[:, -1].astype(int)
        draws = np.array([_draws(c.tobytes(), int(y), int(k), trees, seed) for c, y, k in zip(codes, labels, n, strict=True)])
        return cls.grow(lambda *at: _tally(*at, codes, labels, draws), trees, depth, seed)

    @classmethod
    def grow(cls, tally, trees: int = TREES, depth: int = DEPTH, seed: int = 5) -> "Forest":
        """Grow all trees by a level at a time from ``tally``, which counts as ``_tally`` does."""
        rng, per = np.random.default_rng(seed), max(1, int(len(EDGES) ** 0.5))
        nodes: list[list[list]] = [[[-1, 0, 0, 0, 0.0]] for _ in range(trees)]  # feature, last bin to the left, children, share
        front = [(t, 0) for t in range(trees)]
        for level in range(depth):
            if not front:
                break
            chosen = np.array([rng.choice(len(EDGES), per, replace=False) for _ in front])
            counts = tally(nodes, front, chosen).reshape(len(front), per, BINS, 2)
            after = []
            for (t, node), features, count in zip(front, chosen, counts, strict=True):
                if level == 0:
                    nodes[t][node][4] = count[0, :, 1].sum() / max(1, count[0].sum())
                if best := cls._split(features, count):
                    nodes[t][node][:4] = [best[0], best[1], len(nodes[t]), len(nodes[t]) + 1]
                    for n, ones in best[2]:
                        if 0 < ones < n and n >= 4:
                            after.append((t, len(nodes[t])))
                        nodes[t].append([-1, 0, 0, 0, ones / n])
            front = after
        return cls(tuple(cls._arrays(tree) for tree in nodes))

    @staticmethod
    def _split(features: np.ndarray, count: np.ndarray):
        """Feature, last bin to the left and both sides' (rows, secrets) of the split with the least impurity."""
        best = None
        for f, bins in zip(features, count, strict=True):
            held = np.flatnonzero(bins.sum(axis=1))
            if len(held) > 1:
                n, ones = np.cumsum(bins[held].sum(axis=1)), np.cumsum(bins[held, 1])
                a, b, p, q = n[:-1], n[-1] - n[:-1], ones[:-1], ones[-1] - ones[:-1]
                loss = p * (1 - p / a) + q * (1 - q / b)
                i = int(loss.argmin())
                if best is None or loss[i] < best[0]:
                    best = (loss[i], int(f), int(held[i] + held[i + 1]) // 2, ((a[i], p[i]), (b[i], q[i])))
        return best and best[1:]

    @staticmethod
    def _arrays(tree: list) -> tuple:
        """With thresholds on the features themselves: the largest number below the edge."""
        feature, cut, left, right, share = (np.array(c) for c in zip(*tree, strict=True))
        return feature, np.where(feature < 0, 0.0, np.nextafter(EDGES[np.maximum(feature, 0), cut], -np.inf)), left, right, share

    def predict(self, x: np.ndarray) -> np.ndarray:
        total = np.zeros(len(x))
        for feature, threshold, left, right, share in self.trees:
            at = np.zeros(len(x), int)
            while (inner := feature[at] >= 0).any():
                f = np.maximum(feature[at], 0)
                step = np.where(x[np.arange(len(x)), f] <= threshold[at], left[at], right[at])
                at = np.where(inner, step, at)
            total += share[at]
        return total / max(1, len(self.trees))


@dataclass(frozen=True)
class SecretModel:
    prose: Prose
    forest: Forest

    def scores(self, found: list[Finding]) -> np.ndarray:
        if not found:
            return np.empty(0)
        return self.forest.predict(np.array([features(f, self.prose) for f in found]))


def learn_prose(docs: DataFrame, text: str = "text") -> Prose:
    """Transitions and the ``WORDS`` most frequent words of all texts, counted in tasks and summed by Spark."""

    def count(batches):
        pairs, words = np.zeros(128 * 128, np.int64), Counter()
        handed = lambda words, pairs, n: pa.RecordBatch.from_arrays([pa.array(words, pa.string()), pa.array(pairs, pa.int32()), pa.array(n, pa.int64())], ["word", "pair", "n"])
        for batch in batches:
            for t in batch.column(0):
                t = t.as_py()
                pairs += _pairs(t)
                words.update(_words(t))
                if len(words) > HELD:
                    yield handed(list(words), [None] * len(words), list(words.values()))
                    words.clear()
        yield handed(list(words), [None] * len(words), list(words.values()))
        del words
        at = np.flatnonzero(pairs)
        yield handed([None] * len(at), at, pairs[at])
        tidy()

    rows = docs.select(F.col(text).cast("string").alias("t")).where("t is not null").mapInArrow(count, "word string, pair int, n long")
    sums = rows.groupBy("word", "pair").agg(F.sum("n").alias("n"))
    top = sums.orderBy(F.col("pair").isNull(), F.col("n").desc(), "word").limit(128 * 128 + WORDS).toArrow().to_pylist()  # pairs first
    pairs = np.zeros(128 * 128)
    for r in top:
        if r["pair"] is not None:
            pairs[r["pair"]] = r["n"]
    return Prose.of(pairs, [r["word"] for r in top if r["pair"] is None][:WORDS])


def _labelled(found, prose: Prose) -> pd.DataFrame:
    """Bins and labels of (finding, label)."""
    x = binned(np.array([features(f, prose) for f, _ in found])) if found else []
    return pd.DataFrame({"codes": [c.tobytes() for c in x], "label": np.array([y for _, y in found], np.int32)})


def train(docs: DataFrame, text: str = "text", trees: int = TREES, depth: int = DEPTH, seed: int = 5) -> SecretModel:
    """Fit on all documents' findings that ``rule_label`` is sure of and the generated ones."""
    spark = docs.sparkSession
    prose = learn_prose(docs, text)
    shared = spark.sparkContext.broadcast(prose)

    def read(batches):
        for pdf in batches:
            for at in range(0, len(pdf), PART):
                yield _labelled([x for t in pdf["t"].iloc[at : at + PART] for f in candidates(t) if (x := (f, rule_label(f)))[1] is not None], shared.value)
        tidy()

    def drawn(batches):
        for pdf in batches:
            yield pdf.assign(draws=[_draws(c, y, n, trees, seed).astype("<i8").tobytes() for c, y, n in zip(pdf["codes"], pdf["label"], pdf["n"], strict=True)])

    rows = docs.select(F.col(text).cast("string").alias("t")).where("t is not null").mapInPandas(read, "codes binary, label int")
    found = written(rows.groupBy("codes", "label").agg(F.count(F.lit(1)).alias("n")))
    generated = generated_findings() + generated_values()
    times = max(1, -(-(found.agg(F.sum("n")).head()[0] or 0) // (2 * len(generated))))
    made = spark.createDataFrame(_labelled(generated, prose), "codes binary, label int").withColumn("n", F.lit(times).cast("long"))
    table = written(found.unionByName(made).groupBy("codes", "label").agg(F.sum("n").alias("n")).mapInPandas(drawn, "codes binary, label int, n long, draws binary"))

    table = table.coalesce(max(1, -(-table.count() // TALLIED)))  # each task hands on counts of its own, so no more tasks than rows need

    def tally(nodes, front, chosen):
        def count(batches):
            total = np.zeros(chosen.size * BINS * 2)
            for pdf in batches:
                of = lambda c, kind, width: np.frombuffer(b"".join(pdf[c]), kind).reshape(-1, width)  # noqa: E731, B023
                total += _tally(nodes, front, chosen, of("codes", np.uint8, len(EDGES)), pdf["label"].to_numpy(), of("draws", "<i8", trees))
            yield pd.DataFrame({"cell": np.flatnonzero(total), "n": total[total > 0]})
            del total
            tidy()

        sums = table.mapInPandas(count, "cell long, n double").groupBy("cell").agg(F.sum("n").alias("n")).toArrow()
        total = np.zeros(chosen.size * BINS * 2)
        total[sums["cell"].to_numpy()] = sums["n"].to_numpy()
        return total

    return SecretModel(prose, Forest.grow(tally, trees, depth, seed))


def _merged(bad: list[tuple[Finding, float]]) -> list[tuple[int, int, float]]:
    """(start, end, score) of findings in order; those that overlap are one, with the best score."""
    out = []
    for f, score in bad:
        start, end = f.start, f.start + len(f.value)
        if out and start < out[-1][1]:
            out[-1] = (out[-1][0], max(end, out[-1][1]), max(score, out[-1][2]))
        else:
            out.append((start, end, score))
    return out


def scan(docs: DataFrame, model: SecretModel, text: str = "text", cut: float = CUT) -> DataFrame:
    """``docs`` with ``n_candidates``, ``secrets`` (start, length, score) and ``redacted``, the text without secrets."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("n_candidates long, secrets array<struct<start:long,length:long,score:double>>, redacted string")
    def found(texts: pd.Series) -> pd.DataFrame:
        rows = []
        for at in range(0, len(texts), PART):
            part = [x for x in texts.iloc[at : at + PART]]
            each = [candidates(x) if x else [] for x in part]
            scores = shared.value.scores([f for one in each for f in one])
            i = 0
            for x, one in zip(part, each, strict=True):
                bad = _merged([(f, float(s)) for f, s in zip(one, scores[i : i + len(one)], strict=True) if s >= cut])
                i += len(one)
                pieces, end = [], 0
                for start, stop, _ in bad:
                    pieces += [x[end:start], MASK]
                    end = stop
                rows.append((len(one), [{"start": a, "length": b - a, "score": s} for a, b, s in bad], x if not bad else "".join([*pieces, x[end:]])))
        return pd.DataFrame(rows, columns=["n_candidates", "secrets", "redacted"])

    made = fresh(docs, "_secrets")
    out = docs.withColumn(made, found(F.col(text).cast("string")))
    return out.select(*[F.col(f"`{c}`") for c in docs.columns], *[F.col(made)[c].alias(fresh(docs, c)) for c in ("n_candidates", "secrets", "redacted")])
