"""Language identification: multinomial naive Bayes over hashed character n-grams.

Training counts come from a bounded sample of the labelled rows (``per_language``
is the expected bound for each language); the prior comes from the labels of all
training rows. The log-probability matrix, ``dims`` x languages doubles, is checked
against ``MAX_MATRIX_BYTES`` before it is broadcast. Scoring is one narrow pass: a
vectorised UDF makes the n-grams of a batch of whole texts the compressed rows of a sparse
matrix and multiplies that with the log-probabilities.

Defined results: null text, empty text and text without a letter give ``und`` with
score 0. Very long texts are read in slices that reach as far as their n-grams, so what is
held beside a text does not grow with it. Equal scores go to the language that sorts first.
Rows that repeat are identified each. With no labelled rows every document is ``und``; an
empty table gives an empty result. All input columns are kept; an output name that clashes
gets a suffix.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import fresh

ORDERS = (1, 2, 3)
DIMS = 1 << 15
PER_LANGUAGE = 2000
SLICE = 1 << 18
MAX_MATRIX_BYTES = 64 << 20
UNDETERMINED = "und"

_letters: list[np.ndarray] = []


def _letter_table() -> np.ndarray:
    if not _letters:
        _letters.append(np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000))
    return _letters[0]


def grams(texts, dims: int = DIMS):
    """Bounded runs of (number of the text, bucket) of every character n-gram, one order of n-grams at a time.

    Texts are lowercased, letters kept and all else read as blanks; an n-gram counts if it has a letter.
    A run covers the n-grams that begin in it and reads as far as they reach, so cuts lose none.
    """
    held, size = [], 0
    for i, text in enumerate(texts):
        codes = np.frombuffer((text or "").lower().encode("utf-32-le", "replace"), np.uint32)
        for at in range(0, len(codes), SLICE):
            part = codes[at : at + SLICE + ORDERS[-1] - 1]
            held.append((i, part, min(SLICE, len(codes) - at)))
            size += len(part)
            if size >= SLICE:
                yield from _hashed(held, dims)
                held, size = [], 0
    if held:
        yield from _hashed(held, dims)


def _hashed(parts: list[tuple[int, np.ndarray, int]], dims: int):
    """The n-grams that begin in the first ``length`` code points of each part (text, code points, length)."""
    own = np.repeat(np.arange(len(parts)), [len(p[1]) for p in parts])
    begins = np.concatenate([np.arange(len(p[1])) < p[2] for p in parts])
    text = np.array([p[0] for p in parts])
    codes = np.concatenate([p[1] for p in parts])
    letter = _letter_table()[codes]
    codes = np.where(letter, codes, np.uint32(32)).astype(np.uint64)
    shift = np.uint64(64 - (dims - 1).bit_length())
    h, any_letter = codes, letter
    for n in ORDERS:
        if n > 1:
            h = h[:-1] * np.uint64(0x100000001B3) + codes[n - 1 :]
            any_letter = any_letter[:-1] | letter[n - 1 :]
        here = any_letter & begins[: len(h)] & (own[: len(h)] == own[n - 1 :])
        salted = h[here] * np.uint64(0x9E3779B97F4A7C15) + np.uint64(0 if n == 1 else n)
        yield text[own[: len(h)][here]], (salted >> shift).astype(np.int64)


def buckets(text: str, dims: int = DIMS) -> np.ndarray:
    """Bucket of every n-gram of one text."""
    found = [b for _, b in grams([text], dims)]
    return np.concatenate(found) if found else np.empty(0, np.int64)


@dataclass(frozen=True)
class LanguageModel:
    languages: tuple[str, ...]
    log_prob: np.ndarray  # dims x languages
    log_prior: np.ndarray

    def predict(self, texts) -> tuple[list[str], np.ndarray]:
        """Language and probability of each text: sparse rows of buckets times the matrix, a batch at a time.

        A run of ``grams`` is sorted by text: compressed rows in which a bucket may repeat, summed where a row begins.
        """
        total, seen = np.tile(self.log_prior, (len(texts), 1)), np.zeros(len(texts), bool)
        for own, bucket in grams(texts, self.log_prob.shape[0]) if self.languages else ():
            if len(own):
                first = np.flatnonzero(np.diff(own, prepend=-1))
                for at, name in enumerate(self.languages):
                    total[own[first], at] += np.add.reduceat(self.log_prob[bucket, at], first)
                seen[own[first]] = True
        if not len(texts) or not self.languages:
            return [UNDETERMINED] * len(texts), np.zeros(len(texts))
        p = np.exp(total - total.max(axis=1, keepdims=True))
        best = p.argmax(axis=1)
        score = np.where(seen, p.max(axis=1) / p.sum(axis=1), 0.0)
        return [self.languages[b] if s else UNDETERMINED for b, s in zip(best.tolist(), seen.tolist(), strict=True)], score


def train(
    labelled: DataFrame,
    text: str = "text",
    lang: str = "lang",
    key: str = "doc_id",
    per_language: int = PER_LANGUAGE,
    dims: int = DIMS,
    alpha: float = 0.5,
) -> LanguageModel:
    """Fit on rows with a label. Rows are sampled by a hash of ``key``, about ``per_language`` for each language."""
    rows = labelled.where(F.col(lang).isNotNull() & F.col(text).isNotNull())
    most = MAX_MATRIX_BYTES // (dims * 8)
    sizes = {r[0]: r[1] for r in rows.where(F.col(lang) != UNDETERMINED).groupBy(F.col(lang).cast("string")).count().limit(most + 1).collect()}
    if len(sizes) > most:
        raise ValueError(f"more than {most} languages need a matrix beyond {MAX_MATRIX_BYTES} bytes; lower dims")
    languages = tuple(sorted(sizes))
    if not languages:
        return LanguageModel((), np.zeros((dims, 0)), np.zeros(0))
    every = F.create_map(*[F.lit(x) for name in languages for x in (name, -(-sizes[name] // per_language))])
    picked = rows.select(F.col(lang).cast("string").alias("lang"), F.col(text).alias("text"), F.xxhash64(F.col(key).cast("string")).alias("h"))
    picked = picked.where(F.pmod("h", every[F.col("lang")].cast("long")) == 0).select("lang", "text")

    def count(batches):
        for pdf in batches:
            for name, texts in pdf.groupby("lang")["text"]:
                total = np.zeros(dims, np.int64)
                for _, bucket in grams(texts, dims):
                    total += np.bincount(bucket, minlength=dims)
                used = np.flatnonzero(total)
                yield pd.DataFrame({"lang": name, "bucket": used, "n": total[used]})

    counts = picked.mapInPandas(count, "lang string, bucket long, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toPandas()
    matrix = np.full((dims, len(languages)), alpha)
    matrix[counts["bucket"].to_numpy(), counts["lang"].map(languages.index).to_numpy(int)] += counts["n"].to_numpy()
    prior = np.array([sizes[x] for x in languages], float)
    return LanguageModel(languages, np.log(matrix / matrix.sum(axis=0)), np.log(prior / prior.sum()))


def language_of(model: LanguageModel, text: Column, spark) -> Column:
    """Struct (lang, score) of a text column; the model is broadcast once."""
    shared = spark.sparkContext.broadcast(model)

    @F.pandas_udf("lang string, score double")
    def predict(texts: pd.Series) -> pd.DataFrame:
        names, scores = shared.value.predict(texts.tolist())
        return pd.DataFrame({"lang": names, "score": scores})

    # else a filter on the struct would be pushed down and work it out a second time
    return predict.asNondeterministic()(text)


def identify(docs: DataFrame, model: LanguageModel, text: str = "text") -> DataFrame:
    """``docs`` with ``lang_pred`` and ``score``."""
    made = fresh(docs, "_language")
    out = docs.withColumn(made, language_of(model, F.col(text), docs.sparkSession))
    return out.select(*[F.col(f"`{c}`") for c in docs.columns], F.col(made)["lang"].alias(fresh(docs, "lang_pred")), F.col(made)["score"].alias(fresh(docs, "score")))


def training_part(docs: DataFrame, key: str = "doc_id") -> Column:
    """True for the rows that training may read: crc32 of the id as text, mod 3, is not 1."""
    return F.crc32(F.col(key).cast("string")) % 3 != 1
