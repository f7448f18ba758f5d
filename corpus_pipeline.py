"""A pipeline over ``documents``: each stage calls one operator of the subpackage ``llm``.

A stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet
and read again as the next stage's ``docs``. All but the last return the columns of
``documents``; ``n_chars`` follows the text.

In every stage an empty table gives an empty result, a very long text is taken whole, and
further columns are carried along whatever they are named (the last stage ignores them).
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quirelake.llm import jaccard, language_id, packing, secrets, suffix_dedup
from quirelake.llm.common import fresh, table, written

#: A document is rejected if it has no letter, or if its best language is less likely than not.
LEAST_LANGUAGE_SCORE = 0.5


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is found, with that language in ``lang``.

    Null, empty and letterless texts go; rows that repeat stay or go alike; of equally likely languages the first in order counts.
    """
    model = language_id.train(docs.where(language_id.training_part(docs)))
    made = fresh(docs, "_language")
    found = docs.withColumn(made, language_id.language_of(model, F.col("text"), spark))
    found = found.where((F.col(made)["lang"] != language_id.UNDETERMINED) & (F.col(made)["score"] >= LEAST_LANGUAGE_SCORE))
    return found.withColumn("lang", F.col(made)["lang"]).select(docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The first document of each class of the Jaccard join.

    A null text is empty; texts without a word all stay; the least id is the first, a null id comes last; of rows that repeat one stays.
    """
    return jaccard.keep_one(docs).select(docs.columns)


def remove_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the byte strings that a smaller id has too. A character that is cut apart goes as a whole.

    A null text becomes the empty one; every row stays; rows of equal ids take nothing from each other; a null id is the largest.
    """
    rest = [c for c in docs.columns if c not in ("doc_id", "text")]
    found = suffix_dedup.remove_repeats(docs, carried=rest, as_text=True)
    found = found.select("doc_id", F.col("kept").alias("text"), "carried.*")
    return found.withColumn("n_chars", F.length("text").cast("long")).select(docs.columns)


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts with each secret masked; every row stays, repeated ones and those with a null or empty text too."""
    found = secrets.scan(docs, secrets.train(docs))
    return found.withColumn("text", F.col(fresh(docs, "redacted"))).withColumn("n_chars", F.length("text").cast("long")).select(docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Training sequences of all rows: repeated ones are packed each, a null or empty text is its end id alone, equal scores go by the order of the sort."""
    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("language_id", identify_language),
    ("jaccard_join", drop_near_duplicates),
    ("suffix_dedup", remove_repeats),
    ("secret_scan", redact_secrets),
    ("packing", pack),
]

#: Learned models, min-hashing and a tokenizer's tables have no SQL; tests hold the stages against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
