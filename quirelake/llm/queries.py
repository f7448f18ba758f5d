"""The queries of this subpackage: each applies one operator to its whole table."""

from __future__ import annotations

import hashlib

import pandas as pd
import corpus_pipeline
import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import ann, backoff, bpe, chat, fingerprint, jaccard, language_id, packing, secrets, suffix_dedup
from .common import table


def op1_additive_quantisation(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return ann.search(vectors, vectors.where("vec_id % 20 = 0"), k=20)


def op2_retrieval_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op3_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    probe = "</s>[INST] ok [/INST]"
    extra = spark.createDataFrame([(-7, 0, "user", probe), (-7, 1, "assistant", probe)], turns.schema)
    turns = turns.unionByName(extra).withColumn("content", chat.text_part(F.col("text")))
    formatted = chat.format_chats(turns)
    return formatted.withColumn("read", read_back("formatted", "loss_spans")).select(
        "conv_id", "read.n_turns", "read.turns_sha256", "read.loss_chars", "read.loss_sha256", F.length("formatted").cast("long").alias("formatted_chars")
    )


def read_back(formatted: str, spans: str) -> Column:
    """What a reader of the formatted string and its mask gets."""

    @F.pandas_udf("n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string")
    def read(texts: pd.Series, masks: pd.Series) -> pd.DataFrame:
        rows = []
        for text, mask in zip(texts, masks, strict=True):
            turns = chat.parse(text)
            loss = "".join(chat.unescape(text[s["start"] : s["start"] + s["length"]]) for s in mask)
            whole = "".join(f"{role}\n{body}\n" for role, body in turns)
            rows.append((len(turns), hashlib.sha256(whole.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest()))
        return pd.DataFrame(rows, columns=["n_turns", "turns_sha256", "loss_chars", "loss_sha256"])

    return read(formatted, spans)


def op4_stupid_backoff(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = backoff.score(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_words", F.round("log_score", 3).alias("log_score"), F.round("mean_log_score", 4).alias("mean_log_score"))


OP4_SQL = """
WITH words AS (
  SELECT doc_id, unnest(ws) AS w, generate_subscripts(ws, 1) AS i
  FROM (SELECT doc_id, list_filter(string_split_regex(lower(coalesce(text, '')), '\\s+'), lambda x: x <> '') AS ws FROM documents)
), pairs AS (
  SELECT doc_id, i, w, lag(w) OVER (PARTITION BY doc_id ORDER BY i) AS v FROM words
), one AS (
  SELECT w, count(*) AS c1 FROM words GROUP BY w
), two AS (
  SELECT v, w, count(*) AS c2 FROM pairs WHERE v IS NOT NULL GROUP BY v, w
), n AS (
  SELECT count(*) AS n FROM words
), logs AS (
  SELECT p.doc_id, CASE WHEN p.v IS NULL THEN ln(a.c1 / n.n) WHEN two.c2 >= 2 THEN ln(two.c2 / b.c1) ELSE ln(a.c1 / n.n) + ln(0.4) END AS s
  FROM pairs p CROSS JOIN n JOIN one a ON a.w = p.w LEFT JOIN one b ON b.w = p.v LEFT JOIN two ON two.v = p.v AND two.w = p.w
), sums AS (
  SELECT doc_id, count(*) AS n_words, sum(s) AS t FROM logs GROUP BY doc_id
)
SELECT d.doc_id, coalesce(s.n_words, 0) AS n_words, round(coalesce(s.t, 0.0), 3) AS log_score, round(s.t / s.n_words, 4) AS mean_log_score
FROM documents d LEFT JOIN sums s ON s.doc_id = d.doc_id
"""


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    part = language_id.training_part(docs)
    model = language_id.train(docs.where(part))
    found = language_id.identify(docs.select("doc_id", "text"), model)
    return found.select("doc_id", (~part).alias("held_out"), "lang_pred", "score")


def op6_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.join(table(spark, sf_dir, "documents"))


def op7_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranks = bpe.read_ranks(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))
    vocabulary = bpe.Vocabulary(ranks, public_tokenizers.PATTERN)
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return bpe.round_trip(docs, vocabulary).select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256")


def op8_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint.compare_edits(table(spark, sf_dir, "documents"))


def op9_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = secrets.scan(docs, secrets.train(docs))
    return found.select("doc_id", "n_candidates", F.size("secrets").cast("long").alias("n_secrets"), "secrets", F.sha2("redacted", 256).alias("redacted_sha256"))


def op10_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = suffix_dedup.remove_repeats(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


QUERIES = {
    "op1_additive_quantisation": op1_additive_quantisation,
    "op2_retrieval_packing": op2_retrieval_packing,
    "op3_chat_format": op3_chat_format,
    "op4_stupid_backoff": op4_stupid_backoff,
    "op5_language_id": op5_language_id,
    "op6_jaccard_join": op6_jaccard_join,
    "op7_byte_bpe": op7_byte_bpe,
    "op8_fingerprint": op8_fingerprint,
    "op9_secret_scan": op9_secret_scan,
    "op10_suffix_dedup": op10_suffix_dedup,
    "pipeline": corpus_pipeline.run,
}

#: The other operators are iterative, learned or made of tokenizer tables, which SQL does not express.
ORACLE_SQL: dict[str, str] = {"op4_stupid_backoff": OP4_SQL}
if corpus_pipeline.ORACLE_SQL:
    ORACLE_SQL["pipeline"] = corpus_pipeline.ORACLE_SQL
