"""The registered queries of the training-data operators, each over its whole table, and their SQL where there is one."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontaminate, linededup, lm, minhash, packing, repair, secrets, sql, toxicity, warc, winnow


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_table(spark, sf_dir, "documents"))


def op2_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(_table(spark, sf_dir, "documents"), minhash.NearDuplicates(words=2, percent=80))


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op4_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archive(_table(spark, sf_dir, "pages")).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "urlkey", "ts")


def op5_winnowing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return winnow.edited_fingerprints(_table(spark, sf_dir, "documents"))


def op6_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.scan(_table(spark, sf_dir, "documents")).drop("base")


def op7_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair.token_output(_table(spark, sf_dir, "documents"))


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = linededup.deduplicated_lines(_table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_lines", "n_removed", F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256).alias("clean_sha256"), "first_docs")


def op9_language_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.language_model_scores(_table(spark, sf_dir, "documents"))


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.overlaps(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


# Columns of the above that SQL can say too: the operators' own results, beside their SQL.


def edited_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op5_winnowing(spark, sf_dir).select("doc_id", "n_chars", "edited_sha256")


def secret_base_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op6_secrets(spark, sf_dir).drop("spans")


def word_model_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op9_language_model(spark, sf_dir).drop("score").withColumn("base_score", F.round("base_score", 4))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_packing": op1_packing,
    "op2_minhash": op2_minhash,
    "op3_toxicity": op3_toxicity,
    "op4_warc": op4_warc,
    "op5_winnowing": op5_winnowing,
    "op6_secrets": op6_secrets,
    "op7_token_output": op7_token_output,
    "op8_line_dedup": op8_line_dedup,
    "op9_language_model": op9_language_model,
    "op10_decontamination": op10_decontamination,
    "edited_texts": edited_texts,
    "secret_base_spans": secret_base_spans,
    "word_model_scores": word_model_scores,
}

ORACLE_SQL: dict[str, str] = {
    "op2_minhash": sql.NEAR_DUPLICATES,
    "op4_warc": sql.ARCHIVES,
    "edited_texts": sql.EDITED_TEXTS,
    "secret_base_spans": sql.BASE_SPANS,
    "word_model_scores": sql.WORD_MODEL,
}
