"""The queries of the training-data operators; each runs over its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import language_model, line_quality, minhash, mixing, packing, personal_data, simhash, substring_dedup, token_files, toxicity
from .shared import documents


def fold(column, folds: int = 5):
    """crc32 of the id as text, modulo folds."""
    return F.pmod(F.crc32(F.col(column).cast("string").cast("binary")), F.lit(folds))


def op1_line_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_quality.clean_lines(documents(spark, sf_dir), with_text=False)


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(documents(spark, sf_dir))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op3_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return personal_data.personal_spans(documents(spark, sf_dir))


def op4_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.remove_repeats(documents(spark, sf_dir))


def op5_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.fingerprints(documents(spark, sf_dir))


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    return mixing.mix_to_targets(docs, mixing.language_quality(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def op7_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files.round_trip(documents(spark, sf_dir))


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    lexicon = toxicity.fit_lexicon(docs, labels, train=fold("doc_id") != 0)
    scored = toxicity.score_toxicity(docs, lexicon)
    return scored.select("doc_id", (fold("doc_id") == 0).alias("held_out"), "score", "predicted")


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(documents(spark, sf_dir))


def op10_language_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    held_out = F.coalesce(fold("doc_id") == 1, F.lit(False))
    scored = language_model.score(documents(spark, sf_dir), ~held_out)
    return scored.select("doc_id", held_out.alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


QUERIES = {f.__name__: f for f in (op1_line_quality, op2_simhash, op3_personal_data, op4_substring_dedup, op5_minhash, op6_mixing, op7_token_files, op8_toxicity, op9_packing, op10_language_model)}

#: DuckDB SQL by query, where SQL can express it on whole tables.
ORACLES: dict[str, str] = {}
