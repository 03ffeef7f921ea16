"""A cleaning pipeline over the documents table: each stage's rows are written and read by the next."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm import mixing, packing, personal_data, simhash, toxicity
from lodestone.llm.queries import fold
from lodestone.llm.shared import documents, written

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def _own(docs: DataFrame) -> DataFrame:
    """The columns of documents alone."""
    return docs.select(*COLUMNS)


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the pattern grammar scores under 0.5; it learns from the labelled rows that op8 may learn from."""
    lexicon = toxicity.fit_lexicon(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), train=fold("doc_id") != 0)
    return toxicity.drop_toxic(_own(docs), lexicon)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, the least id, of each group of near copies."""
    return simhash.keep_one_of_each(_own(docs))


def mask_identifiers(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, identifiers replaced by their kind; n_chars follows the new text."""
    masked = personal_data.mask_personal_data(_own(docs))
    return masked.withColumn("n_chars", F.when(F.col("text").isNull(), F.col("n_chars")).otherwise(F.length("text").cast("long"))).select(*COLUMNS)


def mix_domains(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents drawn by the rates that bring the domains to their target weights."""
    labelled = mixing.language_quality(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return mixing.keep_by_rate(_own(docs), labelled)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents in sequences of 1024 tokens."""
    return packing.pack(_own(docs))


STAGES = [
    ("toxicity", drop_toxic),
    ("simhash_near_dedup", drop_near_copies),
    ("personal_data", mask_identifiers),
    ("mixing", mix_domains),
    ("packing", pack_sequences),
]

#: SQL cannot express the learned stages; tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents."""
    docs = documents(spark, sf_dir)
    for name, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
        if name != STAGES[-1][0]:
            docs = written(docs)
    return docs
