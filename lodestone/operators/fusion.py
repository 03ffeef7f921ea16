"""Fusion of ranked lists (query_id, list_no, doc_id, score, rank, weight)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def each_list():
    return Window.partitionBy("query_id", "list_no")


def minmax(score: Column, window=None) -> Column:
    window = window or each_list()
    low, high = F.min(score).over(window), F.max(score).over(window)
    return F.when(high == low, 1.0).otherwise((score - low) / (high - low))


def three_sigma(score: Column, window=None) -> Column:
    """Score between mean - 3 sigma and mean + 3 sigma, clipped to 0..1."""
    window = window or each_list()
    mean, sigma = F.avg(score).over(window), F.stddev_pop(score).over(window)
    sigma = F.when(sigma == 0, 1e-9).otherwise(sigma)
    return F.least(F.lit(1.0), F.greatest(F.lit(0.0), (score - (mean - 3.0 * sigma)) / (6.0 * sigma)))


def fuse(lists: DataFrame, how: str = "rsf", k: int = 60) -> DataFrame:
    """(query_id, doc_id, fused); how: rsf (min-max), rrf (ranks) or dbsf (three sigma).  Lists of weight 0 add nothing."""
    if how == "rrf":
        part = F.col("weight") / (k + F.col("rank"))
        rows = lists.where("weight <> 0").withColumn("part", part)
    else:
        norm = minmax(F.col("score")) if how == "rsf" else three_sigma(F.col("score"))
        rows = lists.where("weight <> 0").withColumn("part", F.col("weight") * norm)
    return rows.groupBy("query_id", "doc_id").agg(F.sum("part").alias("fused"))


def list_weight(kind: Column, role: Column, hybrid: Column, lexical: float = 1.5, expansion: float = 0.7) -> Column:
    """Weight of a list: vector 1, related .85, expansion as given, pseudo-document .6; lexical 1 for the query itself, else .7."""
    vector = F.when(role == "primary", 1.0).when(role == "related", 0.85).when(role == "pseudo", 0.6).otherwise(expansion)
    words = F.when(role == "primary", 1.0).otherwise(0.7) * F.when(hybrid, lexical).otherwise(1.0)
    return F.when(kind == "vector", vector).otherwise(words)
