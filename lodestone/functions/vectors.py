"""Vector expressions over array<float>; sums are in double."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import ship


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a.cast("array<double>"), b.cast("array<double>"), lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    d = norm(a) * norm(b)
    return F.when(d == 0, 0.0).otherwise(dot(a, b) / d)


def l2_normalize(a: Column) -> Column:
    n = norm(a)
    return F.when((n == 0) | (F.abs(n - 1) < 1e-6), a.cast("array<double>")).otherwise(F.transform(a, lambda x: x.cast("double") / n))


def combine(a: Column, b: Column, weight_a: float, weight_b: float) -> Column:
    return l2_normalize(F.zip_with(a.cast("array<double>"), b.cast("array<double>"), lambda x, y: x * weight_a + y * weight_b))


def truncate(a: Column, dims: int) -> Column:
    return l2_normalize(F.slice(a, 1, dims).cast("array<double>"))


#: Vectors of a block.
BLOCK = 2048


def blocks(rows: DataFrame, id_col: str, vector: str, tag: str | None = None) -> DataFrame:
    """(ids, tags, data, n): vectors packed as matrices of at most BLOCK rows; null vectors go."""
    ship()
    own = rows.where(F.col(vector).isNotNull()).select(F.col(id_col).cast("long").alias("id"), (F.col(tag).cast("long") if tag else F.lit(0).cast("long")).alias("tag"), F.col(vector).cast("array<float>").alias("v"))

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            for at in range(0, batch.num_rows, BLOCK):
                part = batch.slice(at, BLOCK)
                data = part.column("v").flatten().to_numpy(zero_copy_only=False).astype("<f4")
                yield pa.RecordBatch.from_arrays([pa.array([part.column(c).to_pylist()], pa.list_(pa.int64())) for c in ("id", "tag")] + [pa.array([data.tobytes()], pa.binary()), pa.array([part.num_rows], pa.int32())], ["ids", "tags", "data", "n"])

    return own.mapInArrow(run, "ids array<long>, tags array<long>, data binary, n int")


def nearest(base: DataFrame, queries: DataFrame, k: int, parts: int = 16, same_tag: bool = False, digits: int = 6) -> DataFrame:
    """(query_id, doc_id, score, rank): the exact k best rows of base for each query by dot product, itself left out; ties by id.

    Both come as blocks().  Base blocks are dealt to parts and every query block
    visits each part once, by an equi-join; a block pair is one matrix product
    of which k rows for each query go on.
    """
    own = base.withColumn("part", F.pmod(F.xxhash64("ids"), F.lit(parts)))
    asked = queries.select(F.col("ids").alias("q_ids"), F.col("tags").alias("q_tags"), F.col("data").alias("q_data"), F.col("n").alias("q_n")).withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1)).cast("array<long>")))

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            for r in batch.to_pylist():
                a, q = (np.frombuffer(r[c], "<f4").reshape(r[m], -1).astype(np.float64) for c, m in (("data", "n"), ("q_data", "q_n")))
                ids, q_ids = np.array(r["ids"], np.int64), np.array(r["q_ids"], np.int64)
                scores = np.round(q @ a.T, digits)
                scores[q_ids[:, None] == ids[None, :]] = -np.inf
                if same_tag:
                    scores[np.array(r["q_tags"])[:, None] != np.array(r["tags"])[None, :]] = -np.inf
                order = np.lexsort((np.broadcast_to(ids, scores.shape), -scores), axis=1)[:, :k]
                best = np.take_along_axis(scores, order, axis=1)
                at = np.isfinite(best)
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(q_ids, order.shape[1]).reshape(order.shape)[at]), pa.array(ids[order][at]), pa.array(best[at])], ["query_id", "doc_id", "score"])

    pairs = own.join(asked, "part").select("ids", "tags", "data", "n", "q_ids", "q_tags", "q_data", "q_n")
    found = pairs.mapInArrow(run, "query_id long, doc_id long, score double")
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "doc_id")
    return found.withColumn("rank", F.row_number().over(w).cast("long")).where(F.col("rank") <= k)
