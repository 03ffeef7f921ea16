"""Helpers that several training-data operators use."""

from __future__ import annotations

import os
import re
import tempfile
import uuid
from pathlib import Path

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Separators of words, `[\x20\x09-\x0D]`, as a Java regular expression.
SPACES = "[ \\t-\\r]+"


def reachable(spark: SparkSession) -> None:
    """Let Python workers import this package wherever the driver was started."""
    root, env = str(Path(__file__).resolve().parents[2]), spark.sparkContext.environment
    paths = [p for p in env.get("PYTHONPATH", "").split(os.pathsep) if p]
    if root not in paths:
        env["PYTHONPATH"] = os.pathsep.join([root, *paths])


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def texts(docs: DataFrame, *more: str) -> DataFrame:
    """(doc_id, text, *more) of a documents table: null text is empty, other columns go.

    Only the named columns are read, so extra columns of any name do no harm.
    """
    reachable(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"), *more)


def shared_dir(spark: SparkSession) -> str:
    """A fresh folder that driver and executors share.

    It lies in spark.checkpoint.dir.  Where the session names none a local run
    gets a temporary folder; a cluster, whose machines share none, an error.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        own = spark.sparkContext._jsc.sc().getCheckpointDir()
        base = own.get() if own.isDefined() else ""
        if not base:
            if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
                raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
            base = f"file://{tempfile.mkdtemp(prefix='lodestone-')}"
            spark.sparkContext.setCheckpointDir(base)
    return f"{base.rstrip('/')}/{uuid.uuid4().hex}"


def written(df: DataFrame, codec: str = "zstd") -> DataFrame:
    """df as a table in the shared folder: cuts the lineage, outlives executors."""
    spark = df.sparkSession
    path = shared_dir(spark)
    df.write.option("compression", codec).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def _folder(spark: SparkSession, path: str):
    own = spark._jvm.org.apache.hadoop.fs.Path(path)
    return own.getFileSystem(spark._jsc.hadoopConfiguration()), own


def files_of(spark: SparkSession, path: str) -> list[str]:
    """All files under a folder of any store; none if there is no such folder."""
    fs, own = _folder(spark, path)
    if not fs.exists(own):
        return []
    found, out = fs.listFiles(own, True), []
    while found.hasNext():
        out.append(found.next().getPath().toString())
    return out


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder of any store with all that is in it."""
    fs, own = _folder(spark, path)
    fs.delete(own, True)


def dropped(*tables: DataFrame) -> None:
    """Remove the files of tables that written() made and nobody reads any more."""
    for t in tables:
        for name in t.inputFiles()[:1]:
            remove(t.sparkSession, name.rpartition("/")[0])


def let(value: Column, body) -> Column:
    """body(value), with value computed once for each row."""
    return F.transform(F.array(value), body)[0]


def shuffle_width(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def slices(batch, column: str, most: int):
    """Runs of rows of an Arrow batch whose text has at most `most` bytes; a row that has more stands alone."""
    import pyarrow as pa
    import pyarrow.compute as pc

    if not batch.num_rows:
        return
    sizes = pc.fill_null(pc.binary_length(batch.column(column).cast(pa.large_binary())), 0).to_numpy(zero_copy_only=False)
    upto = np.cumsum(sizes)
    at = 0
    while at < batch.num_rows:
        before = upto[at - 1] if at else 0
        end = max(at + 1, int(np.searchsorted(upto, before + most, side="right")))
        yield batch.slice(at, end - at)
        at = end
