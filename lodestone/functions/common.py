"""Expressions that other modules build on."""

from __future__ import annotations

import os
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def ship() -> None:
    """Let Python workers import this package wherever the driver was started."""
    spark = SparkSession.getActiveSession()
    if spark is not None:
        root, env = str(Path(__file__).resolve().parents[2]), spark.sparkContext.environment
        paths = [p for p in env.get("PYTHONPATH", "").split(os.pathsep) if p]
        if root not in paths:
            env["PYTHONPATH"] = os.pathsep.join([root, *paths])


def let(value: Column, body) -> Column:
    """body(value), with value computed once for each row.

    Plain reuse of an expression may be inlined by the optimizer, which inside a
    lambda means once for each element.
    """
    return F.transform(F.array(value), body)[0]


def runs(sizes, most: int):
    """(begin, end) of runs of rows whose sizes come to at most `most`; a row that has more stands alone."""
    begin = total = 0
    for i, n in enumerate(sizes):
        if i > begin and total + n > most:
            yield begin, i
            begin, total = i, 0
        total += n
    if len(sizes):
        yield begin, len(sizes)


#: Bytes of text whose Python objects a worker holds at once.
HELD = 1 << 20


def in_runs(column, convert):
    """An Arrow array made of text, converted run by run: what Python holds does not grow with the batch."""
    import pyarrow as pa
    import pyarrow.compute as pc

    sizes = pc.fill_null(pc.binary_length(column), 0).to_pylist()
    done = [convert(column.slice(a, b - a).to_pylist()) for a, b in runs(sizes, HELD)]
    return pa.concat_arrays(done or [convert([])])


def settled(df: DataFrame) -> DataFrame:
    """df computed once for several readers: a checkpoint where the session names a folder for them, else kept by the executors."""
    spark = df.sparkSession
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not spark.sparkContext._jsc.sc().getCheckpointDir().isDefined():
        if not base:
            return df.persist()
        spark.sparkContext.setCheckpointDir(base)
    return df.checkpoint()
