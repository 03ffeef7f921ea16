"""Event-time operators: the same functions take batch and streaming DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def timed(events: DataFrame, ts: str = "ts") -> DataFrame:
    """ts with a zone, as watermarks need."""
    return events.withColumn(ts, F.col(ts).cast("timestamp"))


def usage_windows(events: DataFrame, size: str = "1 hour", slide: str | None = None, late: str | None = None) -> DataFrame:
    """Calls and value by window and type; late: watermark of streams."""
    rows = timed(events)
    rows = rows.withWatermark("ts", late) if late else rows
    w = F.window("ts", size, slide) if slide else F.window("ts", size)
    got = rows.groupBy(w.alias("w"), "event_type").agg(F.count("*").alias("calls"), F.sum("value").alias("value"))
    return got.select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), "event_type", "calls", "value")


def sessions(events: DataFrame, gap: str = "30 minutes", late: str | None = None) -> DataFrame:
    """Idle-gap sessions of each user."""
    rows = timed(events)
    rows = rows.withWatermark("ts", late) if late else rows
    got = rows.groupBy(F.session_window("ts", gap).alias("w"), "user_id").agg(F.count("*").alias("calls"))
    return got.select("user_id", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "calls")


def negative_cache(failures: DataFrame, ttl: int = 15, key: str = "user_id") -> DataFrame:
    """Failures that reach the network: a remembered failure answers for ttl seconds from when it was met, and is not renewed.

    Each key's failures are folded in order over sorted partitions, so a task
    holds one time and no group.  Null keys are one key, ties go by event_id.
    """
    rows = timed(failures)
    sorted_rows = rows.repartition(key).sortWithinPartitions(key, "ts", "event_id")

    def run(batches):
        import pyarrow as pa
        import pyarrow.compute as pc

        now, until = object(), 0
        for batch in batches:
            keep = []
            for k, t in zip(batch.column(key).to_pylist(), pc.cast(batch.column("ts"), pa.int64()).to_pylist()):
                if k != now or t >= until:
                    now, until = k, t + ttl * 1_000_000
                    keep.append(True)
                else:
                    keep.append(False)
            yield batch.filter(pa.array(keep, pa.bool_()))

    return sorted_rows.mapInArrow(run, rows.schema)


def negative_cache_stream(failures: DataFrame, ttl: str = "15 seconds", key: str = "user_id") -> DataFrame:
    return timed(failures).withWatermark("ts", ttl).dropDuplicatesWithinWatermark([key])


def single_flight(calls: DataFrame, keys: list[str], ts: str = "ts") -> DataFrame:
    """calls with `leader`: the least event of those with equal keys and time, whose result the others share."""
    lead = calls.groupBy(*keys, ts).agg(F.min("event_id").alias("leader"))
    return calls.join(lead, [*keys, ts])


def cooled_down(events: DataFrame, trigger, seconds: int, key: str = "user_id") -> DataFrame:
    """Events that no trigger of their key within so many seconds before them holds up."""
    w = Window.partitionBy(key).orderBy("ts", "event_id").rowsBetween(Window.unboundedPreceding, -1)
    rows = timed(events).withColumn("_last", F.max(F.when(trigger, F.unix_micros("ts"))).over(w))
    return rows.where(F.col("_last").isNull() | (F.unix_micros("ts") - F.col("_last") >= seconds * 1_000_000)).drop("_last")


def retry_delays(attempts: DataFrame, base_ms: int = 500, most_ms: int = 8000) -> DataFrame:
    """attempts (attempt from 1, jitter of 0 to 1, retry_after_s): doubling delays, times .5 to 1.5, at least what the server asks, at most most_ms."""
    backoff = base_ms * F.pow(F.lit(2.0), F.col("attempt") - 1) * (0.5 + F.col("jitter"))
    return attempts.withColumn("delay_ms", F.least(F.lit(float(most_ms)), F.greatest(backoff, F.coalesce(F.col("retry_after_s") * 1000.0, F.lit(0.0)))))


def live_sessions(listing: DataFrame, now: str, ttl_s: int, most: int) -> DataFrame:
    """Of sessions (user_id, last_used, ...) those used within the time to live, the latest `most` of them."""
    rows = listing.where(F.unix_timestamp(F.lit(now).cast("timestamp")) - F.unix_timestamp(F.col("last_used").cast("timestamp")) <= ttl_s)
    return rows.orderBy(F.desc("last_used"), "user_id").limit(most)


def host_intervals(fetches: DataFrame, least_ms: int = 500, key: str = "event_type") -> DataFrame:
    """Fetches that came sooner after the one before on their host than politeness allows."""
    w = Window.partitionBy(key).orderBy("ts", "event_id")
    rows = timed(fetches).withColumn("wait_ms", (F.unix_micros("ts") - F.unix_micros(F.lag("ts").over(w))) / 1000)
    return rows.where(F.col("wait_ms") < least_ms)


def session_listing(events: DataFrame) -> DataFrame:
    """Sessions by key: entries and last use."""
    return timed(events).groupBy("user_id").agg(F.count("*").alias("entries"), F.max("ts").alias("last_used"))


def late_rows(events: DataFrame, deadline: str) -> tuple[DataFrame, DataFrame]:
    """(in time, late) by a deadline."""
    rows = timed(events)
    return rows.where(F.col("ts") <= F.lit(deadline).cast("timestamp")), rows.where(F.col("ts") > F.lit(deadline).cast("timestamp"))


def ingest(stream: DataFrame, write, checkpoint: str):
    """Run write(batch DataFrame, epoch) for each micro-batch of what is there now."""
    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def expired_sessions(events: DataFrame, ttl: str = "30 minutes") -> DataFrame:
    """Streaming sessions whose idle time ran out, with their calls, by keyed state with an event-time timeout."""
    import pandas as pd
    from pyspark.sql.streaming.state import GroupStateTimeout

    seconds = int(pd.Timedelta(ttl).total_seconds())

    def step(key, batches, state):
        calls, last = state.get if state.exists else (0, 0)
        if state.hasTimedOut:
            state.remove()
            yield pd.DataFrame({"user_id": [key[0]], "calls": [calls], "last_ms": [last]})
            return
        for pdf in batches:
            calls += len(pdf)
            last = max(last, int(pdf["ts"].max().timestamp() * 1000))
        state.update((calls, last))
        state.setTimeoutTimestamp(max(last + seconds * 1000, state.getCurrentWatermarkMs() + 1))

    rows = timed(events).select("user_id", "ts").withWatermark("ts", "10 minutes")
    return rows.groupBy("user_id").applyInPandasWithState(step, "user_id long, calls long, last_ms long", "calls long, last_ms long", "append", GroupStateTimeout.EventTimeTimeout)
