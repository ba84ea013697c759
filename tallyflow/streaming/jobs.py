"""Streams: event-time windows with watermarks, chained into joins; replay with flush; records that came too late; acks."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tallyflow.functions.time import floor_to


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder in the shared one of spark.checkpoint.dir, or in a local one where that is unset and all runs on one machine."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root is None:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        root = f"file://{tempfile.gettempdir()}"
    return f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def counted(stream: DataFrame, key: str, marks: list[str], size: str, slide: str) -> DataFrame:
    """ts, key, n and the sums of marks for each window; ts is the window's time, so windows can follow windows."""
    grouped = stream.groupBy(F.window("ts", size, slide).alias("w"), key).agg(F.count(F.lit(1)).alias("n"), *[F.sum(m).alias(m) for m in marks])
    return grouped.select(F.window_time("w").alias("ts"), key, "n", *marks)


def count_join(solo: DataFrame, crowded: DataFrame, key: str, marks: list[str], size: str, slide: str) -> DataFrame:
    """taxi_1 on streams with watermarks: windowed counts of both branches, filtered, put into windows again and joined."""

    def side(df: DataFrame, condition: Column, name: str) -> DataFrame:
        rows = counted(df, key, marks, size, slide).where(condition)
        return rows.select(F.window("ts", size, slide).alias("w"), key, F.col("n").alias(name), *[F.col(m).alias(f"{name}_{m}") for m in marks])

    left, right = side(solo, F.col("n") == 1, "solo_count"), side(crowded, F.col("n") >= 2, "crowded_count")
    both = left.join(right, ["w", key])
    sums = [(F.col(f"solo_count_{m}") + F.col(f"crowded_count_{m}")).alias(m) for m in marks]
    return both.select((F.unix_millis("w.end") - 1).alias("ts_ms"), key, "solo_count", "crowded_count", *sums)


def replayed(spark: SparkSession, batches: DataFrame, sentinel: Callable[[int], DataFrame], delay: str, ts: str = "ts_ms") -> DataFrame:
    """A stream that takes the batches (column batch) one at a time, then two sentinels: Spark does not end windows at the end of
    input, so rows far in the future move the watermark past all others. Windows that hold sentinels never end."""
    folder = shared_folder(spark, "replay")
    n = (batches.agg(F.max("batch")).first()[0] or 0) + 1
    body = batches.drop("batch")
    for i in range(n):
        batches.where(F.col("batch") == i).drop("batch").coalesce(1).write.mode("append").parquet(folder)
    for i in range(2):
        sentinel(i).select(body.columns).coalesce(1).write.mode("append").parquet(folder)
    stream = spark.readStream.schema(body.schema).option("maxFilesPerTrigger", 1).option("latestFirst", "false").parquet(folder)
    return stream.withColumn("ts", F.timestamp_millis(ts)).withWatermark("ts", delay)


def collected(stream: DataFrame, name: str, checkpoint: str | None = None, out: str | None = None) -> DataFrame:
    """Runs the stream over all there is, exactly once into files of the shared folder, and reads them. A run that stopped goes on
    from its checkpoint when it is called with the same folders."""
    spark = stream.sparkSession
    out, checkpoint = out or shared_folder(spark, name), checkpoint or shared_folder(spark, f"{name}-checkpoint")
    query = stream.writeStream.format("parquet").option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start(out)
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(out)


def lateness(batches: DataFrame, size: int, slide: int, delay: int, ts: str = "ts_ms") -> DataFrame:
    """For each record of a replay: missed, how many of its windows had ended when its batch began, and late, whether all had.

    A batch sees the watermark that the batches before it left: their latest time less the delay. Windows end at or before it.
    """
    highest = batches.groupBy("batch").agg(F.max(ts).alias("__m"))  # a row a batch
    before = F.max("__m").over(Window.orderBy("batch").rowsBetween(Window.unboundedPreceding, -1)) - delay
    marks = highest.select("batch", before.alias("watermark"))
    last = floor_to(F.col(ts), slide)
    starts = F.sequence(F.lit(0), F.lit(size // slide - 1))
    ended = F.size(F.filter(starts, lambda k: last - k * slide + size <= F.col("watermark")))
    rows = batches.join(F.broadcast(marks), "batch").withColumn("missed", F.when(F.col("watermark").isNull(), 0).otherwise(ended).cast("bigint"))
    return rows.withColumn("late", F.col("missed") == size // slide)


def late_counts(batches: DataFrame, size: int, slide: int, delay: int, ts: str = "ts_ms") -> DataFrame:
    """Records that missed all their windows, and records that missed some, each counted once."""
    rows = lateness(batches, size, slide, delay, ts)
    n = lambda c: F.count_if(c)
    return rows.agg(F.count(F.lit(1)).alias("records"), n(F.col("late")).alias("late"), n((F.col("missed") > 0) & ~F.col("late")).alias("partly_missed"))


def source_acks(pairs: DataFrame, max_delay_ms: int) -> DataFrame:
    """From a stream of (ts, source): each source once, as SOURCE when first seen and as ACK when the watermark has passed its time
    by max_delay. State is one flag a source, kept until its timer."""

    def step(key: tuple, rows: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            yield pd.DataFrame({"kind": ["ACK"], "source": [key[0]]})
            return
        latest = max(int(x["ts"].max().timestamp() * 1000) for x in rows)
        if not state.exists:
            state.update((latest,))
            yield pd.DataFrame({"kind": ["SOURCE"], "source": [key[0]]})
        at = max(latest + max_delay_ms, state.getCurrentWatermarkMs() + 1)
        state.setTimeoutTimestamp(at)

    return pairs.groupBy("source").applyInPandasWithState(step, "kind string, source bigint", "latest bigint", "append", "EventTimeTimeout")


def index_sink(path: str, channels: int) -> Callable[[DataFrame, int], None]:
    """For foreachBatch: appends the batch's sums as a segment that a replayed batch overwrites."""

    def write(batch: DataFrame, batch_id: int) -> None:
        names = [f"c{i}" for i in range(channels)]
        sums = batch.groupBy("ts_ms").agg(*[F.sum(c).alias(c) for c in names], F.count(F.lit(1)).alias("n"))
        sums.write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    return write
