"""The harness: late and skewed arrival of ordered inputs, as columns; and replay of them as files, a batch each."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyflow.functions.hashing import line_hash
from tallyflow.functions.time import DAY, floor_to


def numbered(df: DataFrame, ts: str, ties: list[str]) -> DataFrame:
    """Adds line, 0 .. in order of ts, then ties: rows are numbered within their day, and days start where the ones before end."""
    rows = df.withColumn("__day", floor_to(F.col(ts), DAY))
    before = Window.orderBy("__day").rowsBetween(Window.unboundedPreceding, -1)  # over one row a day
    base = rows.groupBy("__day").count().select("__day", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("__base"))
    inner = F.row_number().over(Window.partitionBy("__day").orderBy(ts, *ties))
    return rows.withColumn("__n", inner).join(base, "__day").withColumn("line", F.col("__base") + F.col("__n") - 1).drop("__day", "__n", "__base")


def reader_of(line: Column, readers: int) -> Column:
    """Which of several readers takes a line."""
    return F.pmod(line, F.lit(readers)).cast("int")


def delay(line: Column, most_ms: int, seed: int) -> Column:
    """0 .. most_ms from the line alone."""

    @F.pandas_udf(T.LongType())
    def of(x: pd.Series) -> pd.Series:
        return pd.Series(((line_hash(x.to_numpy(), seed) >> np.uint64(1)) % np.uint64(most_ms + 1)).astype(np.int64))

    return of(line)


def disordered(df: DataFrame, line: Column, most_ms: int, seed: int, ts: str = "ts_ms") -> DataFrame:
    """Adds arrival: the event time plus the line's delay. Event times stay."""
    return df.withColumn("arrival", F.col(ts) + delay(line, most_ms, seed))


def slowed(df: DataFrame, reader: Column, slow: int, factor: int, arrival: str = "arrival") -> DataFrame:
    """One reader's rows arrive factor times as late after the first arrival."""
    first = df.agg(F.min(arrival).alias("__f"))
    late = F.col("__f") + (F.col(arrival) - F.col("__f")) * factor
    return df.join(F.broadcast(first)).withColumn(arrival, F.when(reader == slow, late).otherwise(F.col(arrival))).drop("__f")  # one row


def zipf_rank(line: Column, n: int, exponent: float, seed: int, salt: int = 0) -> Column:
    """A rank 0 .. n-1 with odds 1 / (rank + 1) ** exponent, from the line alone: its hash inverts the summed odds."""
    sums = np.cumsum(1 / np.arange(1, n + 1) ** exponent)
    sums /= sums[-1]

    @F.pandas_udf(T.IntegerType())
    def of(x: pd.Series) -> pd.Series:
        u = (line_hash(x.to_numpy(), seed, salt) >> np.uint64(11)) * 2.0**-53
        return pd.Series(np.minimum(np.searchsorted(sums, u), n - 1).astype(np.int32))

    return of(line)


def batches(df: DataFrame, size: int, ties: list[str], arrival: str = "arrival") -> DataFrame:
    """Adds batch: the rows in order of arrival, `size` to a batch."""
    return numbered(df, arrival, ties).withColumn("batch", F.floor(F.col("line") / size).cast("bigint")).drop("line")


def replay(df: DataFrame, folder: str, batch: str = "batch") -> int:
    """Writes a file for each batch, in order, for a stream that takes one file at a time; returns how many."""
    n = (df.agg(F.max(batch)).first()[0] or 0) + 1
    for i in range(n):
        df.where(F.col(batch) == i).drop(batch).coalesce(1).write.mode("append").parquet(folder)
    return n
