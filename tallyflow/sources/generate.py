"""Deterministic synthetic inputs: each value is a hash of the row's number, so any partitioning gives the same rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def draw(seed: int, salt: int, n: int) -> Column:
    """0 .. n-1 from the row's id."""
    return F.pmod(F.xxhash64("id", F.lit(seed), F.lit(salt)), F.lit(n))


def synthetic(spark: SparkSession, rows: int, seed: int = 42, step_ms: int = 1) -> DataFrame:
    return spark.range(rows).select("id", (F.col("id") * step_ms).alias("ts_ms"), draw(seed, 1, 128).cast("int").alias("source_id"), draw(seed, 2, 1000).cast("int").alias("key"), (draw(seed, 3, 100) + 1).alias("value"))


def persons(spark: SparkSession, rows: int, span_ms: int, seed: int = 42) -> DataFrame:
    state = F.element_at(F.array(*map(F.lit, ("OR", "ID", "CA", "WA", "NV", "AZ"))), (draw(seed, 2, 6) + 1).cast("int"))
    ts = F.floor(F.col("id") * (span_ms / max(1, rows))).cast("bigint") * 2
    return spark.range(rows).select(F.col("id").alias("person_id"), ts.alias("ts_ms"), F.concat(F.lit("name"), "id").alias("name"), F.concat(F.lit("city"), draw(seed, 3, 50)).alias("city"), state.alias("state"))


def auctions(spark: SparkSession, rows: int, n_persons: int, span_ms: int, seed: int = 42) -> DataFrame:
    """About three in five sellers are persons that exist."""
    seller = F.when(draw(seed, 4, 10) < 6, draw(seed, 5, n_persons)).otherwise(n_persons + draw(seed, 6, n_persons))
    ts = F.floor(F.col("id") * (span_ms / max(1, rows))).cast("bigint") * 2 + 1
    return spark.range(rows).select(F.col("id").alias("auction_id"), ts.alias("ts_ms"), seller.alias("seller_id"), (draw(seed, 7, 15) + 1).cast("int").alias("category"), F.concat(F.lit("item"), "id").alias("item_name"))


def sinks_with_sources(spark: SparkSession, rows: int, each: int, overlap: int) -> DataFrame:
    """Outputs (id, ts_ms, src) with `each` sources, of which consecutive outputs share `overlap`."""
    first = F.col("id") * (each - overlap)
    return spark.range(rows).select("id", F.col("id").alias("ts_ms"), F.sequence(first, first + (each - 1)).alias("src"))


def repeated(df: DataFrame, times: int, ts: str = "ts_ms", id_col: str | None = None) -> DataFrame:
    """The table played `times` times, each later by its whole span; ids shift by as many rows."""
    span = df.agg(F.max(ts).alias("__m"), F.count(F.lit(1)).alias("__n"))
    out = df.join(F.broadcast(span)).withColumn("__r", F.explode(F.sequence(F.lit(0), F.lit(times - 1))))  # one row
    out = out.withColumn(ts, F.col(ts) + F.col("__r") * (F.col("__m") + 1))
    if id_col:
        out = out.withColumn(id_col, F.col(id_col) + F.col("__r") * F.col("__n"))
    return out.drop("__m", "__n", "__r")


def prefix(df: DataFrame, share: float, ts: str = "ts_ms") -> DataFrame:
    """The earliest share of the time span."""
    ends = df.agg(F.min(ts).alias("__a"), F.max(ts).alias("__b"))
    return df.join(F.broadcast(ends)).where(F.col(ts) < F.col("__a") + (F.col("__b") - F.col("__a") + 1) * share).drop("__a", "__b")  # one row


def taxi_rides(trips: DataFrame, fares: DataFrame) -> DataFrame:
    """Rides with their fares: repeated trips once, joined by taxi and time, with passengers and no negative amounts."""
    both = trips.dropDuplicates(["taxi_id", "ts_ms"]).join(fares.dropDuplicates(["taxi_id", "ts_ms"]), ["taxi_id", "ts_ms"])
    return both.where("passengers >= 1 and fare >= 0 and tip >= 0")
