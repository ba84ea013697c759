"""Samples that don't depend on order or partitioning, digests, output ids, and what live state holds over time."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyflow.functions import algebra
from tallyflow.functions.hashing import coin, fnv1a64, splitmix64, unsigned_order


def bernoulli(df: DataFrame, key: Column, probability: float) -> DataFrame:
    """The rows whose key's hash falls under the probability: a key is in or out wherever it occurs."""
    return df.where(coin(fnv1a64(key.cast("string")), probability))


def bottom_k(df: DataFrame, id_col: str, k: int, seed: int) -> DataFrame:
    """The k distinct ids of least seeded hash; samples of parts can be merged by taking the bottom k again."""
    rank = unsigned_order(splitmix64(F.col(id_col).bitwiseXOR(F.lit(seed))))
    return df.select(id_col).distinct().orderBy(rank, unsigned_order(F.col(id_col))).limit(k)


def sampled_answers(flow, key: Column, probability: float, vector: bool = True) -> DataFrame:
    """How much each channel contributed to the outputs whose key's hash falls under the probability: c0.., or their total."""
    some = flow.where(coin(fnv1a64(key.cast("string")), probability))
    if vector:
        return some.dense()
    return some.df.withColumn("total", algebra.total(some.counters())).drop(*some.marks)


def captured(df: DataFrame, manifest: DataFrame, id_col: str) -> DataFrame:
    """The first row of each id of the manifest, first by content (the least in its columns) and not by arrival, which no run repeats."""
    rest = [c for c in df.columns if c != id_col]
    found = df.join(manifest.select(id_col), id_col, "left_semi")
    return found.groupBy(id_col).agg(F.min(F.struct(*rest)).alias("__r")).select(id_col, "__r.*")


def digests(df: DataFrame, ts: str, cols: list[str]) -> DataFrame:
    """For each time: rows, and two digests that don't depend on the rows' order."""
    h = F.xxhash64(*cols)
    return df.groupBy(ts).agg(F.count(F.lit(1)).alias("n"), F.sum(h.cast("decimal(38,0)")).cast("string").alias("total"), F.bit_xor(h).alias("parity"))


def output_ids(df: DataFrame, operator: str, ts: str, key: str, cols: list[str]) -> DataFrame:
    """Operator, time, key and ordinal identify an output whatever run wrote it; row_hash is FNV-1a of its columns joined by commas."""
    body = F.concat_ws(",", *[F.col(c).cast("string") for c in cols])
    order = Window.partitionBy(ts, key).orderBy(*cols)
    return df.select(F.lit(operator).alias("operator"), F.col(ts).alias("window_end"), F.col(key).alias("key"), (F.row_number().over(order) - 1).cast("bigint").alias("ordinal"), fnv1a64(body).alias("row_hash"))


def deduplicated(log: DataFrame) -> DataFrame:
    """A log that several attempts appended to, each output once."""
    return log.dropDuplicates(["operator", "window_end", "key", "ordinal"])


def cardinality(df: DataFrame) -> DataFrame:
    return df.agg(F.count(F.lit(1)).alias("n"))


def live_state(df: DataFrame, ts: str, keys: list[str], size: int, slide: int, width: int) -> DataFrame:
    """Bytes of annotation held by open windows after each change in event time, and the most at once so far (peak): a window holds `width` bytes
    from its first row until its end. Changes are summed per time, then per day, so the running sum takes two steps."""
    from tallyflow.functions.time import DAY, floor_to, window_starts

    open_ = df.withColumn("__w", F.explode(window_starts(F.col(ts), size, slide))).groupBy("__w", *keys).agg(F.min(ts).alias("at"))
    changes = open_.select(F.explode(F.array(F.struct(F.col("at"), F.lit(width).alias("d")), F.struct((F.col("__w") + size).alias("at"), F.lit(-width).alias("d")))).alias("x")).select("x.*")
    each = changes.groupBy("at").agg(F.sum("d").alias("d")).withColumn("day", floor_to(F.col("at"), DAY))
    earlier = Window.orderBy("day").rowsBetween(Window.unboundedPreceding, -1)  # over a row a day
    inner = Window.partitionBy("day").orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
    runs = each.withColumn("run", F.sum("d").over(inner))
    days = runs.groupBy("day").agg(F.sum("d").alias("s"), F.max("run").alias("top")).withColumn("base", F.coalesce(F.sum("s").over(earlier), F.lit(0)))
    base = days.select("day", "base", F.max(F.col("base") + F.col("top")).over(earlier).alias("before"))
    now = F.col("run") + F.col("base")
    held = runs.join(base, "day")
    return held.select("at", now.cast("bigint").alias("bytes"), F.greatest(F.max(now).over(inner), "before").cast("bigint").alias("peak"))


def memory_model(counts: DataFrame, channels: int) -> DataFrame:
    """From (outputs, pairs, contributors): bytes of each way to keep annotations: M numbers an output; 12 bytes a sparse pair; 12 bytes a variable;
    32 bytes a graph node."""
    return counts.select(
        (F.col("outputs") * channels * 8).alias("counters"), (F.col("pairs") * 12).alias("sparse"), (F.col("contributors") * 12).alias("polynomial"), (F.col("contributors") * 32).alias("graph")
    )
