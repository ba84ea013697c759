"""Answers that know how final they are: what lies at or before the watermark is final, what lies after it is provisional."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyflow.operators.index import TemporalIndex


@dataclass(frozen=True)
class TwoTier:
    """base: final outputs (ts_ms, c0..); delta: outputs after the watermark. Both are small appends or large tables alike."""

    base: DataFrame
    delta: DataFrame
    channels: int
    watermark: int
    late: DataFrame | None = None

    @staticmethod
    def empty(outputs: DataFrame, channels: int, watermark: int = -(1 << 62)) -> TwoTier:
        names = ["ts_ms", *[f"c{i}" for i in range(channels)]]
        none = outputs.select(names).limit(0)
        return TwoTier(none, none, channels, watermark, none)

    def add(self, outputs: DataFrame) -> TwoTier:
        """Takes outputs in; those at or before the watermark are late: kept apart and counted, not indexed."""
        rows = outputs.select(self.delta.columns)
        late = rows.where(F.col("ts_ms") <= self.watermark)
        return replace(self, delta=self.delta.unionByName(rows.where(F.col("ts_ms") > self.watermark)), late=late if self.late is None else self.late.unionByName(late))

    def advance(self, watermark: int) -> TwoTier:
        """Moves what the watermark has passed to the base. A watermark that doesn't rise changes nothing."""
        if watermark <= self.watermark:
            return self
        ready = F.col("ts_ms") <= watermark
        return replace(self, base=self.base.unionByName(self.delta.where(ready)), delta=self.delta.where(~ready), watermark=watermark)

    def answer(self, queries: DataFrame) -> DataFrame:
        """For each of queries (query_id, lo, hi): counters, n, is_defined, and is_final if hi is not after the watermark. The base is
        asked through its running sums, the delta too; their sums are added."""
        names = [*[f"c{i}" for i in range(self.channels)], "n"]
        parts = [TemporalIndex.build(x, self.channels).answer(queries) for x in (self.base, self.delta)]
        both = parts[0].unionByName(parts[1]).groupBy("query_id", "lo", "hi").agg(*[F.sum(c).alias(c) for c in names])
        return both.withColumns({"is_defined": F.col("n") > 0, "is_final": F.col("hi") <= F.lit(self.watermark)})

    def n_late(self) -> int:
        return 0 if self.late is None else self.late.count()


def sharded_answer(outputs: DataFrame, watermarks: DataFrame, queries: DataFrame, channels: int) -> DataFrame:
    """outputs (shard, ts_ms, c0..) over shards whose watermarks (shard, watermark) differ: counters are summed over the shards, an
    answer is defined if any shard has outputs, and final if hi is not after the frontier, the lowest watermark."""
    found = TemporalIndex.build(outputs, channels).answer(queries)
    frontier = watermarks.agg(F.min("watermark").alias("frontier"))
    return found.join(F.broadcast(frontier)).withColumn("is_final", F.col("hi") <= F.col("frontier")).drop("frontier")  # one row
