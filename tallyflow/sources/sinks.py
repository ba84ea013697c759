"""Sinks: files, counts, segments and logs of outputs, stores of provenance graphs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyflow.operators.sampling import deduplicated


def to_files(df: DataFrame, path: str) -> None:
    """A line of comma-separated values for each row."""
    df.write.mode("overwrite").csv(path)


def discard(df: DataFrame) -> dict[str, int]:
    """Runs the plan, keeps nothing, and says how many rows and bytes of annotation there were."""
    from pyspark.sql import Observation

    seen = Observation("discarded")
    marks = [c for c in df.columns if c.startswith("hm_")]
    df.observe(seen, F.count(F.lit(1)).alias("rows"), F.coalesce(F.sum(F.lit(8 * len(marks))), F.lit(0)).alias("annotation_bytes")).write.format("noop").mode("overwrite").save()
    return seen.get


def probe(df: DataFrame, name: str, width: int):
    """The same rows; what passed is in the second value once an action has run."""
    from pyspark.sql import Observation

    seen = Observation(name)
    return df.observe(seen, F.count(F.lit(1)).alias("rows"), F.coalesce(F.sum(F.lit(width)), F.lit(0)).alias("bytes")), seen


def append_segment(df: DataFrame, path: str, checkpoint: int) -> None:
    """An immutable segment for each checkpoint; writing one again replaces it, so a restart changes nothing."""
    df.write.mode("overwrite").parquet(f"{path}/checkpoint={checkpoint}")


def read_segments(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def append_log(ids: DataFrame, path: str) -> None:
    ids.write.mode("append").parquet(path)


def read_log(spark: SparkSession, path: str) -> DataFrame:
    return deduplicated(spark.read.parquet(path))


def to_jdbc(df: DataFrame, url: str, table: str, properties: dict[str, str] | None = None) -> None:
    """Appends to a database table; the driver's jar must be on the class path."""
    df.write.mode("append").jdbc(url, table, properties=properties or {})
