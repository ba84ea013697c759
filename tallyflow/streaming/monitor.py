"""What a running query does: a trace of watermarks, rows and state for each batch, and the delay until results are final."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQueryListener


class Trace(StreamingQueryListener):
    """Keeps a row for each batch: query, batch, rows, watermark, state_rows, milliseconds. Use as a context around queries."""

    def __init__(self, spark: SparkSession):
        self.spark, self.rows = spark, []

    def __enter__(self) -> Trace:
        self.spark.streams.addListener(self)
        return self

    def __exit__(self, *_) -> None:
        self.spark.streams.removeListener(self)

    def onQueryStarted(self, event) -> None:  # noqa: N802
        pass

    def onQueryIdle(self, event) -> None:  # noqa: N802
        pass

    def onQueryTerminated(self, event) -> None:  # noqa: N802
        pass

    def onQueryProgress(self, event) -> None:  # noqa: N802
        p = event.progress
        took = dict(p.durationMs).get("triggerExecution", 0)
        self.rows.append((str(p.id), p.batchId, p.numInputRows, dict(p.eventTime).get("watermark"), sum(s.numRowsTotal for s in p.stateOperators), took))

    def frame(self) -> DataFrame:
        return self.spark.createDataFrame(self.rows, "query string, batch bigint, rows bigint, watermark string, state_rows bigint, milliseconds bigint")


def finality_delay(outputs: DataFrame, batches: DataFrame, ts: str = "ts_ms") -> DataFrame:
    """For each output time, how far event time had gone on when the first batch saw a watermark at or after it: null while none has.

    batches: (batch, watermark, latest). The watermarks are met by time in slots of an hour's as-of look-up, as both are ordered.
    """
    from pyspark.sql import Window

    times = outputs.select(F.col(ts).alias("at"), F.lit(None).cast("bigint").alias("latest"), F.lit(0).alias("kind")).distinct()
    marks = batches.groupBy(F.col("watermark").alias("at")).agg(F.min("latest").alias("latest")).withColumn("kind", F.lit(1))
    order = Window.orderBy("at", "kind").rowsBetween(0, Window.unboundedFollowing)  # a row for each time and batch
    seen = times.unionByName(marks).withColumn("latest", F.first("latest", ignorenulls=True).over(order)).where("kind = 0")
    return seen.select(F.col("at").alias(ts), (F.col("latest") - F.col("at")).alias("delay"))
