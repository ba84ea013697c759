"""Provenance of rows: backward sets, (source, output) pairs, the forward graph with acks, its text forms and database queries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyflow.functions import algebra
from tallyflow.operators.flow import Flow


def backward(flow: Flow, name: str = "sources") -> DataFrame:
    """Each row with the set of sources that it came from (a graph flow)."""
    return flow.df.withColumn(name, algebra.backward(F.col("src"))).drop("src")


def unfold(flow: Flow, out_id: Column) -> DataFrame:
    """(sink, source) for each output and each of its sources, once."""
    return flow.df.select(out_id.alias("sink"), F.explode(F.array_distinct("src")).alias("source"))


def forward_graph(flow: Flow, out_id: Column, sources: DataFrame, source_id: str, source_ts: str, watermark: int, max_delay: int) -> DataFrame:
    """kind, id, other, ts of the graph's nodes: a SINK for each output, a SOURCE for each source that reached one, an EDGE for
    each pair, and an ACK for each source that can reach no later output as the watermark has passed its time by max_delay."""
    outs = flow.df.withColumn("__sink", out_id)
    pairs = outs.select(F.col("__sink").alias("sink"), F.explode(F.array_distinct("src")).alias("source")).distinct()
    reached = sources.select(F.col(source_id).cast("bigint").alias("id"), F.col(source_ts).alias("ts")).join(pairs.select(F.col("source").alias("id")).distinct(), "id", "left_semi")
    row = lambda kind, i, other, ts: [F.lit(kind).alias("kind"), i.cast("string").alias("id"), other.cast("string").alias("other"), ts.cast("bigint").alias("ts")]
    none = F.lit(None)
    return (
        outs.select(*row("SINK", F.col("__sink"), none, F.col(flow.time))).distinct()
        .unionByName(reached.select(*row("SOURCE", F.col("id"), none, F.col("ts"))).distinct())
        .unionByName(pairs.select(*row("EDGE", F.col("source"), F.col("sink"), none)))
        .unionByName(reached.where(F.col("ts") < watermark - max_delay).select(*row("ACK", F.col("id"), none, F.col("ts"))).distinct())
    )


def encode_text(graph: DataFrame, stamped: bool = False) -> DataFrame:
    """One line for each node: SOURCE/SINK ::: id ::: ts, EDGE ::: source -> sink, ACK ::: id; stamped lines start with the time."""
    line = (
        F.when(F.col("kind") == "EDGE", F.concat_ws(" ::: ", "kind", F.concat_ws(" -> ", "id", "other")))
        .when(F.col("kind") == "ACK", F.concat_ws(" ::: ", "kind", "id"))
        .otherwise(F.concat_ws(" ::: ", "kind", "id", F.col("ts").cast("string")))
    )
    return graph.select((F.concat_ws(" ::: ", F.coalesce(F.col("ts").cast("string"), F.lit("-")), line) if stamped else line).alias("value"))


def encode_gexf(graph: DataFrame) -> DataFrame:
    """The node and edge elements of a GEXF file, a line each."""
    node = F.format_string('<node id="%s" label="%s"/>', F.col("id"), F.col("kind"))
    edge = F.format_string('<edge source="%s" target="%s"/>', F.col("id"), F.col("other"))
    return graph.where("kind <> 'ACK'").select(F.when(F.col("kind") == "EDGE", edge).otherwise(node).alias("value"))


# --- queries over stored graphs: source(id, ts, data, stimulus, sent, expired), sink, edge(source, sink, stimulus, sent), expired(task, ts)


def unsent(table: DataFrame) -> DataFrame:
    return table.where(~F.col("sent"))


def acks(sources: DataFrame, frontiers: DataFrame) -> DataFrame:
    """Sources before the lowest frontier that have not expired yet."""
    lowest = frontiers.agg(F.min("ts").alias("__frontier"))
    return sources.where(~F.col("expired")).join(F.broadcast(lowest), F.col("ts") < F.col("__frontier")).drop("__frontier")  # one row


def distinct_on(table: DataFrame, key: str = "id", order: str = "stimulus") -> DataFrame:
    """Of each key's rows the one of least order, if none was sent or has expired."""
    rest = [c for c in table.columns if c != key]
    best = F.min_by(F.struct(*rest), F.struct(order, *[c for c in rest if c != order])).alias("__r")
    return table.groupBy(key).agg(best, F.bool_or("sent").alias("__s"), F.bool_or("expired").alias("__e")).where("not __s and not __e").select(key, "__r.*")


def first_values(table: DataFrame, key: str = "id") -> DataFrame:
    """Least ts and stimulus of each unsent key, with the data of its least stimulus."""
    out = table.groupBy(key).agg(F.min("ts").alias("ts"), F.min("stimulus").alias("stimulus"), F.min_by("data", F.struct("stimulus", "data")).alias("data"), F.max("sent").alias("__s"))
    return out.where("not __s").drop("__s")
