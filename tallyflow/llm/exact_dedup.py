"""Exact dedup: texts that are equal after lower-casing A-Z form a group; the row with the largest doc_id stays."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyflow.llm.common import ascii_lower, join_groups, written

SALTS = 16


def sha256(col: Column) -> Column:
    return F.unhex(F.sha2(col.cast("binary"), 256))


def duplicate_groups(docs: DataFrame, digest=sha256, salts: int = SALTS) -> tuple[DataFrame, DataFrame]:
    """(rows, groups): rows is (doc_id, digest, norm) lazily; groups is (digest, norm, keep_id, group_size), a row for each text.

    Three combining steps, each keyed by the whole text beside its digest, so a collision of digests never merges texts:
    within each task (partial aggregation), for each salt, and over the salts. A group that holds a third of all rows
    reaches its reducers as one row for each task and salt. The last step is dealt by digest alone, which lets
    colliding digests be counted without another exchange.
    """
    norm = ascii_lower(F.coalesce(F.col("text"), F.lit("")))
    rows = docs.select(F.col("doc_id").alias("doc_id"), norm.alias("norm")).withColumn("digest", digest(F.col("norm")))
    salted = (
        rows.withColumn("salt", F.pmod(F.xxhash64("doc_id"), F.lit(salts)))
        .groupBy("digest", "salt", "norm")
        .agg(F.max("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
    )
    groups = (
        salted.repartition("digest")
        .groupBy("digest", "norm")
        .agg(F.max("keep_id").alias("keep_id"), F.sum("group_size").alias("group_size"))
    )
    return rows, groups


def exact_duplicates(docs: DataFrame, digest=sha256, salts: int = SALTS) -> DataFrame:
    """A row for each row of docs: doc_id, keep_id (the largest doc_id of its group), group_size, kept, digest.

    Null texts count as empty. Null doc_ids rank below all others; in a group of only nulls keep_id is null and its rows are
    kept. Repeated rows (same doc_id, same text) are one document written twice: all have kept set if it is the winner.
    An empty table gives an empty result. Other columns are not read, whatever their names.
    """
    rows, groups = duplicate_groups(docs, digest, salts)
    one = written(
        groups.groupBy("digest").agg(
            F.count(F.lit(1)).alias("texts"), F.max("keep_id").alias("keep_id"), F.sum("group_size").alias("group_size")
        ),
        "exact-groups",
    )
    total = one.agg(F.coalesce(F.sum("group_size"), F.lit(0))).first()[0]
    found = written(rows.select("doc_id", "digest"), "exact-rows")  # the join reads it twice, and not the texts
    joined = join_groups(found, one.where("texts = 1").drop("texts"), "digest", "group_size", total)
    collided = one.where("texts > 1").select("digest")
    if not collided.isEmpty():  # different texts with one digest: these rows alone are joined by their whole text
        again = rows.join(collided, "digest", "left_semi").join(groups.join(collided, "digest", "left_semi"), ["digest", "norm"])
        joined = joined.unionByName(again.select(joined.columns))
    return joined.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("keep_id"))).select(
        "doc_id", "keep_id", "group_size", "kept", "digest"
    )


def drop_exact_duplicates(docs: DataFrame) -> DataFrame:
    """One row of docs for each group, with all its columns: that of the largest doc_id; of several such rows the one of the largest text
    (they differ in A-Z alone), or any of those that are equal. Null doc_ids stay only in groups that have no other."""
    _, groups = duplicate_groups(docs)

    def keyed(df: DataFrame, name: str) -> DataFrame:
        return df.withColumns({"__id": F.coalesce(F.col(name), F.lit(0)), "__null": F.col(name).isNull()})

    keys = ["__id", "__null", "__digest"]
    winners = keyed(groups.select("keep_id", F.col("digest").alias("__digest")), "keep_id").select(keys)
    marked = keyed(docs, "doc_id").withColumn("__digest", sha256(ascii_lower(F.coalesce(F.col("text"), F.lit("")))))
    # the join deals rows out by the same keys that repeated rows share, so whole texts are shuffled once here
    one = F.max_by(F.struct(*[F.col(f"`{c}`") for c in docs.columns]), F.coalesce("text", F.lit(""))).alias("__row")
    return marked.join(winners, keys, "left_semi").groupBy(keys).agg(one).select("__row.*")
