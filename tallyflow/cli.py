"""Questions about a file of outputs (ts, c0, c1, ..): python -m tallyflow.cli query|delta|bench FILE ..., or selftest without a file."""

from __future__ import annotations

import argparse
import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyflow.operators.index import TemporalIndex, versioning, with_shares


def load(spark: SparkSession, path: str, channels: int) -> DataFrame:
    names = ", ".join(f"c{i} bigint" for i in range(channels))
    return spark.read.schema(f"ts_ms bigint, {names}").csv(path)


def ranges(spark: SparkSession, pairs: list[tuple[int, int]]) -> DataFrame:
    return spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(pairs)], "query_id int, lo bigint, hi bigint")


def selftest(spark: SparkSession) -> DataFrame:
    """(check, passed) of an index whose answers are known."""
    known = [(1, 1, 4), (2, 1, 4), (3, 1, 2), (4, 3, 3), (5, 3, 0), (6, 2, 1)]
    outputs = lambda rows: spark.createDataFrame(rows, "ts_ms bigint, c0 bigint, c1 bigint")
    index = TemporalIndex.build(outputs(known), 2)
    got = lambda x, lo, hi: tuple(x.how_much(lo, hi).select("c0", "c1").first())

    def refused() -> bool:
        try:
            index.expire_before(4).how_much(2, 5)
        except ValueError:
            return True
        return False

    pair = TemporalIndex.build(outputs([(1, 2, 2), (3, 6, 2)]), 2)
    delta = versioning(pair.answer(ranges(spark, [(1, 2)])), pair.answer(ranges(spark, [(3, 4)])), 2).first()
    summary = got(index.summarize_before(4, 3), 3, 5)
    checks = [
        ("range", got(index, 3, 5) == (7, 5)), ("scan", tuple(index.scan(3, 5).select("c0", "c1").first()) == (7, 5)), ("expiry", got(index.expire_before(4), 4, 6) == (8, 4)), ("expired range", refused()),
        ("summary", summary[0] == 7 and abs(summary[1] - 19 / 3) < 1e-9), ("versions", tuple(delta)[1:5] == (4, 0, 0.25, -0.25)), ("append", got(TemporalIndex.build(outputs(known[:3]), 2).append(outputs(known[3:])), 3, 5) == (7, 5)),
    ]
    return spark.createDataFrame(checks, "check string, passed boolean")


def run(spark: SparkSession, args: argparse.Namespace) -> DataFrame:
    if args.command == "selftest":
        return selftest(spark)
    index = TemporalIndex.build(load(spark, args.file, args.channels), args.channels)
    if args.command == "query":
        return with_shares(index.how_much(args.bounds[0], args.bounds[1]), args.channels)
    if args.command == "delta":
        a, b, c, d = args.bounds
        return versioning(index.answer(ranges(spark, [(a, b)])), index.answer(ranges(spark, [(c, d)])), args.channels).drop("query_id")
    ends = index.rows.agg(F.min("ts"), F.max("ts")).first()
    at = F.lit(ends[0]) + F.pmod(F.xxhash64("id", F.lit(42)), F.lit(ends[1] - ends[0] + 1))
    asked = spark.range(args.bounds[0]).select(F.col("id").alias("query_id"), at.alias("lo"), (at + (ends[1] - ends[0]) // 10).alias("hi"))
    began = time.time()
    n = index.answer(asked).where("is_defined").count()
    return spark.createDataFrame([(args.bounds[0], n, time.time() - began)], "queries bigint, defined bigint, seconds double")


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(description=__doc__)
    p.add_argument("command", choices=["query", "delta", "bench", "selftest"])
    p.add_argument("file", nargs="?")
    p.add_argument("bounds", type=int, nargs="*", help="query: from to; delta: from to from to; bench: how many queries")
    p.add_argument("--channels", type=int, default=2)
    return p


if __name__ == "__main__":
    run(SparkSession.builder.getOrCreate(), parser().parse_args()).show(truncate=False)
