"""The temporal index: how much each channel contributed to all outputs of a time range.

The table has a row for each distinct time: its counters c0.., n outputs, and inclusive running sums p0.., pn. Running sums are
made in two steps, within time buckets and over the buckets' totals, so no task sees more than a bucket or a row for each bucket.
A range is answered by two look-ups of the last row at or before a time, whatever lies between.
"""

from __future__ import annotations

from dataclasses import dataclass, replace
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyflow.functions.time import DAY, floor_to


def _plus(cols: list[Column]) -> Column:
    return reduce(lambda a, b: a + b, cols)


def _after(answers: DataFrame, horizon: int | None) -> DataFrame:
    """Nulls in place of counters, and undefined, where a range begins before the horizon."""
    if horizon is None:
        return answers
    asked, gone = ("query_id", "lo", "hi"), F.col("lo") < horizon
    rest = [c for c in answers.columns if c not in (*asked, "is_defined")]
    return answers.select(*asked, *[F.when(~gone, F.col(c)).alias(c) for c in rest], (F.col("is_defined") & ~gone).alias("is_defined"))


@dataclass(frozen=True)
class TemporalIndex:
    """rows: bucket, ts, c0.., n, p0.., pn. horizon: the first time that can still be asked for. ends: the last row of each bucket, where
    that is kept apart (see save)."""

    rows: DataFrame
    channels: int
    bucket: int = DAY
    horizon: int | None = None
    ends: DataFrame | None = None

    @property
    def counts(self) -> list[str]:
        return [f"c{i}" for i in range(self.channels)]

    @property
    def sums(self) -> list[str]:
        return [f"p{i}" for i in range(self.channels)] + ["pn"]

    @staticmethod
    def build(outputs: DataFrame, channels: int, ts: str = "ts_ms", bucket: int = DAY) -> TemporalIndex:
        """From outputs with counters c0 .. c{M-1}, in any order."""
        names = [f"c{i}" for i in range(channels)] + ["n"]
        one = outputs.withColumn("n", F.lit(1).cast("bigint")).groupBy(F.col(ts).cast("bigint").alias("ts")).agg(*[F.sum(c).cast("bigint").alias(c) for c in names])
        return TemporalIndex.of_times(one, channels, bucket)

    @staticmethod
    def of_times(one: DataFrame, channels: int, bucket: int = DAY) -> TemporalIndex:
        """From a row for each time: ts, c0.., n."""
        names = [f"c{i}" for i in range(channels)] + ["n"]
        one = one.select(floor_to(F.col("ts"), bucket).alias("bucket"), "ts", *names)
        inner = Window.partitionBy("bucket").orderBy("ts").rowsBetween(Window.unboundedPreceding, 0)
        before = Window.orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)  # over one row a bucket
        sums = [f"p{c[1:]}" if c != "n" else "pn" for c in names]
        totals = one.groupBy("bucket").agg(*[F.sum(c).alias(c) for c in names])
        base = totals.select("bucket", *[F.coalesce(F.sum(c).over(before), F.lit(0)).alias(f"__{p}") for c, p in zip(names, sums, strict=True)])
        local = one.select("*", *[F.sum(c).over(inner).alias(p) for c, p in zip(names, sums, strict=True)])
        rows = local.join(base, "bucket").select("bucket", "ts", *names, *[(F.col(p) + F.col(f"__{p}")).alias(p) for p in sums])
        return TemporalIndex(rows, channels, bucket)

    def save(self, path: str) -> TemporalIndex:
        """Writes the table in folders by bucket, sorted by time, and the last row of each bucket beside it: a look-up reads those, and of the
        table only the folders that its bounds lie in."""
        spark = self.rows.sparkSession
        self.rows.repartition("bucket").sortWithinPartitions("ts").write.mode("overwrite").partitionBy("bucket").parquet(f"{path}/rows")
        rows = spark.read.parquet(f"{path}/rows").withColumn("bucket", F.col("bucket").cast("bigint"))
        replace(self, rows=rows, ends=None)._last().write.mode("overwrite").parquet(f"{path}/ends")
        return replace(self, rows=rows, ends=spark.read.parquet(f"{path}/ends"))

    def _last(self) -> DataFrame:
        """(bucket, t): the last row of each bucket."""
        if self.ends is not None:
            return self.ends
        return self.rows.groupBy("bucket").agg(F.max_by(F.struct(F.col("ts").alias("at"), *self.sums, *self.counts, "n"), "ts").alias("t"))

    # --- one range

    def _check(self, lo: int, hi: int) -> None:
        if lo > hi:
            raise ValueError(f"range {lo} > {hi}")
        if self.horizon is not None and lo < self.horizon:
            raise ValueError(f"{lo} is before the horizon {self.horizon}")

    def how_much(self, lo: int, hi: int) -> DataFrame:
        """One row: c0.. of all outputs in [lo, hi], n of them, is_defined (n > 0)."""
        self._check(lo, hi)
        asked = self.rows.sparkSession.range(1).select(F.lit(0).alias("query_id"), F.lit(lo).cast("bigint").alias("lo"), F.lit(hi).cast("bigint").alias("hi"))
        return self.answer(asked).drop("query_id", "lo", "hi")

    def scan(self, lo: int, hi: int) -> DataFrame:
        """The same by reading every row of the range: what look-ups are held against."""
        rows = self.rows.where(F.col("bucket").between(lo // self.bucket * self.bucket, hi // self.bucket * self.bucket) & F.col("ts").between(lo, hi))
        sums = [F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in (*self.counts, "n")]
        return rows.agg(*sums).withColumn("is_defined", F.col("n") > 0)

    def count_in(self, lo: int, hi: int) -> DataFrame:
        """n outputs; 0 if lo > hi."""
        return self.scan(lo, hi).select("n")

    # --- many ranges

    def answer(self, queries: DataFrame, width: int = 1) -> DataFrame:
        """For each of queries (query_id, lo, hi): c0.., n and is_defined. Ranges with lo > hi are undefined zeros here; those that begin
        before the horizon, of which a part is gone, are undefined nulls (how_much, which has one range, refuses them).
        width: how long the time is that a row stands for, from ts on; of a row that a bound cuts, a share is taken.

        Bounds and index rows meet in their time bucket; a bound before its bucket's first row takes the total of the buckets
        before. So every bound costs a row, and no range is spread out over the rows it covers.
        """
        ends = F.array(F.struct(F.lit(1).alias("sign"), F.col("hi").alias("at")), F.struct(F.lit(-1).alias("sign"), (F.col("lo") - 1).alias("at")))
        bounds = queries.select("query_id", "lo", "hi", F.explode(ends).alias("e")).select("query_id", "lo", "hi", "e.sign", F.col("e.at").alias("ts"))
        bounds = bounds.where("lo <= hi").withColumn("bucket", floor_to(F.col("ts"), self.bucket))
        found = self._at(bounds, width)
        deltas = [F.sum(F.col("sign") * F.col(p)).alias(p) for p in self.sums]
        got = found.groupBy("query_id").agg(*deltas)
        out = queries.select("query_id", "lo", "hi").join(got, "query_id", "left")
        values = [F.coalesce(F.col(p), F.lit(0)).alias("n" if p == "pn" else f"c{p[1:]}") for p in self.sums]
        return _after(out.select("query_id", "lo", "hi", *values, F.coalesce(F.col("pn") > 0, F.lit(False)).alias("is_defined")), self.horizon)

    def _at(self, bounds: DataFrame, width: int) -> DataFrame:
        """The running sums at each bound's time ts."""
        sums, own = self.sums, [*self.counts, "n"]
        here = self.rows.join(bounds.select("bucket").distinct(), "bucket", "left_semi")  # of a saved index, only these folders are read
        marks = here.select("bucket", "ts", F.lit(0).alias("kind"), F.struct(F.col("ts").alias("at"), *sums, *own).alias("s"))
        asked = bounds.select("bucket", "ts", F.lit(1).alias("kind"), F.struct(*[F.col(c) for c in bounds.columns]).alias("b"))
        both = marks.unionByName(asked, allowMissingColumns=True)
        order = Window.partitionBy("bucket").orderBy("ts", "kind")
        seen = F.last("s", ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, 0))
        found = both.withColumn("s", seen).where("kind = 1").select("bucket", "b", "s")
        days = self._last().select("bucket", "t").unionByName(bounds.select("bucket").distinct(), allowMissingColumns=True)  # a row a bucket
        days = days.groupBy("bucket").agg(F.max("t").alias("t"))
        earlier = F.last("t", ignorenulls=True).over(Window.orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1))
        base = days.select("bucket", earlier.alias("t"))
        joined = found.join(base, "bucket").withColumn("s", F.coalesce("s", "t"))
        missing = F.greatest(F.lit(0.0), 1 - (F.col("b.ts") - F.col("s.at") + 1) / F.lit(width))
        value = lambda p, c: F.col(f"s.{p}") - (missing * F.col(f"s.{c}") if width > 1 else F.lit(0))
        return joined.select("b.*", *[F.coalesce(value(p, c), F.lit(0)).alias(p) for p, c in zip(sums, own, strict=True)])

    # --- growing

    def append(self, outputs: DataFrame, ts: str = "ts_ms") -> TemporalIndex:
        """Outputs that are all later than those there are, added: their running sums go on from the last ones, and no old row is touched.
        Outputs that are not later are refused."""
        new = TemporalIndex.build(outputs, self.channels, ts, self.bucket)
        first, last = new.rows.agg(F.min("ts")).first()[0], self.rows.agg(F.max("ts")).first()[0]
        if first is None or last is None:
            return self if first is None else replace(self, rows=self.rows.unionByName(new.rows), ends=None)
        if first <= last:
            raise ValueError(f"an output at {first} is not after {last}")
        end = self.rows.where(F.col("ts") == last).select(*[F.col(p).alias(f"__{p}") for p in self.sums])  # one row
        grown = new.rows.join(F.broadcast(end)).withColumns({p: F.col(p) + F.col(f"__{p}") for p in self.sums}).select(self.rows.columns)
        return replace(self, rows=self.rows.unionByName(grown), ends=None)

    # --- shrinking

    def expire_before(self, horizon: int) -> TemporalIndex:
        """Drops the rows before horizon but the last, whose running sums are the guard that later ranges subtract."""
        guard = self.rows.where(F.col("ts") < horizon).agg(F.max("ts").alias("ts"))
        old = self.rows.join(F.broadcast(guard), "ts", "left_semi").withColumns({c: F.lit(0).cast("bigint") for c in (*self.counts, "n")})
        rows = self.rows.where(F.col("ts") >= horizon).unionByName(old)
        return replace(self, rows=rows, horizon=horizon, ends=None)

    def records(self) -> DataFrame:
        """How many rows answer for outputs, the guard not counted."""
        return self.rows.where("n > 0").agg(F.count(F.lit(1)).alias("records"))

    def summarize_before(self, horizon: int, width: int) -> SummarizedIndex:
        """Rows before horizon become buckets of width, aligned to the first time there is; only whole buckets are made."""
        first = self.rows.agg(F.min("ts")).first()[0]
        if first is None:
            return SummarizedIndex(self, self, 0, width, horizon)
        until = first + max(0, horizon - first) // width * width
        start = F.lit(first) + F.floor((F.col("ts") - first) / width) * width
        old = self.rows.where(F.col("ts") < until).groupBy(start.cast("bigint").alias("ts")).agg(*[F.sum(c).alias(c) for c in (*self.counts, "n")])
        exact = replace(self.expire_before(until), horizon=self.horizon)  # its guard holds the sums before
        return SummarizedIndex(exact, TemporalIndex.of_times(old, self.channels, max(self.bucket, width)), first, width, until)

    # --- facts

    def memory(self) -> DataFrame:
        """Bytes of the rows: (1 + M) numbers of 8 bytes each."""
        return self.rows.where("n > 0").agg(F.count(F.lit(1)).alias("records")).select("records", (F.col("records") * 8 * (1 + self.channels)).alias("bytes"))

    def digest(self) -> DataFrame:
        """An order-insensitive digest of times and counters."""
        h = F.xxhash64("ts", *self.counts)
        return self.rows.where("n > 0").agg(F.count(F.lit(1)).alias("records"), F.sum(h.cast("decimal(38,0)")).cast("string").alias("total"), F.bit_xor(h).alias("parity"))


@dataclass(frozen=True)
class SummarizedIndex:
    """Exact rows from `until` on, and buckets [start, start + width) before. Inside a bucket counters are taken to be even in time."""

    exact: TemporalIndex
    buckets: TemporalIndex
    first: int
    width: int
    until: int

    def answer(self, queries: DataFrame) -> DataFrame:
        """As TemporalIndex.answer, with real counters: the exact part and the summarized part of each range, added."""
        names = [*self.exact.counts, "n"]
        new = self.exact.answer(queries.select("query_id", F.greatest("lo", F.lit(self.until)).alias("lo"), "hi"))
        old = self.buckets.answer(queries.select("query_id", "lo", F.least("hi", F.lit(self.until - 1)).alias("hi")), self.width)
        both = new.select("query_id", *[F.col(c).cast("double").alias(c) for c in names]).unionByName(old.select("query_id", *[F.col(c).cast("double").alias(c) for c in names]))
        sums = both.groupBy("query_id").agg(*[F.sum(c).alias(c) for c in names])
        return _after(queries.select("query_id", "lo", "hi").join(sums, "query_id").withColumn("is_defined", F.col("n") > 0), self.exact.horizon)

    def how_much(self, lo: int, hi: int) -> DataFrame:
        self.exact._check(lo, hi)
        spark = self.exact.rows.sparkSession
        return self.answer(spark.range(1).select(F.lit(0).alias("query_id"), F.lit(lo).cast("bigint").alias("lo"), F.lit(hi).cast("bigint").alias("hi"))).drop("query_id", "lo", "hi")

    def memory(self) -> DataFrame:
        """Bytes: (1 + M) numbers for a row, (2 + M) for a bucket."""
        m = self.exact.channels
        both = self.exact.rows.where("n > 0").select(F.lit(1).alias("r"), F.lit(0).alias("b")).unionByName(self.buckets.rows.select(F.lit(0).alias("r"), F.lit(1).alias("b")))
        sums = both.agg(F.coalesce(F.sum("r"), F.lit(0)).alias("records"), F.coalesce(F.sum("b"), F.lit(0)).alias("buckets"))
        return sums.withColumn("bytes", F.col("records") * 8 * (1 + m) + F.col("buckets") * 8 * (2 + m))


# --- sweeps

def query_lengths(index: TemporalIndex, lengths: list[int], each: int, seed: int = 42) -> DataFrame:
    """`each` ranges of every length, at times drawn by hash over the index's span: (query_id, lo, hi, length)."""
    ends = index.rows.agg(F.min("ts").alias("a"), F.max("ts").alias("b"))
    n = index.rows.sparkSession.range(len(lengths) * each)
    length = F.element_at(F.array(*[F.lit(x).cast("bigint") for x in lengths]), (F.col("id") % len(lengths) + 1).cast("int"))
    at = F.col("a") + F.pmod(F.xxhash64("id", F.lit(seed)), F.greatest(F.lit(1), F.col("b") - F.col("a") - length + 2))
    drawn = n.join(F.broadcast(ends)).withColumn("length", length).withColumn("lo", at)  # one row of ends
    return drawn.select(F.col("id").alias("query_id"), "lo", (F.col("lo") + F.col("length") - 1).alias("hi"), "length")


def mismatches(a: DataFrame, b: DataFrame, channels: int) -> DataFrame:
    """How many of the answers to the same ranges differ."""
    names = [*[f"c{i}" for i in range(channels)], "n", "is_defined"]
    same = [F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}")) for c in names]
    both = a.alias("a").join(b.alias("b"), "query_id")
    return both.agg(F.count(F.lit(1)).alias("queries"), F.count_if(~reduce(lambda x, y: x & y, same)).alias("mismatches"))


def relative_errors(estimates: DataFrame, exact: DataFrame, channels: int) -> DataFrame:
    """Mean and largest error of estimated counters, relative to the exact ones, or to 1 where those are smaller."""
    both = estimates.alias("a").join(exact.alias("b"), "query_id")
    errors = [F.abs(F.col(f"a.c{i}") - F.col(f"b.c{i}")) / F.greatest(F.lit(1), F.col(f"b.c{i}")) for i in range(channels)]
    return both.select(F.explode(F.array(*errors)).alias("e")).agg(F.avg("e").alias("mean_error"), F.max("e").alias("max_error"))


# --- answers

def with_shares(answers: DataFrame, channels: int, zero: bool = False) -> DataFrame:
    """Adds share0..: null (or 0 if zero is set) where the total is 0."""
    total = _plus([F.col(f"c{i}") for i in range(channels)])
    return answers.withColumns({f"share{i}": F.when(total != 0, F.col(f"c{i}") / total).otherwise(F.lit(0.0 if zero else None)) for i in range(channels)})


def versioning(first: DataFrame, second: DataFrame, channels: int) -> DataFrame:
    """From the answers to two sets of ranges with equal query_ids: delta0.. (second less first), null if either is undefined, and
    delta_share0.., null also if either total is 0; is_final if both are, where answers say so."""
    a, b = (with_shares(x, channels).alias(n) for x, n in ((first, "a"), (second, "b")))
    both = F.col("a.is_defined") & F.col("b.is_defined")
    deltas = [F.when(both, F.col(f"b.c{i}") - F.col(f"a.c{i}")).alias(f"delta{i}") for i in range(channels)]
    parts = [F.when(both, F.col(f"b.share{i}") - F.col(f"a.share{i}")).alias(f"delta_share{i}") for i in range(channels)]
    final = [(F.col("a.is_final") & F.col("b.is_final")).alias("is_final")] if "is_final" in first.columns else []
    return a.join(b, F.col("a.query_id") == F.col("b.query_id")).select(F.col("a.query_id").alias("query_id"), *deltas, *parts, both.alias("is_defined"), *final)
