"""Annotated frames: each operator computes its rows and their annotation in one declarative plan.

A scheme says how the annotation is kept:

none      no annotation
counters  columns hm_0 .. hm_{M-1}; sums stay in generated code
sparse    column hm, map<bigint, bigint> from channel to count
prefix    column hm, the same over the nodes of a trie of path bits
poly      column hm, map<bigint, bigint> from variable to exponent: the one monomial that these operators make
graph     column src, array<bigint> of source ids with multiplicity
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyflow.functions import algebra
from tallyflow.functions.time import floor_to, stamp, window_starts

SCHEMES = ("none", "counters", "sparse", "prefix", "poly", "graph")
#: name -> (function, column); functions that can be combined from parts
Aggs = dict[str, tuple[str, str | None]]


@dataclass(frozen=True)
class Flow:
    df: DataFrame
    scheme: str = "none"
    channels: int = 0
    time: str = "ts_ms"

    @property
    def marks(self) -> list[str]:
        """The annotation's columns."""
        return [f"hm_{i}" for i in range(self.channels)] if self.scheme == "counters" else {"none": [], "graph": ["src"]}.get(self.scheme, ["hm"])

    # --- operators that keep the annotation

    def where(self, condition: Column) -> Flow:
        return replace(self, df=self.df.where(condition))

    def select(self, *cols: Column | str) -> Flow:
        """A map: the annotation and the time are copied."""
        return replace(self, df=self.df.select(self.time, *cols, *self.marks))

    def flat_map(self, name: str, items: Column) -> Flow:
        """A row for each item of an array, or each entry of a map; the annotation is copied."""
        return replace(self, df=self.df.withColumn(name, F.explode(items)))

    def union(self, other: Flow) -> Flow:
        return replace(self, df=self.df.unionByName(other.df))

    # --- windows

    def aggregate(self, keys: list[str], aggs: Aggs, size: int, slide: int | None = None) -> Flow:
        """Keyed aggregates over tumbling or sliding event-time windows; results are stamped with their window's last millisecond.

        If the window is a multiple of the slide, rows are first combined into panes of one slide, and panes into windows, so a
        row isn't copied for each of its windows. The annotation is the sum over the window's rows (for poly: the product).
        """
        slide = slide or size
        panes = size % slide == 0 and size > slide and all(f in _COMBINES for f, _ in aggs.values())
        if not panes:
            rows = self.df.withColumn("__w", F.explode(window_starts(F.col(self.time), size, slide)) if slide < size else floor_to(F.col(self.time), slide))
            done = self._combined(rows, ["__w", *keys], aggs)
        else:
            part = self._partial(self.df.withColumn("__p", floor_to(F.col(self.time), slide)), ["__p", *keys], aggs)
            back = F.array(*[F.col("__p") - k * slide for k in range(size // slide)])
            done = self._final(part.withColumn("__w", F.explode(back)).drop("__p"), ["__w", *keys], aggs)
        named = [F.col(k) for k in keys] + [F.col(a) for a in aggs]
        return replace(self, df=done.select(stamp(F.col("__w"), size).alias(self.time), *named, *self.marks))

    def _combined(self, df: DataFrame, by: list[str], aggs: Aggs) -> DataFrame:
        if all(f in _COMBINES for f, _ in aggs.values()):
            return self._final(self._partial(df, by, aggs), by, aggs) if self.scheme in ("sparse", "prefix", "poly") else self._direct(df, by, aggs)
        return self._direct(df, by, aggs)

    def _direct(self, df: DataFrame, by: list[str], aggs: Aggs) -> DataFrame:
        plain = [_PLAIN[f](c).alias(a) for a, (f, c) in aggs.items()]
        if self.scheme in ("sparse", "prefix", "poly"):  # the rest beside the counters, joined by key
            rest = df.groupBy(*by).agg(*plain)
            return rest.join(self._maps(df, by), by)
        return df.groupBy(*by).agg(*plain, *self._sums())

    def _sums(self) -> list[Column]:
        if self.scheme == "counters":
            return [F.sum(m).alias(m) for m in self.marks]
        return [F.flatten(F.collect_list("src")).alias("src")] if self.scheme == "graph" else []

    def _maps(self, df: DataFrame, by: list[str]) -> DataFrame:
        """Sparse counters summed key by key, in long form, so that a group is never gathered before it is combined."""
        long = df.select(*by, F.explode("hm").alias("__k", "__v")).groupBy(*by, "__k").agg(F.sum("__v").alias("__v"))
        return long.groupBy(*by).agg(F.map_from_entries(F.collect_list(F.struct("__k", "__v"))).alias("hm"))

    def _partial(self, df: DataFrame, by: list[str], aggs: Aggs) -> DataFrame:
        parts = [p for a, (f, c) in aggs.items() for p in _COMBINES[f][0](a, c)]
        if self.scheme in ("sparse", "prefix", "poly"):
            return df.groupBy(*by).agg(*parts).join(self._maps(df, by), by)
        return df.groupBy(*by).agg(*parts, *self._sums())

    def _final(self, df: DataFrame, by: list[str], aggs: Aggs) -> DataFrame:
        ends = [_COMBINES[f][1](a).alias(a) for a, (f, _) in aggs.items()]
        if self.scheme in ("sparse", "prefix", "poly"):
            return df.groupBy(*by).agg(*ends).join(self._maps(df, by), by)
        return df.groupBy(*by).agg(*ends, *self._sums())

    def join(self, other: Flow, key: str, size: int, slide: int | None, cols: list[Column], residual: Column | None = None) -> Flow:
        """The inner windowed equi-join: both sides are put into every window that holds their time, and within a window all rows
        of a key meet. Columns are named l.x and r.x in cols and residual. The annotations are added."""
        slide = slide or size
        each = lambda f, a: f.df.withColumn("__w", F.explode(window_starts(F.col(f.time), size, slide)) if slide < size else floor_to(F.col(f.time), slide)).alias(a)
        met = each(self, "l").join(each(other, "r"), [F.col("l.__w") == F.col("r.__w"), F.col(f"l.{key}") == F.col(f"r.{key}")])
        if residual is not None:
            met = met.where(residual)
        return replace(self, df=met.select(stamp(F.col("l.__w"), size).alias(self.time), F.col(f"l.{key}").alias(key), *cols, *self._joined()))

    def interval_join(self, other: Flow, key: str, before: int, after: int, cols: list[Column]) -> Flow:
        """The inner join of rows of a key whose times are apart by r - l in [before, after]; the later time stays. Both sides are dealt
        into slots as wide as the interval, so that the join is by equality: a row of the left looks into the slots it can reach."""
        width = max(1, after - before)
        reach = F.sequence(floor_to(F.col(self.time) + before, width), floor_to(F.col(self.time) + after, width), F.lit(width))
        left = self.df.withColumn("__s", F.explode(reach)).alias("l")
        right = other.df.withColumn("__s", floor_to(F.col(other.time), width)).alias("r")
        apart = F.col(f"r.{other.time}") - F.col(f"l.{self.time}")
        met = left.join(right, [F.col("l.__s") == F.col("r.__s"), F.col(f"l.{key}") == F.col(f"r.{key}")]).where(apart.between(before, after))
        time = F.greatest(f"l.{self.time}", f"r.{other.time}").alias(self.time)
        return replace(self, df=met.select(time, F.col(f"l.{key}").alias(key), *cols, *self._joined()))

    def distinct_by(self, *key: str) -> Flow:
        """One row of each key, for streams of rows that several paths have brought."""
        return replace(self, df=self.df.dropDuplicates([*key]))

    def map_frames(self, function: Callable, schema: str) -> Flow:
        """The last resort for row logic that columns can't express: function maps iterators of pandas frames; it must pass on the
        time and the annotation's columns, which schema names too."""
        return replace(self, df=self.df.mapInPandas(function, schema))

    def _joined(self) -> list[Column]:
        if self.scheme == "counters":
            return [(F.col(f"l.{m}") + F.col(f"r.{m}")).alias(m) for m in self.marks]
        if self.scheme == "graph":
            return [F.concat("l.src", "r.src").alias("src")]
        return [] if self.scheme == "none" else [algebra.add_sparse(F.col("l.hm"), F.col("r.hm")).alias("hm")]

    # --- what the annotation says

    def counters(self) -> Column:
        """How much each channel contributed to a row, as an array, from any scheme but none and graph."""
        if self.scheme == "counters":
            return F.array(*self.marks)
        if self.scheme == "sparse":
            return algebra.dense(F.col("hm"), self.channels)
        if self.scheme == "prefix":
            return algebra.trie_to_dense(F.col("hm"), (self.channels - 1).bit_length())
        if self.scheme == "poly":
            entries = F.map_entries("hm")
            per = lambda i: F.aggregate(F.filter(entries, lambda x: F.pmod(x["key"], F.lit(self.channels)) == i), F.lit(0).cast("bigint"), lambda s, x: s + x["value"])
            return F.transform(F.sequence(F.lit(0), F.lit(self.channels - 1)), per)
        raise ValueError(f"{self.scheme}: no counters")

    def dense(self) -> DataFrame:
        """The rows with columns c0 .. c{M-1} in place of the annotation."""
        if self.scheme == "none":
            return self.df
        if self.scheme == "counters":
            return self.df.withColumnsRenamed({m: f"c{i}" for i, m in enumerate(self.marks)})
        named = self.df.withColumn("__c", self.counters())
        return named.select(*[c for c in self.df.columns if c not in self.marks], *[F.get("__c", F.lit(i)).alias(f"c{i}") for i in range(self.channels)])


_COMBINES: dict[str, tuple[Callable, Callable]] = {
    "count": (lambda a, c: [F.count(F.lit(1)).alias(a)], lambda a: F.sum(a)),
    "sum": (lambda a, c: [F.sum(c).alias(a)], lambda a: F.sum(a)),
    "min": (lambda a, c: [F.min(c).alias(a)], lambda a: F.min(a)),
    "max": (lambda a, c: [F.max(c).alias(a)], lambda a: F.max(a)),
    "avg": (lambda a, c: [F.sum(c).alias(f"{a}__s"), F.count(c).alias(f"{a}__n")], lambda a: F.sum(f"{a}__s") / F.sum(f"{a}__n")),
}
_PLAIN: dict[str, Callable] = {
    "count": lambda c: F.count(F.lit(1)), "sum": F.sum, "min": F.min, "max": F.max, "avg": F.avg,
    "distinct": F.count_distinct,
    "first": lambda c: F.min_by(c.rpartition("@")[0], c.rpartition("@")[2]), "last": lambda c: F.max_by(c.rpartition("@")[0], c.rpartition("@")[2]),
}


def tag(df: DataFrame, channel: Column, channels: int, scheme: str, source_id: Column | None = None, time: str = "ts_ms") -> Flow:
    """Starts a flow: every row is its own source's, one in its channel. poly and graph tell rows apart by source_id."""
    if scheme not in SCHEMES:
        raise ValueError(f"{scheme}: one of {', '.join(SCHEMES)}")
    one = F.lit(1).cast("bigint")
    if scheme == "counters":
        df = df.withColumns({f"hm_{i}": (channel == i).cast("bigint") for i in range(channels)})
    elif scheme == "sparse":
        df = df.withColumn("hm", F.create_map(channel.cast("bigint"), one))
    elif scheme == "prefix":
        nodes = algebra.trie_nodes(channel.cast("bigint"), (channels - 1).bit_length())
        df = df.withColumn("hm", F.map_from_arrays(nodes, F.transform(nodes, lambda _: one)))
    elif scheme == "poly":
        df = df.withColumn("hm", F.create_map(algebra.variable_id(source_id.cast("bigint"), 0, 1, channels, channel.cast("bigint")), one))
    elif scheme == "graph":
        df = df.withColumn("src", F.array(source_id.cast("bigint")))
    return Flow(df, scheme, channels, time)
