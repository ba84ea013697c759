"""SimHash near-dedup: 64-bit fingerprints over word shingles, linked exactly within a radius of differing bits."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyflow.llm.common import HOT_SHARE, discard, join_groups, text_chunks, trim, written

RADIUS = 2
SHINGLE = 3
SEED = 42
#: Fingerprints in a tile: a tile pair needs TILE * TILE words of memory.
TILE = 128
#: A bucket with more fingerprints is dealt out by further bits: over the cluster if it holds over one in HOT_SHARE of all, else in its task.
BUCKET = 4096
#: Rows of whole buckets that a task compares in one go.
GO = 1 << 17
#: Hashes expanded into bits at once.
BLOCK = 1 << 15


def fingerprint(text: bytes, k: int = SHINGLE) -> int:
    """The fingerprint of UTF-8 text: words are lower-cased in A-Z, a bit is set if it is in over half the shingle hashes."""
    tokens = text.lower().split()  # of bytes: A-Z, and the blanks \x20 \x09-\x0D, alone
    if not tokens:
        return 0
    joined, k = b" ".join(tokens), min(k, len(tokens))
    ends = np.cumsum([len(t) + 1 for t in tokens])
    starts = [0, *ends[: len(tokens) - k].tolist()]
    digest = xxhash.xxh64_intdigest
    hashes = np.array([digest(joined[a : b - 1], SEED) for a, b in zip(starts, ends[k - 1 :].tolist(), strict=True)], "<u8")
    ones = np.zeros(64, np.int64)
    for i in range(0, len(hashes), BLOCK):
        part = hashes[i : i + BLOCK]
        ones += np.unpackbits(part.view(np.uint8).reshape(len(part), 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(ones * 2 > len(hashes), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, k: int = SHINGLE) -> DataFrame:
    """(doc_id, fp as a signed long) of each row. Null texts count as empty and get 0, as texts without words do."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_chunks(batches, "text"):
            found = [fingerprint(x or b"", k) for x in batch.column("text").cast(pa.binary()).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(np.array(found, np.uint64).view(np.int64))], ["doc_id", "fp"])

    ids = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return ids.mapInArrow(run, "doc_id long, fp long")


class Tiles:
    """Rows sorted by bucket, then by population count, and cut into tiles. Tiles are compared whole by exclusive-or and bit count,
    each with itself and with those after it that its last bucket goes on in; a tile pair is skipped if its population counts differ
    beyond the radius, as then at least that many bits differ."""

    def __init__(self, keys: np.ndarray, prints: np.ndarray, radius: int, tile: int = TILE):
        """prints: a row of words for each fingerprint."""
        counts = np.bitwise_count(prints).sum(axis=1, dtype=np.int64)
        self.order = np.lexsort((counts, keys))
        self.keys, self.prints, self.counts = keys[self.order], prints[self.order], counts[self.order]
        self.radius, self.tile, self.compared, self.skipped = radius, tile, 0, 0

    def pairs(self) -> Iterator[tuple[int, int, np.ndarray]]:
        """(i, j, near): the tiles' first rows, and which of their rows are within the radius; only tile pairs that have some."""
        n, tile = len(self.keys), self.tile
        for i in range(0, n, tile):
            last = min(i + tile, n) - 1
            for j in range(i, n, tile):
                if j > i and self.keys[j] != self.keys[last]:
                    break
                if j > i and self.counts[j] - self.counts[last] > self.radius:
                    after = np.searchsorted(self.keys[j:], self.keys[j], "right")
                    self.skipped += -(-int(after) // tile)
                    break
                self.compared += 1
                differ = np.bitwise_count(self.prints[i : i + tile, None, 0] ^ self.prints[None, j : j + tile, 0])
                for w in range(1, self.prints.shape[1]):
                    differ = (differ if w < 3 else differ.astype(np.uint16)) + np.bitwise_count(self.prints[i : i + tile, None, w] ^ self.prints[None, j : j + tile, w])
                near = differ <= self.radius
                if i == j:
                    near = np.triu(near, 1)
                if near.any():
                    yield i, j, near


def link_forest(fps: np.ndarray, radius: int = RADIUS, tile: int = TILE, keys: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Edges that connect what fingerprints within radius in a bucket connect, as few as a forest has: two arrays of fingerprints."""
    tiles = Tiles(np.zeros(len(fps), np.int64) if keys is None else keys, fps.astype(np.uint64)[:, None], radius, tile)
    fps = tiles.prints[:, 0]
    parent = np.arange(len(fps))
    a_out, b_out = [], []

    def root(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for i, j, near in tiles.pairs():
        for x in np.flatnonzero(near.any(axis=1)):
            y = np.flatnonzero(near[x]) + j
            while len(y := y[parent[y] != parent[x + i]]):  # what is known to be connected goes at once
                p, q = root(int(x + i)), root(int(y[0]))
                if p != q:
                    parent[max(p, q)] = min(p, q)
                    a_out.append(x + i)
                    b_out.append(int(y[0]))
                parent[x + i], parent[y[0]] = min(p, q), min(p, q)
                y = y[1:]
    return fps[np.array(a_out, np.int64)], fps[np.array(b_out, np.int64)]


def _finer(fps: np.ndarray, radius: int, bucket: int) -> tuple[np.ndarray, np.ndarray]:
    """A large bucket as small ones: (keys, fps). The bits in which its fingerprints vary are cut into radius + 1 fields; of two within the
    radius, one field agrees. Where few bits vary there are few fingerprints, so this ends."""
    vary = int(np.bitwise_or.reduce(fps ^ fps[0]))
    bits = [b for b in range(64) if vary >> b & 1]
    if len(fps) <= bucket or len(bits) <= radius:
        return np.zeros(len(fps), np.int64), fps
    keys, out, used = [], [], 0
    for field in _cells(bits, radius + 1):
        value = fps & np.uint64(sum(1 << b for b in field))
        names, which, sizes = np.unique(value, return_inverse=True, return_counts=True)
        big = sizes > bucket
        for k in np.flatnonzero(big):
            inner, held = _finer(fps[which == k], radius, bucket)
            keys.append(inner + used)
            out.append(held)
            used += int(inner.max()) + 1
        rest = ~big[which]
        keys.append(which[rest] + used)
        out.append(fps[rest])
        used += len(names)
    return np.concatenate(keys), np.concatenate(out)


def whole_buckets(batches: Iterator[pa.RecordBatch], go: int = GO, size: int = 32 << 20) -> Iterator[pa.Table]:
    """Batches sorted by key, put together so that no bucket is cut, and no further than to so many rows or bytes."""
    held: list[pa.RecordBatch] = []
    n = 0
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        n += batch.num_rows
        keys = batch.column("key").to_numpy()
        if (n >= go or sum(b.nbytes for b in held) >= size) and (keys[0] != keys[-1] or (len(held) > 1 and held[-2].column("key")[-1].as_py() != keys[-1])):
            cut = int(np.flatnonzero(keys != keys[-1])[-1]) + 1 if keys[0] != keys[-1] else 0
            yield pa.Table.from_batches([*held[:-1], batch.slice(0, cut)])
            trim()
            held, n = [batch.slice(cut)], batch.num_rows - cut
    if n:
        yield pa.Table.from_batches(held)


def _pairs_in_buckets(radius: int, bucket: int):
    """A function over batches sorted by key: the forest edges of all buckets, by tiles."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in whole_buckets(batches):
            names, keys, sizes = np.unique(table.column("key").to_numpy(), return_inverse=True, return_counts=True)
            fps = table.column("fp").to_numpy().view(np.uint64)
            big, used = sizes > bucket, len(names)
            parts = [(keys[~big[keys]], fps[~big[keys]])]
            for k in np.flatnonzero(big):
                inner, held = _finer(fps[keys == k], radius, bucket)
                parts.append((inner + used, held))
                used += int(inner.max()) + 1
            a, b = link_forest(np.concatenate([x for _, x in parts]), radius, keys=np.concatenate([k for k, _ in parts]))
            if len(a):
                yield pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], ["a", "b"])

    return run


def _cells(bits: list[int], parts: int) -> list[list[int]]:
    return [list(map(int, x)) for x in np.array_split(np.array(bits), parts)]


def _value(bits: list[int]):
    mask = sum(1 << b for b in bits)
    return F.col("fp").bitwiseAND(F.lit(mask - (1 << 64) if mask >> 63 else mask))


def links(fps: DataFrame, radius: int = RADIUS, bucket: int = BUCKET) -> DataFrame:
    """(a, b): a forest over the distinct fingerprints in fps that connects just what differences of at most radius bits connect.

    Tiles come from buckets: cut into radius + 1 fields, two fingerprints within the radius agree in one field at least, so each
    goes to radius + 1 buckets and every pair is compared there, tile by tile. A bucket with more than `bucket` members and over one in
    HOT_SHARE of all is hot (there are at most HOT_SHARE of them for each field, which are broadcast); its members go on to buckets by a
    field of their remaining bits. What is left with more than `bucket` members is dealt out likewise within its task.
    """
    spark = fps.sparkSession
    total = fps.count()
    limit = max(bucket, total // HOT_SHARE)
    todo, done = [(list(range(64)), fps.withColumn("key", F.lit(0).cast("long")), 0)], []
    while todo:
        bits, frame, level = todo.pop()
        for n, field in enumerate(_cells(bits, radius + 1)):
            keyed = frame.withColumn("key", F.xxhash64("key", F.lit(level), F.lit(n), _value(field)))
            rest = [b for b in bits if b not in field]
            if level < 3:
                hot = keyed.groupBy("key").count().where(F.col("count") > limit).select("key")
                names = [r[0] for r in hot.collect()]  # at most total / limit of them, so under HOT_SHARE
                if names:
                    found = F.broadcast(spark.createDataFrame([(x,) for x in names], "key long"))
                    todo.append((rest, keyed.join(found, "key", "left_semi"), level + 1))
                    keyed = keyed.join(found, "key", "left_anti")
            done.append(keyed.select("key", "fp"))
    both = done[0]
    for x in done[1:]:
        both = both.unionByName(x)
    dealt = both.repartition("key").sortWithinPartitions("key")
    return dealt.mapInArrow(_pairs_in_buckets(radius, bucket), "a long, b long").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(fp, root) for each fingerprint in an edge; root is one of its component, the same for all. Large-star and small-star
    rounds; each round's edges are a table in the shared folder. Only three numbers a round reach the driver. The centre of a large
    star is a hot key of the joins, and dealt with as such."""
    state = written(edges.select("a", "b").where("a <> b"), "star")
    mark, n = None, state.count()
    while True:
        both = state.select("a", "b").union(state.select("b", "a"))
        least = both.groupBy("a").agg(F.min("b").alias("m"), F.count_if(F.col("b") > F.col("a")).alias("n")).select("a", F.least("a", "m").alias("m"), "n")
        large = join_groups(both.where("b > a"), least, "a", "n", n).select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        down = written(large.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")), "star")
        least = down.groupBy("a").agg(F.min("b").alias("m"), F.count(F.lit(1)).alias("n"))
        small = join_groups(down, least, "a", "n", n).select(F.explode(F.array(F.struct(F.col("a"), F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("x")).select("x.*")
        old, state = state, written(small.where("a <> b").distinct(), "star")
        discard(old)
        discard(down)
        now = state.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        n = now[0]
        if tuple(now) == mark:
            break
        mark = tuple(now)
    roots = state.select(F.col("a").alias("fp"), F.col("b").alias("root"))
    return roots.union(state.select("b", "b").distinct())


def named(by_fp: DataFrame, roots: DataFrame) -> DataFrame:
    """(fp, n, root, component_id) of each fingerprint of by_fp (fp, n, least), given the roots of those that are linked; component_id is
    the smallest least of a component. A component's members are dealt out as hot keys are if it is large."""
    linked = written(by_fp.join(roots, "fp"), "linked")
    groups = linked.groupBy("root").agg(F.min("least").alias("component_id"), F.count(F.lit(1)).alias("members"))
    members = join_groups(linked.select("fp", "root"), groups, "root", "members", linked.count()).select("fp", "root", "component_id")
    rows = by_fp.join(members, "fp", "left")
    own = F.col("root").isNull()
    return rows.select("fp", "n", F.coalesce("root", "fp").alias("root"), F.when(own, F.col("least")).otherwise(F.col("component_id")).alias("component_id"))


def grouped(docs: DataFrame, radius: int = RADIUS) -> DataFrame:
    """What near_duplicates returns, and root: a fingerprint that is the same for all of a component."""
    prints = written(fingerprints(docs), "fingerprints")
    by_fp = written(prints.groupBy("fp").agg(F.count(F.lit(1)).alias("n"), F.min("doc_id").alias("least")), "by-fingerprint")
    names = written(named(by_fp, components(links(by_fp.select("fp"), radius))), "components")
    total = by_fp.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    discard(by_fp)
    return join_groups(prints, names, "fp", "n", total).select("doc_id", "fp", "component_id", "root")


def near_duplicates(docs: DataFrame, radius: int = RADIUS) -> DataFrame:
    """A row for each row of docs: doc_id, fp (signed long), component_id (the smallest doc_id reachable over links).

    Null texts, empty texts and texts without words have fingerprint 0 and are linked like any other; null doc_ids are never
    the smallest unless a component has no other. Repeated rows keep their own rows. An empty table gives an empty result.
    """
    return grouped(docs, radius).drop("root")


def text_fingerprints(texts: pa.Array) -> np.ndarray:
    return np.array([fingerprint(x or b"") for x in texts.cast(pa.binary()).to_pylist()], np.uint64)


def _one_of_nulls(docs: DataFrame, found: DataFrame, prints: Callable[[pa.Array], np.ndarray]) -> DataFrame:
    """One row of each component that has null doc_ids alone: of its smallest fingerprint, the row of the smallest text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_chunks(batches, "text"):
            if batch.num_rows:
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(prints(batch.column("text")).view(np.int64))], [*batch.schema.names, "__fp"])

    schema = T.StructType([*docs.schema.fields, T.StructField("__fp", T.LongType())])
    rows = docs.where("doc_id is null").mapInArrow(run, schema)
    each = rows.groupBy("__fp").agg(F.min_by(F.struct(*[F.col(f"`{c}`") for c in docs.columns]), F.coalesce("text", F.lit(""))).alias("__row"))
    chosen = found.where("component_id is null").groupBy("root").agg(F.min("fp").alias("__fp")).select("__fp")
    return each.join(chosen, "__fp", "left_semi").select("__row.*")


def drop_near_duplicates(docs: DataFrame, find: Callable[[DataFrame], DataFrame] = grouped, prints: Callable[[pa.Array], np.ndarray] = text_fingerprints) -> DataFrame:
    """The rows of docs whose doc_id is the smallest of its component, and one row of each component without any doc_id, with all
    their columns. find says which component each row is of, by the fingerprints that prints gives texts."""
    found = find(docs)
    least = found.where("doc_id = component_id").select("doc_id").distinct()
    kept = docs.join(least, "doc_id", "left_semi").select(docs.columns)
    return kept.unionByName(_one_of_nulls(docs, found, prints))
