"""SimHash near-dedup by similarity: texts whose sets of five-word shingles are alike are linked.

Fingerprints here have 1,024 bits, as a similarity of 0.8 leaves some 15 in 100 of them apart and chance one half. As for the 64-bit ones,
equal fields of their bits say which texts meet; those are compared in tiles by exclusive-or and bit count, over the first 256 bits, and
what is within the radius is verified by the sets themselves. At so wide a radius no number of fields is sure to have an equal one, so
there are so many that hardly any pair has none.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyflow.functions.hashing import finalise
from tallyflow.llm.common import BLANKS, discard, join_groups, text_chunks, written
from tallyflow.llm.simhash import Tiles, components, named, whole_buckets

SHINGLE = 5
#: The least similarity (shared shingles over all) of a link, as a fraction.
SIMILARITY = (4, 5)
#: Fields of a fingerprint and bits of each. Two texts meet if a field is equal: a pair of similarity 0.8 has one with odds of over 0.9999999
#: (0.99995 for sets of four and five shingles), a closer one with more; unlike texts share one field in 2,048.
BANDS, BITS = 93, 11
#: Fields by which texts meet first: what fingerprints connect there is compared whole, and not again where other fields are equal.
FIRST = 8
#: Low bits of a bucket's key, which say the field that its texts share.
FIELD_BITS = 7
#: 64-bit words of a fingerprint, and of its part that is compared. Of 256 bits, 39 with a deviation of 6 differ at a similarity of 0.8 (48
#: for sets of four and five), 128 with one of 8 by chance.
ALL_WORDS, WORDS, RADIUS = 16, 4, 80
#: Of the first 128 bits, 20 differ at a similarity of 0.8 (24 with a deviation of 4.4 for sets of four and five), 64 by chance.
HALF_RADIUS = 50
#: Sets of FEW shingles or more that are similar enough are within CLOSE but for odds of some 1 in 100,000.
FEW, CLOSE = 30, 64
#: Texts of a bucket that are compared in one go; more are dealt out in blocks.
BLOCK, BLOCK_BYTES = 4096, 16 << 20
#: What is compared whole is cut into blocks of PART texts, for more tasks to share it, but into no more than PARTS for that.
PART, PARTS = 128, 24
#: Texts whose fields are written out at once.
SLICE = 1 << 14
#: Bits of the bounded filters that say which rows and which texts' sets may be needed.
FILTER = 1 << 21

_rng = np.random.default_rng(5)
_odd = lambda n: _rng.integers(0, 1 << 63, n, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_PLACE, _WORD = _odd(64), _odd(ALL_WORDS)


def shingle_sets(texts: pa.Array, k: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, sizes): each text's distinct shingle hashes in order, one text after the other, and how many each has.

    Words are runs of characters other than [\\x20\\x09-\\x0D], A-Z lower-cased; a text of fewer than k words has one shingle, of all
    its words; null texts and texts without words have none.
    """
    texts = pc.ascii_trim(pc.ascii_lower(pc.fill_null(texts, "")), BLANKS)
    empty = pc.equal(texts, "").to_numpy(zero_copy_only=False)
    split = pc.ascii_split_whitespace(texts)
    lengths = pc.list_value_length(split).to_numpy().astype(np.int64)
    coded = split.flatten().dictionary_encode()
    names = np.array([xxhash.xxh3_64_intdigest(w) for w in coded.dictionary.cast(pa.binary()).to_pylist()], np.uint64)
    word = names[coded.indices.to_numpy()]
    ends = np.cumsum(lengths)
    text = np.repeat(np.arange(len(lengths)), lengths)
    at = np.arange(len(word))
    starts = (at < (ends - lengths + np.maximum(1, lengths - k + 1))[text]) & ~empty[text]
    at, text = at[starts], text[starts]
    h = np.zeros(len(at), np.uint64)
    for j in range(k):
        inside = at + j < ends[text]
        h[inside] += word[at[inside] + j] * _PLACE[j]
    h = finalise(h)
    order = np.lexsort((h, text))
    h, text = h[order], text[order]
    new = np.r_[True, (h[1:] != h[:-1]) | (text[1:] != text[:-1])][: len(h)]
    return h[new], np.bincount(text[new], minlength=len(lengths))


def _sums(x: np.ndarray, sizes: np.ndarray, by: np.ufunc) -> np.ndarray:
    """by over each text's part of x, where sizes are all over zero."""
    return by.reduceat(x, np.cumsum(sizes) - sizes)


def set_hashes(h: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The hash of each text's set; 0 for an empty one."""
    out = np.zeros(len(sizes), np.uint64)
    some = sizes > 0
    if some.any():
        out[some] = finalise(_sums(finalise(h ^ _PLACE[-1]), sizes[some], np.add) ^ sizes[some].astype(np.uint64) * _PLACE[-2])
    return out


def field_keys(prints: np.ndarray) -> np.ndarray:
    """For each fingerprint of ALL_WORDS words, a key of each field: which one it is, and its bits."""
    bits = np.unpackbits(np.ascontiguousarray(prints, "<u8").view(np.uint8), axis=1, count=BANDS * BITS, bitorder="little")
    values = bits.reshape(len(prints), BANDS, BITS) @ (1 << np.arange(BITS)).astype(np.int64)
    return values + (np.arange(BANDS) << BITS)


def wide_prints(h: np.ndarray, sizes: np.ndarray, words: int = WORDS) -> np.ndarray:
    """A row of words for each text that has shingles: a bit is set if it is in over half of the set's hashes. Eight bits are counted
    at once, each in a byte of its own, over at most 255 hashes."""
    sizes = sizes[sizes > 0]
    first = np.cumsum(sizes) - sizes
    cuts = -(-sizes // 255)
    owner = np.repeat(np.arange(len(sizes)), cuts)
    start = first[owner] + 255 * (np.arange(len(owner)) - (np.cumsum(cuts) - cuts)[owner])
    out = np.zeros((len(sizes), words), np.uint64)
    lanes = np.uint64(0x0101010101010101)
    for w in range(words):
        hashed = finalise(h ^ _WORD[w])
        for j in range(8):
            counted = np.add.reduceat(hashed >> np.uint64(j) & lanes, start).view(np.uint8).reshape(-1, 8)
            ones = np.add.reduceat(counted, np.cumsum(cuts) - cuts, axis=0, dtype=np.int64)
            for lane in range(8):
                out[:, w] |= (2 * ones[:, lane] > sizes).astype(np.uint64) << np.uint64(j + 8 * lane)
    return out


def _signed(x: np.ndarray) -> pa.Array:
    return pa.array(np.ascontiguousarray(x).view(np.int64))


_PRINT = [f"p{w}" for w in range(WORDS)]


def _read(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_chunks(batches, "text"):
            if not batch.num_rows:
                continue
            h, sizes = shingle_sets(batch.column("text"), k)
            ends = np.r_[0, np.cumsum(sizes)]
            for i in range(0, len(sizes), SLICE):
                part = sizes[i : i + SLICE]
                own, some = h[ends[i] : ends[i + len(part)]], part > 0
                prints = np.zeros((len(part), ALL_WORDS), np.uint64)
                if len(own):
                    prints[some] = wide_prints(own, part, ALL_WORDS)
                edges = np.r_[0, np.cumsum(np.where(some, BANDS, 0))].astype(np.int32)
                keys = pa.ListArray.from_arrays(pa.array(edges), pa.array(field_keys(prints[some]).ravel()))
                columns = [batch.column("doc_id").slice(i, len(part)), _signed(set_hashes(own, part)), pa.array(part.astype(np.int64)), keys, *map(_signed, prints[:, :WORDS].T)]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "fp", "n_shingles", "bands", *_PRINT])

    return run


def _rows(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))


def text_prints(texts: pa.Array) -> np.ndarray:
    """The hash of each text's set of shingles."""
    return set_hashes(*shingle_sets(texts))


def _held(batch: pa.RecordBatch, rows: np.ndarray) -> pa.RecordBatch:
    ids = batch.column("doc_id")
    return batch.filter(pc.or_(pc.is_null(ids), pa.array(rows[pc.fill_null(ids, 0).to_numpy() & FILTER - 1])))


def _sets_of(wanted: np.ndarray, rows: np.ndarray | None, k: int):
    """(fp, shingles) of the texts whose fp is in the filter; of rows whose doc_id is null or in the other filter, if there is one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_chunks(batches if rows is None else (_held(b, rows) for b in batches), "text"):
            h, sizes = shingle_sets(batch.column("text"), k) if batch.num_rows else (np.zeros(0, np.uint64), np.zeros(0, np.int64))
            fps, ends = set_hashes(h, sizes), np.cumsum(sizes)
            at = np.flatnonzero(wanted[(fps % np.uint64(FILTER)).astype(np.int64)] & (sizes > 0))
            at = at[np.unique(fps[at], return_index=True)[1]]
            if len(at):
                held = pa.array([h[ends[i] - sizes[i] : ends[i]].tobytes() for i in at], pa.binary())
                yield pa.RecordBatch.from_arrays([_signed(fps[at]), held], ["fp", "shingles"])

    return run


def _or_fp(table: pa.Table, column: str) -> np.ndarray:
    return pc.coalesce(table.column(column), table.column("fp")).to_numpy()


def met_before(differ: np.ndarray, field: np.ndarray) -> np.ndarray:
    """Whether two fingerprints, given by what differs in their first WORDS words, have an equal field there before the given one."""
    out = np.zeros(len(field), bool)
    for f in range(min(64 * WORDS // BITS, int(field.max(initial=0)))):
        w, at = divmod(f * BITS, 64)
        bits = differ[:, w] >> np.uint64(at)
        if at + BITS > 64:
            bits |= differ[:, w + 1] << np.uint64(64 - at)
        out |= (f < field) & (bits & np.uint64((1 << BITS) - 1) == 0)
    return out


def _near_pairs(table: pa.Table, similarity: tuple[int, int], once: bool) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(x, y): rows of one bucket that were not compared before (seen differs), whose fingerprints are within the radius and whose sets' sizes
    allow for the similarity. Tiles are compared by half of the words, and what is near there by all. once: a pair is left to the bucket of
    the first field it shares, as far as the compared words show; it meets there, as all buckets are compared whole."""
    key, n = (table.column(c).to_numpy() for c in ("key", "n_shingles"))
    seen, field = _or_fp(table, "seen"), key & (1 << FIELD_BITS) - 1
    prints = np.stack([table.column(c).to_numpy().view(np.uint64) for c in _PRINT], axis=1)
    tiles = Tiles(key, prints[:, : WORDS // 2], HALF_RADIUS)
    for i, j, near in tiles.pairs():
        x, y = np.nonzero(near)
        x, y = tiles.order[x + i], tiles.order[y + j]
        least, most = np.minimum(n[x], n[y]), np.maximum(n[x], n[y])
        some = (key[x] == key[y]) & (seen[x] != seen[y]) & (least * similarity[1] >= most * similarity[0])
        x, y, least = x[some], y[some], least[some]
        apart = prints[x] ^ prints[y]
        differ = np.bitwise_count(apart).sum(axis=1, dtype=np.int64)
        some = np.flatnonzero(differ <= np.where(least < FEW, RADIUS, CLOSE))
        if once:
            some = some[~met_before(apart[some], field[x[some]])]
        if len(some):
            yield x[some], y[some]


def _joined(label: np.ndarray, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Labels of components, each the least row of its own, once rows x and y are connected too."""
    while (apart := label[x] != label[y]).any():
        x, y = x[apart], y[apart]
        np.minimum.at(label, np.maximum(label[x], label[y]), np.minimum(label[x], label[y]))
        while (label[label] != label).any():
            label = label[label]
    return label


def _near_groups(similarity: tuple[int, int], once: bool, block: int):
    """From rows (key, fp, n_shingles, seen, print) sorted by key: of each bucket, the rows that fingerprints within the radius connect to
    others they were not compared with, with a key of the group, its least fp, and the blocks it is to be cut into."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in whole_buckets(batches):
            label, found, held = np.arange(table.num_rows), [], 0
            for x, y in _near_pairs(table, similarity, once):
                found.append((x, y))
                held += len(x)
                if held > BLOCK * 64:
                    label, found, held = _joined(label, *map(np.concatenate, zip(*found, strict=True))), [], 0
            if found:
                label = _joined(label, *map(np.concatenate, zip(*found, strict=True)))
            some = np.flatnonzero((np.bincount(label, minlength=len(label)) > 1)[label])
            if not len(some):
                continue
            some = some[np.argsort(label[some], kind="stable")]
            new = np.flatnonzero(np.r_[True, label[some][1:] != label[some][:-1]])
            size = np.diff(np.r_[new, len(some)])
            fp, key, least, low = table.column("fp").to_numpy(), table.column("key").to_numpy(), label[some][new], np.uint64((1 << FIELD_BITS) - 1)
            name = finalise(key[least].view(np.uint64) * _PLACE[0] + finalise(fp[least].view(np.uint64))) & ~low | key[least].view(np.uint64) & low
            held = np.add.reduceat(table.column("n_shingles").to_numpy()[some], new) * 8
            blocks = np.maximum(-(-size // block), -(-held // BLOCK_BYTES))
            of_group = [pa.array(np.repeat(c, size)) for c in (name.view(np.int64), np.minimum.reduceat(fp[some], new), blocks)]
            rows = table.select(["fp", "n_shingles", "seen", *_PRINT]).take(pa.array(some)).combine_chunks()
            yield pa.RecordBatch.from_arrays([*of_group, *(pa.concat_arrays(c.chunks) for c in rows.columns)], ["key", "lo", "blocks", *rows.column_names])

    return run


def _linked(similarity: tuple[int, int], once: bool):
    """From rows (key, fp, n_shingles, seen, root, print, shingles) sorted by key: links that connect what pairs of a bucket connect whose
    fingerprints are within the radius and whose sets are as similar as asked. A row is verified against all its near ones of a tile at
    once, but for those that are known to be connected with it (the same root, or links found here)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in whole_buckets(batches, size=8 << 20):
            fp, sets, out = table.column("fp").to_numpy(), table.column("shingles").combine_chunks(), []
            _, label = np.unique(_or_fp(table, "root"), return_inverse=True)
            size = pc.binary_length(sets).to_numpy().astype(np.int64) // 8
            first, names = np.cumsum(size) - size, None
            for x, y in _near_pairs(table, similarity, once):
                if names is None:
                    h = np.frombuffer(b"".join(sets.to_pylist()), "<u8")
                    names = np.unique(h, return_inverse=True)[1].astype(np.int32)
                    mine = np.zeros(int(names.max(initial=0)) + 1, np.int8)
                order = np.argsort(x, kind="stable")
                x, y = x[order], y[order]
                piece = np.cumsum(size[y]) >> 20  # of sets that are laid out at once
                for row in np.split(np.arange(len(x)), np.flatnonzero((x[1:] != x[:-1]) | (piece[1:] != piece[:-1])) + 1):
                    a, b = int(x[row[0]]), y[row]
                    b = b[label[b] != label[a]]
                    if not len(b):
                        continue
                    own, ends = names[first[a] : first[a] + size[a]], np.cumsum(size[b])
                    mine[own] = 1
                    at = np.arange(ends[-1]) + np.repeat(first[b] - ends + size[b], size[b])
                    both = np.add.reduceat(mine[names[at]], ends - size[b], dtype=np.int64)
                    mine[own] = 0
                    b = b[both * similarity[1] >= (size[a] + size[b] - both) * similarity[0]]
                    if len(b):
                        found, which = np.unique(label[b], return_index=True)
                        out += [(min(fp[a], fp[c]), max(fp[a], fp[c])) for c in b[which]]
                        label[np.isin(label, found)] = label[a]
            if out:
                yield pa.RecordBatch.from_arrays([*map(pa.array, np.array(out, np.int64).T.copy())], ["a", "b"])

    return run


def in_blocks(rows: DataFrame) -> DataFrame:
    """rows (key, field, blocks, ...), where blocks says how many its bucket is cut into, once for each key of at most two blocks in which a
    row meets others: every two rows of a bucket meet, in tasks of bounded size however large it is. The low bits of a key are the field."""
    own = F.pmod(F.xxhash64("fp"), F.col("blocks"))
    met = F.transform(
        F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1),
        lambda j: F.shiftleft(F.xxhash64("key", F.least(own, j), F.greatest(own, j)), FIELD_BITS).bitwiseOR(F.col("field")),
    )
    return rows.select(F.explode(met).alias("key"), *[c for c in rows.columns if c not in ("key", "field", "blocks")])


def _filter(rows: DataFrame, column: str) -> np.ndarray:
    """FILTER bits, set at what the column has modulo FILTER."""
    out = np.zeros(FILTER, bool)
    out[rows.select(F.col(column).bitwiseAND(F.lit(FILTER - 1)).alias("x")).where("x is not null").distinct().toPandas()["x"].to_numpy(np.int64)] = True
    return out


def links(docs: DataFrame, sets_of: DataFrame, k: int = SHINGLE, similarity: tuple[int, int] = SIMILARITY, block: int = BLOCK) -> DataFrame:
    """(a, b): pairs of set hashes, each verified by the sets themselves, that connect what similar pairs in a common bucket connect.
    sets_of: a row for each distinct set (fp, n_shingles, bands, p0..); with a column least, the doc_id of a row that has the set, fewer
    texts are read again.

    First, of the texts that share one of FIRST fields, those are found that fingerprints within the radius connect. What they connect
    is compared whole, tile by tile, and verified where it lies: a text goes there once for each block, not once for each field and group.
    (Where that were more rows than PARTS a text and than the buckets hold, the buckets are compared.) Then texts meet by all fields, and
    pairs within the radius that were not compared yet are verified in their buckets, each where it first meets. Buckets that hold many
    texts are cut into blocks for the tiles.
    """
    prints = ", ".join(f"{p} long" for p in _PRINT)

    def near(rows: DataFrame, bands: Column, once: bool) -> DataFrame:
        keyed = rows.select("fp", "n_shingles", "seen", *_PRINT, F.explode(bands).alias("key"))
        large = keyed.groupBy("key").agg(F.ceil(F.count(F.lit(1)) / block).cast("long").alias("blocks")).where("blocks > 1")  # there are 93 * 2,048 keys
        dealt = keyed.join(F.broadcast(large), "key", "left").withColumns({"blocks": F.coalesce("blocks", F.lit(1).cast("long")), "field": F.shiftright("key", BITS)})
        found = in_blocks(dealt).repartition("key").sortWithinPartitions("key").mapInArrow(_near_groups(similarity, once, block), f"key long, lo long, blocks long, fp long, n_shingles long, seen long, {prints}")
        return written(found.withColumn("field", F.col("key").bitwiseAND(F.lit((1 << FIELD_BITS) - 1))), "shared")

    def verified(rows: DataFrame, once: bool) -> DataFrame:
        """rows: key, field, blocks, fp, n_shingles, seen, root, print."""
        fps = rows.select("fp").distinct()
        ids = _filter(sets_of.join(fps, "fp", "left_semi"), "least") if "least" in sets_of.columns else None
        sets = _rows(docs).mapInArrow(_sets_of(_filter(fps, "fp"), ids, k), "fp long, shingles binary").groupBy("fp").agg(F.first("shingles").alias("shingles"))
        dealt = in_blocks(rows.join(sets, "fp")).repartition("key").sortWithinPartitions("key")
        return written(dealt.mapInArrow(_linked(similarity, once), "a long, b long").distinct(), "links")

    none = F.lit(None).cast("long")
    shared = near(sets_of.withColumn("seen", none), F.slice("bands", 1, FIRST), False)
    least = F.min("lo").over(Window.partitionBy("fp"))  # a text has a row for each field and block; its groups are connected to the least one
    edges = shared.select("fp", "lo", least.alias("m")).select(F.explode(F.array(F.struct(F.col("fp").alias("a"), F.col("m").alias("b")), F.struct(F.col("lo").alias("a"), F.col("m").alias("b")))).alias("x")).select("x.*").distinct()
    one_each = shared.groupBy("fp").agg(F.sum("blocks").alias("rows"), *[F.first(c).alias(c) for c in ("n_shingles", *_PRINT)])
    group = written(one_each.join(components(edges).withColumnRenamed("root", "group"), "fp"), "groups")
    n, held = F.count(F.lit(1)), F.sum("n_shingles") * 8
    parts = F.greatest(F.least(F.ceil(n / min(PART, block)), F.lit(PARTS)), F.ceil(n / block), F.ceil(held / BLOCK_BYTES)).cast("long")
    size = group.groupBy("group").agg(n.alias("n"), F.sum("rows").alias("by_bucket"), parts.alias("blocks"))
    size = size.withColumn("whole", (F.col("blocks") <= PARTS) | (F.col("blocks") * F.col("n") <= F.col("by_bucket"))).drop("by_bucket")
    group = written(join_groups(group, size, "group", "n", max(1, group.count())).drop("n", "rows"), "groups")
    whole = group.where("whole").select(F.col("group").alias("key"), F.lit(0).cast("long").alias("field"), "blocks", "fp", "n_shingles", none.alias("seen"), none.alias("root"), *_PRINT)
    large = shared.join(group.where("not whole").select("fp"), "fp", "left_semi").select("key", "field", "blocks", "fp", "n_shingles", "seen", none.alias("root"), *_PRINT)
    one = verified(whole.unionByName(large), False)
    roots = written(components(one), "roots")
    seen = group.join(roots, "fp", "left").select("fp", F.when(F.col("whole"), F.col("group")).otherwise(F.col("root")).alias("seen"))
    discard(shared)
    shared = near(sets_of.join(seen, "fp", "left"), F.col("bands"), True)
    two = verified(shared.drop("lo").join(roots, "fp", "left"), True)
    for gone in (shared, group, roots):
        discard(gone)
    return one.unionByName(two)


def near_copies(docs: DataFrame, k: int = SHINGLE, similarity: tuple[int, int] = SIMILARITY) -> DataFrame:
    """A row for each row of docs: doc_id, fp (of the set of shingles), component_id (the smallest doc_id reachable over links), root
    (the same fp for all of a component).

    Texts with one set of shingles are one group; null texts and texts without words have the empty set. Null doc_ids are never the
    smallest unless a component has no other. Repeated rows keep their own rows. An empty table gives an empty result.
    """
    prints = ", ".join(f"{p} long" for p in _PRINT)
    found = written(_rows(docs).mapInArrow(_read(k), f"doc_id long, fp long, n_shingles long, bands array<long>, {prints}"), "shingle-prints")
    by_fp = written(found.groupBy("fp").agg(F.count(F.lit(1)).alias("n"), F.min("doc_id").alias("least"), *[F.first(c).alias(c) for c in ("n_shingles", "bands", *_PRINT)]), "by-set")
    names = written(named(by_fp.select("fp", "n", "least"), components(links(docs, by_fp, k, similarity))), "components")
    total = by_fp.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    discard(by_fp)
    return join_groups(found.select("doc_id", "fp"), names, "fp", "n", total).select("doc_id", "fp", "component_id", "root")
