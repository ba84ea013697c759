"""Line dedup: a line that many documents hold stays in one of them. Only hashes travel, and per-document keep bitmaps come back."""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyflow.llm.common import text_chunks, written

#: Shorter keys (in code points) are never dropped; nor are keys found in fewer documents.
MIN_CHARS = 40
MIN_DOCS = 5
BLANKS = b" \t\n\x0b\x0c\r"


def keys_of(text: bytes, min_chars: int = MIN_CHARS) -> list[tuple[int, bytes]]:
    """(position, 16-byte hash) of each line whose key, stripped of blanks and with A-Z lower-cased, is long enough."""
    out = []
    for i, line in enumerate(text.split(b"\n")):
        key = line.strip(BLANKS).lower()
        if len(key) >= min_chars and (key.isascii() or len(key.decode()) >= min_chars):
            out.append((i, xxhash.xxh3_128_digest(key)))
    return out


def _lines(min_chars: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_chunks(batches, "text"):
            hashes, sizes, at = [], [], []
            for text in batch.column("text").cast(pa.binary()).to_pylist():
                found = keys_of(text or b"", min_chars)
                hashes += [h for _, h in found]
                at += [i for i, _ in found]
                sizes.append(len(found))
            wide = np.frombuffer(b"".join(hashes), ">i8").reshape(-1, 2).astype(np.int64)
            doc, row = (np.repeat(batch.column(c).to_numpy(), sizes) for c in ("doc", "row"))
            yield pa.RecordBatch.from_arrays([*map(pa.array, (wide[:, 0], wide[:, 1], doc, row)), pa.array(at, pa.int32())], ["h1", "h2", "doc", "row", "at"])

    return run


#: What the streaming pass says of a line: it goes; it is held until the neighbouring partitions are heard; or a summary of such a key.
DROPPED, HELD, SUMMARY = 0, 1, 2


class _Stream:
    """Goes over a partition sorted by (h1, h2, doc descending, row, at) and says which lines go.

    A key's first document keeps its lines. The others' are buffered until min_docs documents are seen; from then on they stream, so no
    more is held than min_docs documents have. The first key of a partition may have begun before it, the last may go on after
    it: for these a SUMMARY is given, and lines that can't be decided here are passed on as HELD.
    """

    def __init__(self, min_docs: int):
        self.min_docs, self.key, self.first = min_docs, None, True

    def out(self, kind: int, part: list[np.ndarray], pick=slice(None), docs: int = 0) -> pa.RecordBatch:
        h1, h2, doc, row, at = (x[pick] for x in part)
        n = len(h1)
        return pa.RecordBatch.from_arrays([pa.array(np.full(n, kind, np.int32)), *map(pa.array, (h1, h2, doc, row, at)), pa.array(np.full(n, docs, np.int32))], ["kind", "h1", "h2", "doc", "row", "at", "docs"])

    def end(self, last: bool) -> Iterator[pa.RecordBatch]:
        if self.key is not None and (self.first or last):
            yield self.out(SUMMARY, [np.array([x], np.int64) for x in (*self.key, self.top, 0)] + [np.zeros(1, np.int32)], docs=self.docs)
            for p in self.kept:
                yield self.out(HELD, p)
        if self.key is not None:
            self.first = False

    def feed(self, part: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        """Rows of one key."""
        doc, key = part[2], (int(part[0][0]), int(part[1][0]))
        if key != self.key:
            yield from self.end(False)
            self.key, self.top, self.last, self.docs, self.kept = key, int(doc[0]), None, 0, []
        self.docs += int((doc[1:] != doc[:-1]).sum()) + (self.last != int(doc[0]))
        self.last = int(doc[-1])
        if self.first:
            yield self.out(HELD, part)
        elif self.docs < self.min_docs:
            self.kept.append(part)
        else:
            for p in (*self.kept, part):
                if (go := p[2] != self.top).any():
                    yield self.out(DROPPED, p, go)
            self.kept = []

    def run(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            c = [batch.column(n).to_numpy() for n in ("h1", "h2", "doc", "row", "at")]
            new = np.r_[True, (c[0][1:] != c[0][:-1]) | (c[1][1:] != c[1][:-1])]
            edge = np.flatnonzero(new)
            a, b = (int(edge[1]), int(edge[-1])) if len(edge) > 1 else (len(new), len(new))
            yield from self.feed([x[:a] for x in c])
            if a < b:  # keys that begin and end in this batch, all at once
                yield from self.end(False)
                self.key = None
                inner = [x[a:b] for x in c]
                start = edge[1:-1] - a
                changed = new[a:b] | np.r_[True, inner[2][1:] != inner[2][:-1]]
                sizes = np.diff(np.r_[start, b - a])
                many = np.repeat(np.add.reduceat(changed.astype(np.int64), start) >= self.min_docs, sizes)
                if (go := many & (inner[2] != np.repeat(inner[2][start], sizes))).any():
                    yield self.out(DROPPED, inner, go)
            if b < len(new):
                yield from self.feed([x[b:] for x in c])
        yield from self.end(True)


def keep_bitmaps(docs: DataFrame, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS) -> DataFrame:
    """(doc, row, n_dropped, keep_bitmap) of each document that loses lines. No text leaves the first pass over the documents.

    Lines travel as 128-bit hashes with document and position, range-partitioned by (hash, document): a key that a third of all
    documents hold covers several partitions instead of one. Of each partition at most two keys touch its neighbours; their
    summaries, two rows a partition at most, are merged and broadcast to the lines that wait for them.
    """
    rows = docs.select(_doc().alias("doc"), F.xxhash64("text").alias("row"), F.col("text").cast("string").alias("text"))
    lines = written(rows.mapInArrow(_lines(min_chars), "h1 long, h2 long, doc long, row long, at int"), "lines")
    order = [F.col("h1"), F.col("h2"), F.col("doc").desc()]
    dealt = lines.repartitionByRange(*order).sortWithinPartitions(*order, "row", "at")
    schema = "kind int, h1 long, h2 long, doc long, row long, at int, docs int"
    said = written(dealt.mapInArrow(lambda batches: _Stream(min_docs).run(batches), schema), "line-decisions")
    edges = said.where(F.col("kind") == SUMMARY).groupBy("h1", "h2").agg(F.max("doc").alias("top"), F.sum("docs").alias("n")).where(F.col("n") >= min_docs)
    held = said.where(F.col("kind") == HELD).join(F.broadcast(edges), ["h1", "h2"]).where("doc <> top")
    gone = said.where(F.col("kind") == DROPPED).select("doc", "row", "at").unionByName(held.select("doc", "row", "at"))
    return gone.groupBy("doc", "row").agg(F.collect_set("at").alias("drops")).mapInArrow(_bitmaps, "doc long, row long, n_dropped long, keep_bitmap binary")


def _doc():
    """Null doc_ids count as one document below all others."""
    return F.coalesce(F.col("doc_id").cast("long"), F.lit(-(1 << 63)))


def keep_bitmap(drops) -> bytes:
    """Compressed bits, one for each line up to the last that goes and on to whole bytes, set where the line stays."""
    keep = np.ones(max(drops) // 8 * 8 + 8, bool)
    keep[drops] = False
    return zlib.compress(np.packbits(keep).tobytes())


def _bitmaps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        drops = batch.column("drops").to_pylist()
        yield pa.RecordBatch.from_arrays([batch.column("doc"), batch.column("row"), pa.array(map(len, drops), pa.int64()), pa.array(map(keep_bitmap, drops), pa.binary())], ["doc", "row", "n_dropped", "keep_bitmap"])


def kept_lines(text: bytes, bitmap: bytes | None) -> bytes:
    """The lines that stay, joined by \\n; all without a bitmap."""
    if bitmap is None:
        return text
    lines = text.split(b"\n")
    keep = np.unpackbits(np.frombuffer(zlib.decompress(bitmap), np.uint8))[: len(lines)].tolist()
    return b"\n".join([*(x for x, k in zip(lines, keep, strict=False) if k), *lines[len(keep) :]])


def line_dedup(docs: DataFrame, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS, digest: bool = False) -> DataFrame:
    """A row for each row of docs: doc_id, n_lines, n_dropped, keep_bitmap (null if all lines stay; see kept_lines); with digest also
    kept_sha256 of the lines that stay, for which alone texts and bitmaps are joined.

    Null and empty texts are one empty line. Rows that repeat (same doc_id and text) are one document and lose the same lines;
    rows that share a doc_id alone are one document with lines in both. Null doc_ids count as one document. An empty table gives an
    empty result. Texts and lines of any length are read whole.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    n_lines = (F.octet_length(text) - F.octet_length(F.replace(text, F.lit("\n"), F.lit(""))) + 1).cast("long")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), _doc().alias("doc"), F.xxhash64("text").alias("row"), n_lines.alias("n_lines"), *([text.alias("text")] if digest else []))
    found = rows.join(keep_bitmaps(docs, min_chars, min_docs), ["doc", "row"], "left").withColumn("n_dropped", F.coalesce("n_dropped", F.lit(0).cast("long"))).drop("doc", "row")
    if not digest:
        return found.select("doc_id", "n_lines", "n_dropped", "keep_bitmap")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_chunks(batches, "text"):
            texts, bitmaps = batch.column("text").cast(pa.binary()), batch.column("keep_bitmap").to_pylist()
            kept = [hashlib.sha256(kept_lines(t.as_py(), b)).hexdigest() for t, b in zip(texts, bitmaps, strict=True)]
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in ("doc_id", "n_lines", "n_dropped", "keep_bitmap")], pa.array(kept, pa.string())], ["doc_id", "n_lines", "n_dropped", "keep_bitmap", "kept_sha256"])

    return found.mapInArrow(run, "doc_id long, n_lines long, n_dropped long, keep_bitmap binary, kept_sha256 string")
