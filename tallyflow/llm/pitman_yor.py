"""Hierarchical Pitman-Yor language model: a restaurant for each previous word, all sharing one parent; Gibbs moves take customers out
and seat them again, and the predictive probabilities of the sampled seatings are averaged.

A move takes all customers of one word in one restaurant out and seats them again by their exact law given everyone else, so a round moves
every customer, however many a word has. Which of a word's tables they sit at changes no probability, only how many tables there are, so
that number is what is drawn and kept.

Restaurants are dealt out in buckets by their context's hash, so a task holds whole restaurants; those with very many pairs are cut into
parts by word, and the totals of their parts are summed each round. The parent is dealt out in buckets by word: after a round, buckets of
contexts send it how many tables serve each word that has moved, and it sends back what these words have there. A word that follows a
context once has one table there whatever is drawn, so only pairs that were seen twice or more are moved and sent. A round sees the totals
of the round before. What is sent goes in a packed row for each sender and receiver that have something to say to each other.

Every draw is a hash of seed, round, context and word. Sums that draws depend on are of whole numbers. So how tables are cut into files,
chunks, buckets and parts changes nothing in the result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyflow.functions.hashing import finalise
from tallyflow.llm.common import discard, document_bucket, text_chunks, trim, written

FOLDS, HELD_OUT = 7, 2
#: Rounds whose seatings are forgotten, and rounds whose predictive probabilities are averaged.
BURN_IN, SAMPLES = 1, 2
#: Customers up to which the ways to seat them are added up one customer at a time; of more they are integrals.
ADDED = 512
#: Numbers of tables that are looked at first, and numbers held at once in drawing them.
FIRST_TABLES, BLOCK = 8, 1 << 20
#: Strengths of the context restaurants and of their parent. Discounts are estimated from counts of counts, in units of 1 / UNIT.
STRENGTH, PARENT_STRENGTH = 0.5, 1.0
UNIT = 1024
#: The end of a text as a word, and its start as a context: no words, as they are blanks.
END, START = xxhash.xxh3_64_intdigest(b"\n"), xxhash.xxh3_64_intdigest(b" ")
CHUNK = 7 << 20
#: UTF-8 bytes of text that one bucket of contexts, or of words, stands for.
BYTES_A_BUCKET = 12 << 20
#: A context with more pairs (counted once a chunk) is cut into parts of about so many. The contexts cut are at most CUT, whatever the
#: input: beyond LIMIT * CUT pairs the parts grow instead.
LIMIT, CUT = 1 << 18, 1 << 20
#: Words that go by a short number where pairs are dealt out.
BOOK = 1 << 16
#: A context's pairs in a chunk are reported for that if they are so many, or by lot.
LOT = 64


def pack(x: np.ndarray) -> bytes:
    """Compressed bytes, the low bytes of all numbers first; small arrays as they are."""
    x = np.ascontiguousarray(x)
    if x.nbytes < 256:
        return b"\0" + x.tobytes() if len(x) else b""
    return b"\1" + zstandard.ZstdCompressor(level=1).compress(x.view(np.uint8).reshape(len(x), x.itemsize).T.tobytes())


def unpack(data: bytes | None, kind) -> np.ndarray:
    kind = np.dtype(kind)
    if not data:
        return np.zeros(0, kind)
    if data[0] == 0:
        return np.frombuffer(data, kind, offset=1)
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(memoryview(data)[1:]), np.uint8)
    return np.ascontiguousarray(raw.reshape(kind.itemsize, -1).T).view(kind).ravel()


def _batch(rows: list[tuple], names: list[str], kinds: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)


def _sums(index: np.ndarray, values: np.ndarray, n: int) -> np.ndarray:
    return np.bincount(index, weights=values, minlength=n).astype(np.int64)


# --- texts

_READ = "chunk long, ids binary, lengths binary, learn binary, words binary, stream binary"


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From (doc_id, learn, text) batches: a row for each chunk, with its distinct words' hashes in order and its texts as positions among
    them, each text closed by the end."""
    part, seq = TaskContext.get().partitionId(), 0
    for batch in text_chunks(batches, "text", CHUNK):
        if not batch.num_rows:
            continue
        texts = pc.ascii_trim(pc.ascii_lower(pc.fill_null(batch.column("text"), "")), " \t\n\x0b\x0c\r")
        empty = pc.equal(texts, "").to_numpy(zero_copy_only=False)
        split = pc.ascii_split_whitespace(texts)
        sizes = pc.list_value_length(split).to_numpy().astype(np.int64)
        flat = split.flatten()
        if empty.any():
            flat = flat.filter(pa.array(np.repeat(~empty, sizes)))
            sizes = np.where(empty, 0, sizes)
        coded = flat.dictionary_encode()
        hashes = np.array([*map(xxhash.xxh3_64_intdigest, coded.dictionary.cast(pa.binary()).to_pylist()), END], np.uint64)
        words, rank = np.unique(hashes, return_inverse=True)
        lengths = sizes + 1
        ends = np.cumsum(lengths) - 1
        stream = np.empty(int(lengths.sum()), np.uint32)
        inner = np.ones(len(stream), bool)
        inner[ends] = False
        stream[inner] = rank[coded.indices.to_numpy()]
        stream[ends] = rank[-1]
        ids = batch.column("doc_id")
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, pa.schema([("doc_id", ids.type)])) as writer:
            writer.write_batch(pa.RecordBatch.from_arrays([ids], ["doc_id"]))
        learn = np.packbits(batch.column("learn").to_numpy(zero_copy_only=False))
        row = ((part << 32) + seq, sink.getvalue().to_pybytes(), pack(lengths.astype(np.uint32)), learn.tobytes(), pack(words), pack(stream))
        seq += 1
        yield _batch([row], [x.split()[0] for x in _READ.split(", ")], [pa.int64(), *[pa.binary()] * 5])


class Chunk:
    """A chunk's texts: its contexts (hashes in order), words, and distinct (context, word) pairs sorted by both."""

    def __init__(self, row: dict):
        self.words = unpack(row["words"], "<u8")
        self.lengths = unpack(row["lengths"], "<u4").astype(np.int64)
        self.word = unpack(row["stream"], "<u4").astype(np.int64)
        self.starts = np.r_[0, np.cumsum(self.lengths)[:-1]]
        place = int(np.searchsorted(self.words, np.uint64(START)))  # the start is a context besides the words
        self.contexts = np.insert(self.words, place, np.uint64(START))
        context = np.empty(len(self.word), np.int64)
        context[1:] = self.word[:-1]
        context += context >= place
        context[self.starts] = place
        context *= len(self.words)
        context += self.word
        self.pairs, self.stream = np.unique(context, return_inverse=True)
        del context
        self.context, self.of = self.pairs // len(self.words), self.pairs % len(self.words)
        learn = np.unpackbits(np.frombuffer(row["learn"], np.uint8), count=len(self.lengths)).astype(bool)
        self.counts = np.bincount(self.stream[np.repeat(learn, self.lengths)], minlength=len(self.pairs))


def _rows_of(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    for batch in batches:
        for i in range(batch.num_rows):
            yield batch.slice(i, 1).to_pylist()[0]
            trim()


def _signed(x: np.ndarray) -> pa.Array:
    return pa.array(np.ascontiguousarray(x).view(np.int64))


def _context_sizes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(context, n): how many pairs each context has in a chunk; of fewer than LOT, LOT with odds n / LOT. The sums are right on average,
    which is enough to tell which contexts to cut."""
    for r in _rows_of(batches):
        c = Chunk(r)
        n = np.bincount(c.context, minlength=len(c.contexts))
        lot = draw(c.contexts ^ np.uint64(r["chunk"]), 7) * LOT < n
        some = (n >= LOT) | lot
        yield pa.RecordBatch.from_arrays([_signed(c.contexts[some]), pa.array(np.maximum(n[some], LOT))], ["context", "n"])


def part_of(contexts: np.ndarray, words: np.ndarray, cut: dict[int, int]) -> np.ndarray:
    """The part that a pair is in: 0 but for contexts that are cut."""
    if not cut:
        return np.zeros(len(contexts), np.int64)
    known = np.array(sorted(cut), np.uint64)
    at = np.minimum(np.searchsorted(known, contexts), len(known) - 1)
    parts = np.where(known[at] == contexts, np.array([cut[int(k)] for k in known], np.uint64)[at], np.uint64(1))
    return (finalise(words) % parts).astype(np.int64)


def bucket_of(contexts: np.ndarray, words: np.ndarray, cut: dict[int, int], buckets: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        return (finalise(contexts + part_of(contexts, words, cut).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) % np.uint64(buckets)).astype(np.int64)


def word_bucket(words: np.ndarray, buckets: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        return (finalise(words * np.uint64(0x9E3779B97F4A7C15)) % np.uint64(buckets)).astype(np.int64)


#: What is sent: kind 1 beside the rows of kind 0 of whatever table it goes with.
_MAIL = "kind int, to long, sender long, names binary, x binary, y binary, z binary"


def _mail(to: np.ndarray, sender: int, names: np.ndarray, *values: np.ndarray) -> list[tuple]:
    """Packed rows for each receiver; names and values keep their order."""
    order = np.argsort(to, kind="stable")
    to = to[order]
    edges = np.r_[np.flatnonzero(np.r_[True, to[1:] != to[:-1]])[: len(to)], len(to)]
    cols = [names[order], *(v[order] for v in values)]
    return [(1, int(to[a]), sender, *[pack(c[a:b]) for c in cols], *[None] * (4 - len(cols))) for a, b in zip(edges, edges[1:], strict=False) if b > a]


def _opened(mail: list[dict], *kinds: str) -> list[np.ndarray]:
    """The names and values of all that was received, put together."""
    return [np.concatenate([np.zeros(0, k), *(unpack(m[c], k) for m in mail)]) for c, k in zip(("names", "x", "y", "z"), ("<u8", *kinds), strict=False)]


def _table(schema: str, own: list[tuple], mail: list[tuple]) -> pa.Table:
    """Rows of both kinds: own ones have the columns of schema, mail those of _MAIL, and all are there in each."""
    names, kinds = _columns(schema)
    more, more_kinds = _columns(_MAIL)
    rows = [(0, None, None, None, None, None, None, *r) for r in own] + [(*m, *[None] * len(names)) for m in mail]
    if not rows:
        return pa.Table.from_batches([], pa.schema(list(zip([*more, *names], [*more_kinds, *kinds], strict=True))))
    return pa.Table.from_batches([_batch(rows, [*more, *names], [*more_kinds, *kinds])])


class Book:
    """Short numbers, from 1 on, for the words named, the most frequent first; all others are written out."""

    def __init__(self, words: np.ndarray):
        order = np.argsort(words)
        self.words, self.sorted, self.number = words, words[order], order + 1

    def coded(self, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if not len(self.words):
            return np.zeros(len(words), np.uint32), words
        at = np.minimum(np.searchsorted(self.sorted, words), len(self.sorted) - 1)
        numbers = np.where(self.sorted[at] == words, self.number[at], 0).astype(np.uint32)
        return numbers, words[numbers == 0]

    def read(self, numbers: np.ndarray, rest: np.ndarray) -> np.ndarray:
        out = np.zeros(len(numbers), np.uint64)
        some = numbers > 0
        out[some], out[~some] = self.words[numbers[some].astype(np.int64) - 1], rest
        return out


_DEALT = "bucket long, chunk long, contexts binary, sizes binary, words binary, rest binary, counts binary"


def _deal(buckets: int, cut: dict[int, int], book: Book):
    """A row for each chunk and bucket that has any of its pairs; the work follows the pairs, however many buckets there are."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for r in _rows_of(batches):
            c = Chunk(r)
            contexts, words = c.contexts[c.context], c.words[c.of]
            bucket = bucket_of(contexts, words, cut, buckets)
            order = np.argsort(bucket, kind="stable")  # pairs stay sorted within a bucket
            bucket, contexts, words, counts = bucket[order], contexts[order], words[order], c.counts[order]
            edges = np.r_[np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1]]), len(bucket)]
            rows = []
            for a, b in zip(edges, edges[1:], strict=False):
                new = np.flatnonzero(np.r_[True, contexts[a + 1 : b] != contexts[a : b - 1]])
                rows.append((int(bucket[a]), r["chunk"], pack(contexts[a:b][new]), pack(np.diff(np.r_[new, b - a]).astype(np.uint32)), *map(pack, book.coded(words[a:b])), pack(counts[a:b].astype(np.uint32))))
            yield _batch(rows, *_columns(_DEALT))

    return run


def _asks(buckets: int, hot: np.ndarray):
    """What each chunk asks the parent's buckets: its words, but for those that are known to every task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for r in _rows_of(batches):
            words = unpack(r["words"], "<u8")
            words = words[~np.isin(words, hot)]
            if rows := _mail(word_bucket(words, buckets), r["chunk"], words):
                yield _batch(rows, *_columns(_MAIL))

    return run


# --- restaurants

_BASE = (
    "bucket long, contexts binary, singles binary, m_context binary, m_words binary, m_counts binary, "
    "moving binary, a_guests binary, a_singles binary, chunks array<long>, a_contexts array<binary>, codes array<binary>, "
    "cut_contexts array<long>, cut_guests array<long>, cut_tables array<long>, ones long, twos long"
)


def _columns(schema: str) -> tuple[list[str], list]:
    kinds = {"int": pa.int32(), "long": pa.int64(), "binary": pa.binary(), "array<long>": pa.list_(pa.int64()), "array<binary>": pa.list_(pa.binary()), "double": pa.float64()}
    return [x.split()[0] for x in schema.split(", ")], [kinds[x.split()[1]] for x in schema.split(", ")]


def _merge(cut: dict[int, int], buckets: int, book: Book):
    """One bucket's restaurants from what all chunks counted, and mail to the parent: how often each word was seen, and how many contexts
    have it once or more often; of each chunk's pairs, what they are here: 0 for unseen in training,
    1 for seen once, 2 + i for the i-th pair of those seen more often."""

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by("chunk")
        chunks = table.column("chunk").to_pylist()
        packed = {k: table.column(k).to_pylist() for k in ("contexts", "sizes", "words", "rest", "counts")}
        sizes = [unpack(x, "<u4") for x in packed["sizes"]]
        names, which = np.unique(np.concatenate([unpack(x, "<u8") for x in packed["contexts"]]), return_inverse=True)
        context = np.repeat(which, np.concatenate(sizes))
        vocabulary, word = np.unique(np.concatenate([book.read(unpack(x, "<u4"), unpack(y, "<u8")) for x, y in zip(packed["words"], packed["rest"], strict=True)]), return_inverse=True)
        lengths = np.array([int(x.sum()) for x in sizes])
        pairs, where = np.unique(context * len(vocabulary) + word, return_inverse=True)
        n = _sums(where, np.concatenate([unpack(x, "<u4") for x in packed["counts"]]), len(pairs))
        owner, dish = pairs // len(vocabulary), pairs % len(vocabulary)
        many = n > 1
        code = np.minimum(n, 1)
        code[many] = 2 + np.arange(many.sum())
        guests, singles = _sums(owner, n, len(names)), _sums(owner, n == 1, len(names))
        tokens, once, often = (_sums(dish, x, len(vocabulary)) for x in (n, n == 1, many))
        seen = tokens > 0
        asked = np.split(code[where].astype(np.uint32), np.cumsum(lengths)[:-1])
        local = np.split(which.astype(np.uint32), np.cumsum([len(x) for x in sizes])[:-1])
        hot = np.isin(names, np.array(sorted(cut), np.uint64))
        moving = np.unique(np.r_[owner[many], np.flatnonzero(hot)])
        row = (
            table.column("bucket")[0].as_py(), pack(names[moving]), pack(singles[moving]), pack(np.searchsorted(moving, owner[many]).astype(np.uint32)), pack(vocabulary[dish[many]]), pack(n[many]),
            pack(moving.astype(np.uint32)), pack(guests), pack(singles), chunks, [pack(x) for x in local], [pack(x) for x in asked],
            names[hot].view(np.int64), guests[hot], _sums(owner, n > 0, len(names))[hot], int((n == 1).sum()), int((n == 2).sum()),
        )
        return _table(_BASE, [row], _mail(word_bucket(vocabulary[seen], buckets), row[0], vocabulary[seen], tokens[seen], once[seen], often[seen]))

    return run


def draw(keys: np.ndarray, *salt: int) -> np.ndarray:
    """A number in [0, 1) for each key: a hash of key and salt."""
    z = keys
    for s in salt:
        with np.errstate(over="ignore"):
            z = finalise(z ^ finalise(np.full(1, s + 1, np.uint64) * np.uint64(0x9E3779B97F4A7C15)))
    return (z >> np.uint64(11)).astype(np.float64) * 2.0**-53


@lru_cache(maxsize=4)
def _added_ways(discount: int) -> np.ndarray:
    """log_ways of 0 to ADDED customers, a row each, by how the last one sat down."""
    out = np.full((ADDED + 1, ADDED), -np.inf)
    out[1, 0], t = 0.0, np.arange(1, ADDED + 1)
    with np.errstate(invalid="ignore", divide="ignore"):
        for n in range(1, ADDED):
            out[n + 1] = out[n] + np.log(np.maximum(n - discount / UNIT * t, 0))
            out[n + 1, 1:] = np.logaddexp(out[n + 1, 1:], out[n, :-1])
    return out


def _log_less(v: np.ndarray) -> np.ndarray:
    """log(1 - exp(v)) for a real part of v below zero."""
    near = v.real > -0.7
    return np.where(near, np.log(-np.expm1(np.where(near, v, -1))), np.log1p(-np.exp(np.where(near, -1, v))))


def _integrated_ways(customers: np.ndarray, tables: int, discount: int) -> np.ndarray:
    """log_ways of more than ADDED customers: n! / t! times the coefficient of x^n in ((1 - (1 - x)^d) / d)^t, as Cauchy's integral over
    z = -n log x on a parabola around the cut, through the saddle point. Its terms fall off so fast that the sum over some tens of points
    is right to about ten digits, whatever n and t are."""
    d = discount / UNIT
    n, every = customers.astype(np.float64)[:, None], np.arange(1.0, tables + 1)[None]
    t = np.minimum(every, n - 1)
    # the saddle point by the t that has it, which is explicit
    grid = np.exp(np.linspace(np.log(1e-3), np.log(60.0 * n[:, 0]), 200, axis=1))
    y = _log_less(-grid / n)
    at = _log_less(d * y) + np.log(n / d) + grid / n + (1 - d) * y
    z0 = np.exp(np.stack([np.interp(np.log(b), a, g) for a, b, g in zip(at, t, np.log(grid), strict=True)]))
    low = z0 < 2  # there the 1 of the power, which integrates to nothing, would hide the rest
    mu = np.maximum(z0, 2)
    h = np.minimum(0.25, 0.42 / np.sqrt((1 - d) * mu))
    points = math.ceil(max(16, 4.0 / math.sqrt(2 * (1 - d)) / 0.25)) + 4
    ring = (n - t < 25) | (2 * mu * h * points > np.pi * n)  # nearly a table for each: the parabola is too wide, and a circle around 0 serves
    h = np.where(ring, np.pi * n / (points - 1) / mu, h)
    s = 1 + 1j * h[..., None] * np.arange(points)
    z = mu[..., None] * np.where(ring[..., None], s, s * s)
    s = np.where(ring[..., None], 0.5, s)
    log_power = t[..., None] * _log_less(d * _log_less(-z / n[..., None]))
    top = np.where(low, 0, log_power[..., 0].real) + mu
    f = np.where(low[..., None], np.expm1(np.where(low[..., None], log_power, 0)) * np.exp(z - mu[..., None]), np.exp(log_power + z - top[..., None])) * s
    f[..., 0] /= 2
    f[ring, -1] /= 2
    with np.errstate(invalid="ignore", divide="ignore"):
        out = top + np.log(np.maximum(f.real.sum(axis=-1), 0) * h * mu) - t * np.log(d) - np.cumsum(np.log(t), axis=1)
    return np.where(every < n, out, np.where(every == n, -_log_rest(n), -np.inf))


def _log_rest(n: np.ndarray) -> np.ndarray:
    """What log_ways leaves out for each n: log(2 (n - 1)! / pi)."""
    return np.log(2 / np.pi) + np.vectorize(math.lgamma)(n)


def log_ways(customers: np.ndarray, tables: int, discount: int) -> np.ndarray:
    """For each number of customers a row: log of the ways to seat them at 1, 2, .. tables, each beside c others counting c - discount, up
    to a number that is the same in a row."""
    out = np.full((len(customers), tables), -np.inf)
    few = customers <= ADDED
    out[few, :ADDED] = _added_ways(discount)[customers[few], :tables]
    many, step = np.flatnonzero(~few), max(1, BLOCK // (64 * tables))
    for i in range(0, len(many), step):
        out[many[i : i + step]] = _integrated_ways(customers[many[i : i + step]], tables, discount)
    return out


def seated(customers: np.ndarray, first: np.ndarray, more: np.ndarray, discount: int, u: np.ndarray) -> np.ndarray:
    """How many tables each word has once all its customers, so many, were taken out and seated again, by the exact law given everyone else;
    the odds of a further table beside t are first + more * t. u: a draw for each word.

    The law is that in which customers who leave and come one at a time end up. It has one top; numbers of tables are looked at until the
    odds of the last are below what a float can add.
    """
    tables, left, most = np.minimum(customers, 1).astype(np.int64), np.flatnonzero(customers > 1), FIRST_TABLES
    while len(left):
        n, which = np.unique(customers[left], return_inverse=True)
        rest, kinds = [], max(1, BLOCK // most)
        order = np.argsort(which, kind="stable")
        edges = np.searchsorted(which[order], np.arange(0, len(n) + kinds, kinds))
        for k, (a, b) in enumerate(zip(edges, edges[1:], strict=False)):
            ways = log_ways(n[k * kinds : (k + 1) * kinds], most, discount)
            for i in range(a, b, kinds):
                part = order[i : min(b, i + kinds)]
                on = left[part]
                log = ways[which[part] - k * kinds]
                log[:, 1:] += np.cumsum(np.log(first[on, None] + more[on, None] * np.arange(1, most)), axis=1)
                odds = np.exp(log - log.max(axis=1, keepdims=True))
                done = (odds[:, -1] < 1e-18) | (customers[on] <= most)
                total = np.cumsum(odds[done], axis=1)
                tables[on[done]] = 1 + np.minimum((total <= u[on[done], None] * total[:, -1:]).sum(axis=1), np.minimum(customers[on[done]], most) - 1)
                rest.append(on[~done])
        left, most = np.concatenate(rest), most * 4
    return tables


def first_seats(customers: np.ndarray, weight: np.ndarray, discount: float, keys: np.ndarray, salt: int) -> np.ndarray:
    """One way to seat everyone as they arrive, which no round uses: tables that so many customers of one word open, each but the first with odds weight : customers there
    - discount * tables.

    Seats customer by customer for the first eight, then from table to table: with n seated and t tables, none of the next m opens
    one with probability near ((n - d t) / (n + m - d t)) ** weight, which is inverted. So the work follows the tables.
    """
    tables, seated = np.minimum(customers, 1).astype(np.float64), 1
    while seated < 8 and (on := np.flatnonzero(customers > seated)).size:
        w = weight[on]
        tables[on] += draw(keys[on], salt, seated) < w / (w + seated - discount * tables[on])
        seated += 1
    on, n, step = np.flatnonzero(customers > 8), np.full(len(customers), 8.0), 8
    while on.size:
        left = n[on] - discount * tables[on]
        with np.errstate(over="ignore", divide="ignore"):
            n[on] += np.maximum(1, np.ceil(left * (draw(keys[on], salt, step) ** (-1 / weight[on]) - 1)))
        on = on[n[on] <= customers[on]]
        tables[on] += 1
        on, step = on[n[on] < customers[on]], step + 1
    return tables.astype(np.int64)


class Seating:
    """Moves of one customer at a time, the plain form that `seated` is held against in tests. Tables of many words side by side: how many customers each has, word by word; each word's last place is a free one."""

    def __init__(self, sizes: np.ndarray, tables: np.ndarray):
        """sizes: customers of each table, one word after the other; tables: how many each word has."""
        self.start = np.r_[0, np.cumsum(tables + 1)]
        self.sizes = np.zeros(self.start[-1], np.int64)
        self.sizes[np.arange(len(sizes)) + np.repeat(np.arange(len(tables)), tables)] = sizes

    @classmethod
    def opened(cls, customers: np.ndarray, tables: np.ndarray) -> Seating:
        """All but one customer of the further tables at the first."""
        sizes = np.ones(int(tables.sum()), np.int64)
        some = customers > 0
        sizes[(np.cumsum(tables) - tables)[some]] = (customers - tables + 1)[some]
        return cls(sizes, tables)

    def tables(self) -> np.ndarray:
        return np.add.reduceat((self.sizes > 0).astype(np.int64), self.start[:-1]) if len(self.start) > 1 else np.zeros(0, np.int64)

    def customers(self) -> np.ndarray:
        return np.add.reduceat(self.sizes, self.start[:-1]) if len(self.start) > 1 else np.zeros(0, np.int64)

    def packed(self) -> tuple[np.ndarray, np.ndarray]:
        return self.sizes[self.sizes > 0], self.tables()

    def _tidy(self) -> None:
        tables, kept = self.tables(), self.sizes[self.sizes > 0]
        self.__init__(kept, tables)

    def _below(self, weights: np.ndarray, on: np.ndarray, x: np.ndarray) -> np.ndarray:
        """The place where the running sum of a word's whole-number weights passes x."""
        total = np.cumsum(weights)
        before = np.r_[0, total][self.start[on]]
        return np.searchsorted(total, before + x, side="right")

    def leave(self, on: np.ndarray, u: np.ndarray) -> None:
        """One customer of each of these words, any with equal odds, goes."""
        n = self.customers()[on]
        self.sizes[self._below(self.sizes, on, np.minimum((u * n).astype(np.int64), n - 1))] -= 1

    def come(self, on: np.ndarray, u: np.ndarray, weight: np.ndarray, discount: int) -> None:
        """One customer of each of these words sits down, at a table with odds customers - discount or at a new one with odds weight."""
        score = np.where(self.sizes > 0, self.sizes * UNIT - discount, 0)
        old = np.add.reduceat(score, self.start[:-1])[on]
        x = u * (old + weight * UNIT)
        new = (x >= old) | (old <= 0)
        self.sizes[self._below(score, on[~new], np.minimum(x[~new].astype(np.int64), old[~new] - 1))] += 1
        self.sizes[self.start[on[new] + 1] - 1] = 1
        self._tidy()

    def moved(self, weight, discount: int, keys: np.ndarray, salt: int, moves: int) -> None:
        """Takes out and seats again one customer of each word after another. weight: from tables to the odds of a new one."""
        every = np.flatnonzero(self.customers() > 1)
        for k in range(moves if len(every) else 0):
            self.leave(every, draw(keys[every], salt, 2 * k))
            self.come(every, draw(keys[every], salt, 2 * k + 1), weight(self.tables())[every], discount)

    def some(self, on: np.ndarray) -> Seating:
        """The tables of these words alone."""
        tables = self.tables()
        return Seating(self.sizes[(self.sizes > 0) & np.repeat(np.isin(np.arange(len(tables)), on), np.diff(self.start))], tables[on])

    def replaced(self, on: np.ndarray, by: Seating) -> None:
        """Puts in the tables of these words as they are in by."""
        tables, other = self.tables(), by.tables()
        kept = self.sizes > 0
        owner = np.repeat(np.arange(len(tables)), np.diff(self.start))[kept]
        stays = ~np.isin(owner, on)
        owner = np.r_[owner[stays], np.repeat(on, other)]
        tables[on] = other
        self.__init__(np.r_[self.sizes[kept][stays], by.sizes[by.sizes > 0]][np.argsort(owner, kind="stable")], tables)

    def brought_to(self, customers: np.ndarray, weight, discount: int, keys: np.ndarray, salt: int, step: int = 0) -> None:
        """Customers go and come until there are so many. The words that are not there yet are done by themselves, anew when half of them are."""
        off = np.flatnonzero(self.customers() != customers)
        if not len(off):
            return
        part, goal, key = self.some(off), customers[off], keys[off]
        every = np.zeros(len(customers), np.int64)

        def odds(tables: np.ndarray) -> np.ndarray:
            every[off] = tables
            return np.broadcast_to(weight(every), len(every))[off]

        while 2 * len(left := np.flatnonzero((now := part.customers()) != goal)) > len(off):
            go, come = left[now[left] > goal[left]], left[now[left] < goal[left]]
            if len(go):
                part.leave(go, draw(key[go], salt, step))
            if len(come):
                part.come(come, draw(key[come], salt, step), odds(part.tables())[come], discount)
            else:
                part._tidy()
            step += 1
        part.brought_to(goal, odds, discount, key, salt, step)
        self.replaced(off, part)


def _hash(contexts: np.ndarray, words: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        return finalise(contexts * np.uint64(0xD6E8FEB86659FD93) + finalise(words))


_STATE = (
    "bucket long, contexts binary, singles binary, m_context binary, m_words binary, m_counts binary, tables binary, "
    "kept array<binary>, cut_contexts array<long>, cut_tables array<long>"
)


class Restaurants:
    """A bucket's restaurants that have pairs that move, as a row of the state has them; totals of contexts that are cut come from what all
    their parts sum to."""

    def __init__(self, row: dict, shared: dict):
        self.contexts, self.singles = unpack(row["contexts"], "<u8"), unpack(row["singles"], "<i8")
        self.owner, self.words, self.counts = unpack(row["m_context"], "<u4").astype(np.int64), unpack(row["m_words"], "<u8"), unpack(row["m_counts"], "<i8")
        self.shared = shared
        hot, _, _ = shared["cut"]
        self.at = np.minimum(np.searchsorted(hot, self.contexts), max(0, len(hot) - 1))
        self.hot = hot[self.at] == self.contexts if len(hot) else np.zeros(len(self.contexts), bool)

    def totals(self, tables: np.ndarray) -> np.ndarray:
        """Tables of each context."""
        own = self.singles + _sums(self.owner, tables, len(self.contexts))
        return np.where(self.hot, self.shared["cut"][2][self.at], own) if self.hot.any() else own


def _round(shared: dict, totals: Totals, now: tuple[int, int], n: int, seed: int, keep: bool, buckets: int):
    """One Gibbs round over a bucket, given what its words have in the parent and the parent's totals: all customers of each word are taken
    out and seated again. The first starts from one table for each word. keep appends the tables to those that are averaged. Mail to the parent: how many tables serve each word."""

    def run(state: pa.Table, mail: pa.Table) -> pa.Table:
        if not state.num_rows:
            return _table(_STATE, [], [])
        row = state.to_pylist()[0]
        r = Restaurants(row, shared)
        d, keys = shared["discount"], _hash(r.contexts[r.owner], r.words)
        words, of = np.unique(r.words, return_inverse=True)
        known, customers, parent_tables = _opened(mail.to_pylist(), "<i8", "<i8")
        order = np.argsort(known)
        p = parent_probability(totals, customers[order], parent_tables[order], *now)[of]  # the parent answers for just these words
        tables, kept = (unpack(row["tables"], "<u4").astype(np.int64), row["kept"]) if n else (np.ones(len(r.words), np.int64), [])
        others = r.totals(tables)[r.owner] - tables
        tables = seated(r.counts, (STRENGTH + d / UNIT * others) * p, d / UNIT * p, d, draw(keys, seed + n))
        own = _sums(r.owner, tables, len(r.contexts)) + r.singles
        out = (
            *[row[k] for k in ("bucket", "contexts", "singles", "m_context", "m_words", "m_counts")], pack(tables.astype(np.uint32)),
            [*kept, pack(tables.astype(np.uint32))] if keep else kept, r.contexts[r.hot].view(np.int64), own[r.hot],
        )
        return _table(_STATE, [out], _mail(word_bucket(words, buckets), row["bucket"], words, _sums(of, tables, len(words))))

    return run


# --- the parent

class Totals:
    """Numbers of the whole model: training tokens, vocabulary, discounts."""

    def __init__(self, tokens: int, vocabulary: int, ones: int, twos: int, parent_ones: int, parent_twos: int):
        self.tokens, self.vocabulary, self.base = tokens, vocabulary, 1 / (vocabulary + 1)
        part = lambda a, b: int(min(0.95, max(0.05, a / (a + 2 * b))) * UNIT) if a else UNIT // 2
        self.discount, self.parent_discount = part(ones, twos), part(parent_ones, parent_twos)


def parent_probability(totals: Totals, customers, tables, all_customers: int, all_tables: int):
    """The parent's predictive probability of words with so many customers and tables."""
    d = totals.parent_discount / UNIT
    return (np.maximum(customers - d * tables, 0) + (PARENT_STRENGTH + d * all_tables) * totals.base) / (PARENT_STRENGTH + all_customers)


_PARENT = "bucket long, words binary, tokens binary, singles binary, customers binary, tables binary, kept array<binary>, facts array<long>"


def _parent_row(bucket: int, words, tokens, singles, customers, tables, kept) -> tuple:
    facts = [len(words), tokens.sum(), customers.sum(), tables.sum(), (customers == 1).sum(), (customers == 2).sum()]
    return (bucket, *[pack(x.astype("<i8")) if x.dtype != np.uint64 else pack(x) for x in (words, tokens, singles, customers, tables)], kept, [int(x) for x in facts])


def _answers(mail: list[dict], words: np.ndarray, customers: np.ndarray, tables: np.ndarray) -> list[tuple]:
    """To each that asked: what its words have in the parent."""
    out = []
    for m in mail:
        at = np.searchsorted(words, asked := unpack(m["names"], "<u8"))
        out.append((1, m["sender"], m["to"], pack(asked), pack(customers[at]), pack(tables[at]), None))
    return out


def _vocabulary(table: pa.Table) -> pa.Table:
    """A bucket of the parent before anyone is seated: a customer for each context that has the word, all at one table. Buckets of contexts
    that have a word more than once hear of it."""
    mail = table.sort_by("sender").to_pylist()
    names, tokens, once, often = _opened(mail, "<i8", "<i8", "<i8")
    words, of = np.unique(names, return_inverse=True)
    tokens, once, often_all = (_sums(of, x, len(words)) for x in (tokens, once, often))
    customers, tables = once + often_all, np.ones(len(words), np.int64)
    row = _parent_row(mail[0]["to"], words, tokens, once, customers, tables, [])
    asks = [m | {"names": pack(unpack(m["names"], "<u8")[unpack(m["z"], "<i8") > 0])} for m in mail]
    return _table(_PARENT, [row], _answers([m for m in asks if m["names"]], words, customers, tables))


def _parent_round(totals: Totals, all_tables: int, seed: int, n: int, keep: bool):
    """A bucket of the parent after a round: the customers of each word, in their new number, are seated again."""

    def run(state: pa.Table, table: pa.Table) -> pa.Table:
        if not state.num_rows:
            return _table(_PARENT, [], [])
        row, mail, d = state.to_pylist()[0], table.sort_by("sender").to_pylist(), totals.parent_discount
        words, tokens, singles, held = unpack(row["words"], "<u8"), *(unpack(row[k], "<i8") for k in ("tokens", "singles", "tables"))
        names, tables = _opened(mail, "<i8")
        customers = singles + _sums(np.searchsorted(words, names), tables, len(words))
        weight = (PARENT_STRENGTH + d / UNIT * (all_tables - held)) * totals.base
        tables = seated(customers, weight, np.full(len(words), d / UNIT * totals.base), d, draw(finalise(words), seed + 100 + n))
        kept = [*row["kept"], pack(customers), pack(tables)] if keep else row["kept"]
        return _table(_PARENT, [_parent_row(row["bucket"], words, tokens, singles, customers, tables, kept)], _answers(mail, words, customers, tables))

    return run


class Parent:
    """A bucket of the parent at the end: its words, how often each was seen, and their customers and tables in each kept round."""

    def __init__(self, row: dict):
        self.words, self.tokens, self.kept = unpack(row["words"], "<u8"), unpack(row["tokens"], "<i8"), [unpack(x, "<i8") for x in row["kept"]]


def _frequent(least: int):
    """(word, tokens, kept) of the words that are seen so often that every task may as well know them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for r in _rows_of(batches):
            x = Parent(r)
            some = np.flatnonzero(x.tokens > least)
            yield pa.RecordBatch.from_arrays([_signed(x.words[some]), pa.array(x.tokens[some]), pa.array([[int(k[i]) for k in x.kept] for i in some], pa.list_(pa.int64()))], ["word", "tokens", "kept"])

    return run


_KNOWN = "bucket long, chunk long, tokens binary, kept array<binary>"


def _told(asked: pa.Table, parent: pa.Table) -> pa.Table:
    """To each chunk, for the words it asked for and in their order: how often each was seen in training, customers and tables."""
    names, kinds = _columns(_KNOWN)
    if not parent.num_rows:
        return pa.Table.from_batches([], pa.schema(list(zip(names, kinds, strict=True))))
    x, rows = Parent(parent.to_pylist()[0]), []
    for m in asked.to_pylist():
        words = unpack(m["names"], "<u8")
        at = np.minimum(np.searchsorted(x.words, words), len(x.words) - 1)
        some = x.words[at] == words
        rows.append((m["to"], m["sender"], pack(np.where(some, x.tokens[at], 0)), [pack(np.where(some, k[at], 0)) for k in x.kept]))
    return pa.Table.from_batches([_batch(rows, names, kinds)] if rows else [], pa.schema(list(zip(names, kinds, strict=True))))


# --- scores

def _answer(shared: list[dict]):
    """From (state, asked) rows of one bucket: to each chunk, for its pairs here in their order, how often each was seen, and if more than
    once its tables in the kept rounds; for their contexts in order, customers, and tables in the kept rounds."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in _rows_of(batches):
            r = Restaurants(row, shared[0])
            kept = [unpack(x, "<u4").astype(np.int64) for x in row["kept"]]
            moving, guests, singles = unpack(row["moving"], "<u4").astype(np.int64), unpack(row["a_guests"], "<i8").copy(), unpack(row["a_singles"], "<i8")
            guests[moving[r.hot]] = shared[0]["cut"][1][r.at[r.hot]]
            totals = []
            for s, t in zip(shared, kept, strict=True):
                totals.append(singles.copy())
                totals[-1][moving] = Restaurants(row, s).totals(t)
            for chunk, contexts, codes in zip(row["chunks"], row["a_contexts"], row["codes"], strict=True):
                c, code = unpack(contexts, "<u4").astype(np.int64), unpack(codes, "<u4").astype(np.int64)
                many = code[code > 1] - 2
                seen = np.minimum(code, 2)
                seen[code > 1] = r.counts[many]
                differ = lambda xs, at: [pack(x[at] - (xs[k - 1][at] if k else 0)) for k, x in enumerate(xs)]
                yield _batch([(row["bucket"], chunk, pack(seen), differ(kept, many), pack(guests[c]), differ(totals, c))], *_columns(_ANSWER))

    return run


_ANSWER = "bucket long, chunk long, seen binary, seats array<binary>, guests binary, totals array<binary>"


def _sum(totals: Totals, rounds: list[tuple[int, int]], hot: tuple, cut: dict[int, int], buckets: int, each: bool):
    """For one chunk: the scores of its documents, from its texts, what its pairs have in their restaurants, and its words in the parent."""
    d = totals.discount / UNIT

    def run(texts: pa.Table, told: pa.Table) -> pa.Table:
        rows = texts.to_pylist()
        own = next(r for r in rows if r["stream"] is not None)
        answers, told = sorted((r for r in rows if r["stream"] is None), key=lambda r: r["bucket"]), sorted(told.to_pylist(), key=lambda r: r["bucket"])
        c = Chunk(own)
        ids = pa.ipc.open_stream(own["ids"]).read_all().column("doc_id").combine_chunks()
        together = lambda parts: np.concatenate([np.zeros(0, np.int64), *parts])

        # words: those that every task knows, and answers in the order of the questions
        names, hot_tokens, hot_kept = hot
        asked = np.flatnonzero(~np.isin(c.words, names))
        bucket = word_bucket(c.words[asked], buckets)
        asked = asked[np.argsort(bucket, kind="stable")]
        answered = asked[np.isin(np.sort(bucket), [r["bucket"] for r in told])]  # a bucket without any word of training says nothing
        count, kept = np.zeros(len(c.words), np.int64), [np.zeros(len(c.words), np.int64) for _ in range(2 * len(rounds))]
        count[answered] = together(unpack(r["tokens"], "<i8") for r in told)
        for k, x in enumerate(kept):
            x[answered] = together(unpack(r["kept"][k], "<i8") for r in told)
        here = np.isin(names, c.words)
        at = np.searchsorted(c.words, names[here])
        count[at] = hot_tokens[here]
        for k, x in enumerate(kept):
            x[at] = hot_kept[here, k]

        # pairs and contexts, in the order in which they were dealt out
        bucket = bucket_of(c.contexts[c.context], c.words[c.of], cut, buckets)
        order = np.argsort(bucket, kind="stable")
        context, bucket = c.context[order], bucket[order]
        first = np.flatnonzero(np.r_[True, (context[1:] != context[:-1]) | (bucket[1:] != bucket[:-1])])
        seen = together(unpack(r["seen"], "<i8") for r in answers)
        guests = np.zeros(len(c.contexts))
        guests[context[first]] = together(unpack(r["guests"], "<i8") for r in answers)
        prob, tables, all_tables = np.zeros(len(seen)), np.minimum(seen, 1), np.zeros(len(c.contexts), np.int64)
        for k, now in enumerate(rounds):
            tables[seen > 1] = together(unpack(r["seats"][k], "<i8") for r in answers) + (tables[seen > 1] if k else 0)
            all_tables[context[first]] = together(unpack(r["totals"][k], "<i8") for r in answers) + (all_tables[context[first]] if k else 0)
            parent = parent_probability(totals, kept[2 * k], kept[2 * k + 1], *now)
            prob += (seen - d * tables + (STRENGTH + d * all_tables[context]) * parent[c.of[order]]) / (STRENGTH + guests[context]) / len(rounds)
        log = np.zeros(len(prob))
        log[order] = np.log10(prob)
        log, base = log[c.stream], np.log10((count + 1) / (totals.tokens + totals.vocabulary + 1))[c.word]
        add = lambda x: pa.array(np.add.reduceat(x, c.starts))
        columns = [ids, pa.array(c.lengths), add((count > 0).astype(np.int64)[c.word]), add(base), add(log)]
        if each:
            columns.append(pa.LargeListArray.from_arrays(pa.array(np.r_[c.starts, len(log)]), pa.array(log)).cast(pa.list_(pa.float64())))
        return pa.table(columns, ["doc_id", "n_tokens", "n_known", "base_score", "score", "token_scores"][: len(columns)])

    return run


def _cut_totals(state: DataFrame, guests: dict[int, int], tables: str = "cut_tables") -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(contexts, guests, tables) of the contexts that are cut, at most CUT of them."""
    if not guests:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    found = state.where("kind = 0").select(F.explode(F.arrays_zip("cut_contexts", tables)).alias("x")).groupBy("x.cut_contexts").agg(F.sum(f"x.{tables}").alias("t")).collect()
    t = {r[0] % (1 << 64): r[1] for r in found}
    names = sorted(guests)
    return np.array(names, np.uint64), np.array([guests[k] for k in names]), np.array([t[k] for k in names])


def score_documents(docs: DataFrame, samples: int = SAMPLES, burn_in: int = BURN_IN, seed: int = 11, limit: int = LIMIT, bytes_a_bucket: int = BYTES_A_BUCKET, each: bool = False) -> DataFrame:
    """A row for each row of docs: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, perplexity; with each also
    token_scores, the log10 probability of every token.

    Learns from the documents that are not held out (crc32 of doc_id modulo 7 is not 2), all of them. score is the text's log10
    probability, its end included; perplexity is 10 ** (-score / n_tokens). Null and blank texts are an end alone; a null doc_id
    counts as the empty text in crc32. Without any training text every token has the base probability 1. Repeated rows count each.
    Texts of any length are read whole. limit and bytes_a_bucket set how the work is cut up and change no score.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), (document_bucket(F.col("doc_id"), FOLDS) != HELD_OUT).alias("learn"), F.col("text").cast("string").alias("text"))
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = max(1, math.ceil(size / bytes_a_bucket))
    read = written(rows.mapInArrow(_read, _READ), "lm-read")
    per_context = written(read.mapInArrow(_context_sizes, "context long, n long").groupBy("context").agg(F.sum("n").alias("n")), "lm-contexts")
    most = max(limit, (per_context.agg(F.sum("n")).first()[0] or 0) // CUT)
    cut = {r["context"] % (1 << 64): -(-r["n"] // most) for r in per_context.where(F.col("n") > most).collect()}  # at most CUT
    book = Book(np.array([r["context"] for r in per_context.orderBy(F.desc("n"), "context").limit(BOOK).collect()], np.int64).view(np.uint64))
    discard(per_context)
    dealt = read.mapInArrow(_deal(buckets, cut, book), _DEALT)
    base = written(dealt.groupBy("bucket").applyInArrow(_merge(cut, buckets, book), f"{_MAIL}, {_BASE}"), "lm-base")

    def own(table: DataFrame, *columns: str) -> DataFrame:
        return table.where("kind = 0").select("bucket", *columns)

    def mail(table: DataFrame) -> DataFrame:
        return table.where("kind = 1").select(*_columns(_MAIL)[0][1:])

    parent = written(mail(base).groupBy("to").applyInArrow(_vocabulary, f"{_MAIL}, {_PARENT}"), "lm-parent")

    def facts() -> list[int]:
        return [x or 0 for x in own(parent, "facts").agg(*[F.sum(F.get("facts", F.lit(i))) for i in range(6)]).first()]

    words, tokens, customers, tables, parent_ones, parent_twos = facts()
    ones, twos = (x or 0 for x in base.agg(F.sum("ones"), F.sum("twos")).first())
    totals, now = Totals(tokens, words, ones, twos, parent_ones, parent_twos), (customers, tables)
    guests = {r[0] % (1 << 64): r[1] for r in base.where("kind = 0").select(F.explode(F.arrays_zip("cut_contexts", "cut_guests")).alias("x")).groupBy("x.cut_contexts").agg(F.sum("x.cut_guests")).collect()} if cut else {}
    shared = {"discount": totals.discount, "cut": _cut_totals(base, guests)}
    state = own(base, "contexts", "singles", "m_context", "m_words", "m_counts")
    rounds, parents, old = [], [], []
    for n in range(burn_in + samples):
        work = _round(shared, totals, now, n, seed, n >= burn_in, buckets)
        new = written(state.groupBy("bucket").cogroup(mail(parent).groupBy("to")).applyInArrow(work, f"{_MAIL}, {_STATE}"), "lm-state")
        work = _parent_round(totals, now[1], seed, n, n >= burn_in)
        risen = written(own(parent, *_columns(_PARENT)[0][1:]).groupBy("bucket").cogroup(mail(new).groupBy("to")).applyInArrow(work, f"{_MAIL}, {_PARENT}"), "lm-parent")
        for gone in [parent, *old]:
            discard(gone)
        parent, old = risen, [new]
        shared = {"discount": totals.discount, "cut": _cut_totals(new, guests)}
        state = own(new, *[c for c in _columns(_STATE)[0][1:] if not c.startswith("cut_")])
        _, _, customers, tables, _, _ = facts()
        now = (customers, tables)
        if n >= burn_in:
            rounds.append(shared)
            parents.append(now)
    often = own(parent, "words", "tokens", "kept").mapInArrow(_frequent(max(limit, totals.tokens // CUT)), "word long, tokens long, kept array<long>").collect()  # at most CUT
    hot = (np.array([r["word"] for r in often], np.int64).view(np.uint64), np.array([r["tokens"] for r in often], np.int64), np.array([r["kept"] for r in often], np.int64).reshape(-1, 2 * samples))
    asked = read.mapInArrow(_asks(buckets, hot[0]), _MAIL).select(*_columns(_MAIL)[0][1:])
    known = written(asked.groupBy("to").cogroup(own(parent, "words", "tokens", "kept").groupBy("bucket")).applyInArrow(_told, _KNOWN), "lm-known")
    discard(parent)
    answers = state.drop("tables").join(own(base, "moving", "a_guests", "a_singles", "chunks", "a_contexts", "codes"), "bucket")
    answers = written(answers.mapInArrow(_answer(rounds), _ANSWER), "lm-answers")
    for gone in [base, *old]:
        discard(gone)
    both = read.unionByName(answers, allowMissingColumns=True)
    done = both.groupBy("chunk").cogroup(known.groupBy("chunk")).applyInArrow(_sum(totals, parents, hot, cut, buckets, each), "doc_id long, n_tokens long, n_known long, base_score double, score double" + ", token_scores array<double>" * each)
    return done.select(
        "doc_id", (document_bucket(F.col("doc_id"), FOLDS) == HELD_OUT).alias("held_out"), "n_tokens", "n_known", F.lit(totals.tokens).cast("long").alias("train_tokens"),
        "base_score", "score", F.pow(F.lit(10.0), -F.col("score") / F.col("n_tokens")).alias("perplexity"), *["token_scores"] * each,
    )
