"""Byte-level BPE by a rank file: whole pre-tokens come from a minimal perfect hash, the rest from a heap over linked bytes."""

from __future__ import annotations

import base64
import functools
import hashlib
import heapq
import itertools
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
import regex
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyflow.llm.common import text_chunks

#: What the heap merged pre-tokens of at most so many characters to is remembered, for so many of them twice over.
REMEMBERED, REMEMBERED_CHARS = 300_000, 48
MASK = (1 << 64) - 1
#: UTF-8 bytes of texts whose distinct pre-tokens are looked up at once: with the ids as a result, and with digests alone, which are small.
CHUNK, DIGEST_CHUNK = 2 << 20, 8 << 20


class PerfectHash:
    """A minimal perfect hash by displacement: keys fall into buckets; each bucket, largest first, takes the first seed that sends
    its keys to free slots, and buckets of one key take the slots that are left. Slots are as many as keys; the key kept in a slot
    tells strangers from members."""

    def __init__(self, keys: list[bytes]):
        n = max(1, len(keys))
        self.n, self.buckets = n, (n + 1) // 2
        hashes = [xxhash.xxh3_64_intdigest(k) for k in keys]
        if len({*hashes}) != len(keys):
            raise ValueError("keys repeat")
        members: list[list[int]] = [[] for _ in range(self.buckets)]
        for i, h in enumerate(hashes):
            members[h % self.buckets].append(i)
        self.seed, self.at = [0] * self.buckets, [-1] * n
        order = sorted((b for b in range(self.buckets) if members[b]), key=lambda b: -len(members[b]))
        for b in (b for b in order if len(members[b]) > 1):
            own, seed = [hashes[i] for i in members[b]], 0
            while len({*(at := [self._place(h, seed) for h in own])}) < len(at) or any(self.at[x] >= 0 for x in at):
                seed += 1
            self.seed[b] = seed
            for x, i in zip(at, members[b], strict=True):
                self.at[x] = i
        free = iter([x for x in range(n) if self.at[x] < 0])
        for b in (b for b in order if len(members[b]) == 1):
            x = next(free)
            self.seed[b], self.at[x] = -1 - x, members[b][0]
        self.keys = [keys[i] if i >= 0 else b"" for i in self.at]

    def _place(self, h: int, seed: int) -> int:
        if seed < 0:
            return -1 - seed
        x = (h ^ (seed * 0x9E3779B97F4A7C15)) & MASK
        x = (x ^ (x >> 32)) * 0xD6E8FEB86659FD93 & MASK
        return (x ^ (x >> 29)) % self.n

    def index(self, key: bytes) -> int:
        """The key's position among the keys, or -1."""
        h = xxhash.xxh3_64_intdigest(key)
        at = self._place(h, self.seed[h % self.buckets])
        return self.at[at] if self.keys[at] == key else -1


class ByteBPE:
    """Encodes and decodes as the rank file has it. Pre-tokens are the matches of pattern, each merged by itself."""

    def __init__(self, rank_file: str, pattern: str = public_tokenizers.PATTERN):
        with open(rank_file, "rb") as f:
            pairs = [line.split() for line in f if line.strip()]
        self.ranks = {base64.b64decode(a): int(b) for a, b in pairs}
        self.bytes = {b: a for a, b in self.ranks.items()}
        keys = list(self.ranks)
        self.whole, self.ids = PerfectHash(keys), [self.ranks[k] for k in keys]
        # \s and its complement as Unicode's White_Space, whatever a library adds to it
        blank = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
        self.find = regex.compile(pattern.replace(r"[^\s", f"[^{blank}").replace(r"\s", f"[{blank}]").replace(r"\S", f"[^{blank}]")).findall
        #: What was merged of late, and before that: when the first is full, it becomes the second.
        self.hits = self.merged = 0
        self.known: dict[str, tuple[int, ...]] = {}
        self.older: dict[str, tuple[int, ...]] = {}
        self.pairs = [self.ranks.get(bytes((a, b))) for a in range(256) for b in range(256)]

    def merge(self, piece: bytes) -> list[int]:
        """Merges the pair of lowest rank, the leftmost of equals, until none is left; positions are linked both ways."""
        rank, n = self.ranks.get, len(piece)
        right, left, end = [*range(1, n + 1)], [*range(-1, n - 1)], [*range(1, n + 1)]
        # an entry is a pair's rank, start and stop in one number, so that entries sort by rank, then from the left
        k, pairs = n + 1, self.pairs
        heap = [(r * k + i) * k + i + 2 for i in range(n - 1) if (r := pairs[piece[i] << 8 | piece[i + 1]]) is not None]
        heapq.heapify(heap)
        while heap:
            x, stop = divmod(heapq.heappop(heap), k)
            i = x % k
            j = right[i]
            if not end[i] or j >= n or end[j] != stop:
                continue  # one side has been merged since
            end[j], end[i], after = 0, stop, right[j]
            right[i] = after
            if after < n:
                left[after] = i
                if (r := rank(piece[i : end[after]])) is not None:
                    heapq.heappush(heap, (r * k + i) * k + end[after])
            if (p := left[i]) >= 0 and (r := rank(piece[p:stop])) is not None:
                heapq.heappush(heap, (r * k + p) * k + stop)
        out, i = [], 0
        while i < n:
            out.append(self.ranks[piece[i : end[i]]])
            i = right[i]
        return out

    def piece(self, token: str) -> tuple[int, ...]:
        """A pre-token's ids: the perfect hash says whether it is in the vocabulary; if not, it is merged, or was of late."""
        raw = token.encode()
        at = self.whole.index(raw)
        if at >= 0:
            self.hits += 1
            return (self.ids[at],)
        if (ids := self.known.get(token)) is not None:
            return ids
        if (ids := self.older.get(token)) is None:
            self.merged += 1
            ids = tuple(self.merge(raw))
        if len(token) <= REMEMBERED_CHARS:
            if len(self.known) >= REMEMBERED:
                self.older, self.known = self.known, {}
            self.known[token] = ids
        return ids

    def encode_all(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids, edges): the texts' ids one after the other; a text's are ids[edges[i] : edges[i + 1]]. Each distinct pre-token is looked up once."""
        found = [self.find(t) for t in texts]
        sizes = np.array([len(x) for x in found], np.int64)
        if not sizes.sum():
            return np.zeros(0, np.int32), np.zeros(len(texts) + 1, np.int64)
        coded = pa.array(itertools.chain.from_iterable(found), pa.large_string(), size=int(sizes.sum())).dictionary_encode()
        distinct = [*map(self.piece, coded.dictionary.to_pylist())]
        n = np.fromiter(map(len, distinct), np.int64, len(distinct))
        pool, which = np.fromiter(itertools.chain.from_iterable(distinct), np.int32, int(n.sum())), coded.indices.to_numpy()
        many = n[which]
        ends = np.cumsum(many)
        ids = pool[np.repeat((np.cumsum(n) - n)[which] - (ends - many), many) + np.arange(ends[-1])]
        return ids, np.r_[0, ends][np.r_[0, np.cumsum(sizes)]]

    def encode(self, text: str) -> list[int]:
        return self.encode_all([text])[0].tolist()

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.bytes.__getitem__, ids))


def _path(rank_file: str | None) -> str:
    return rank_file or public_tokenizers.path("byte_bpe_50k.tiktoken")


@functools.lru_cache(2)
def load(rank_file: str) -> ByteBPE:
    """One for each process: later tasks of a Python worker find it made."""
    return ByteBPE(rank_file)


def encode(docs: DataFrame, rank_file: str | None = None) -> DataFrame:
    """A row for each row of docs: doc_id, ids (array of int). Null texts count as empty and have no ids; strings that look like
    special tokens are ordinary text. Each text is encoded by itself, whole, however long."""
    path = _path(rank_file)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = load(path)
        for batch in text_chunks(batches, "text", CHUNK):
            ids, edges = bpe.encode_all([x or "" for x in batch.column("text").to_pylist()])
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.ListArray.from_arrays(pa.array(edges.astype(np.int32)), pa.array(ids))], ["doc_id", "ids"])

    plain = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return plain.mapInArrow(run, "doc_id long, ids array<int>")


def decode(encoded: DataFrame, rank_file: str | None = None) -> DataFrame:
    """A row for each row of encoded (doc_id, ids): doc_id, bytes (binary). Null ids give no bytes; an id that the file lacks is an error."""
    path = _path(rank_file)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = load(path)
        for batch in batches:
            texts = [bpe.decode(x or []) for x in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(texts, pa.binary())], ["doc_id", "bytes"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, bytes binary")


def round_trip(docs: DataFrame, rank_file: str | None = None) -> DataFrame:
    """encode() and decode() in one pass: doc_id, n_tokens, ids_sha256 (of the decimal ids joined by spaces), decoded_sha256."""
    path = _path(rank_file)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = load(path)
        decimal = {i: str(i) for i in bpe.bytes}
        sha = lambda b: hashlib.sha256(b).hexdigest()
        for batch in text_chunks(batches, "text", DIGEST_CHUNK):
            n, a, b = [], [], []
            every, edges = bpe.encode_all([x or "" for x in batch.column("text").to_pylist()])
            for x, y in zip(edges, edges[1:], strict=False):
                ids = every[x:y].tolist()
                n.append(len(ids))
                a.append(sha(" ".join(map(decimal.__getitem__, ids)).encode()))
                b.append(sha(bpe.decode(ids)))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(a, pa.string()), pa.array(b, pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    plain = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return plain.mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
