"""Quality classifier: a regularised quadratic discriminant over statistics of a document's text."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyflow.llm.common import document_bucket, text_chunks

#: At most so many labelled rows are learned from: those whose hashed doc_id is smallest.
MAX_LABELLED = 20_000
#: Documents whose crc32(doc_id) mod FOLDS is 0 are never learned from.
FOLDS = 5
THRESHOLD = 0.3
#: How far a class's covariance is drawn to the pooled one, and that to its diagonal; then what is added to the diagonal.
TO_POOLED, TO_DIAGONAL, RIDGE = 0.2, 0.1, 1e-3

NAMES = ("bytes", "words", "word_length", "word_spread", "upper", "digits", "marks", "high", "blanks", "distinct", "top_word", "line_length", "repeated_lines", "short_words", "odd_words", "ended_words", "repeated_triples", "entropy", "shouted")


def _classes() -> np.ndarray:
    """For each byte: 0 other mark, 1 a-z, 2 A-Z, 3 digit, 4 blank, 5 common mark, 6 part of a character beyond ASCII."""
    out = np.zeros(256, np.uint8)
    for value, chars in ((1, b"abcdefghijklmnopqrstuvwxyz"), (2, b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"), (3, b"0123456789"), (4, b" \t\n\x0b\x0c\r"), (5, b".,;:'\"()-?")):
        out[list(chars)] = value
    out[128:] = 6
    return out


CLASSES = _classes()


def statistics(text: bytes) -> list[float]:
    """The statistics named in NAMES, each brought to a scale where a class is roughly normal. Blank texts have them too."""
    data = np.frombuffer(text, np.uint8)
    n = len(data)
    kinds = np.bincount(CLASSES[data], minlength=7)
    tokens = text.split()
    m = max(1, len(tokens))
    sizes = np.fromiter(map(len, tokens), np.int64, len(tokens)) if tokens else np.zeros(1)
    lower = [t.lower() for t in tokens]
    counts = Counter(lower)
    lines = [x for x in text.split(b"\n") if x.strip()]
    triples = list(zip(lower, lower[1:], lower[2:], strict=False))
    letters = kinds[1] + kinds[2] + kinds[6]
    freq = np.bincount(data, minlength=256) / max(1, n)
    freq = freq[freq > 0]
    odd = sum(not t.strip(b".,;:'\"()-?!").isalpha() and t.isascii() for t in tokens)
    ended = sum(t[-1] in b"!#$%&*" for t in tokens)
    shouted = sum(len(t) > 1 and t.isupper() for t in tokens)
    root = lambda x, of: (x / max(1, of)) ** 0.5  # noqa: E731  draws out small shares
    return [
        np.log1p(n), np.log1p(len(tokens)), float(np.log1p(sizes.mean())), float(np.log1p(sizes.std())), root(kinds[2], letters), root(kinds[3], n), root(kinds[0], n),
        root(kinds[6], n), root(kinds[4], n), float(np.log1p(len(counts)) / np.log1p(m)) if tokens else 1.0, root(max(counts.values(), default=0), m),
        float(np.log1p(n / max(1, len(lines)))), root(len(lines) - len({*lines}), len(lines)), root(int((sizes <= 3).sum()) if tokens else 0, m), root(odd, m), root(ended, m),
        root(len(triples) - len({*triples}), len(triples)), float(-(freq * np.log2(freq)).sum()), root(shouted, m),
    ]


@dataclass(frozen=True)
class Discriminant:
    """Means, inverted Cholesky factors and log densities' constants of the classes 0 and 1; a and b calibrate their difference."""

    centre: np.ndarray
    scale: np.ndarray
    means: np.ndarray
    factors: np.ndarray
    constants: np.ndarray
    a: float = 1.0
    b: float = 0.0

    def margin(self, x: np.ndarray) -> np.ndarray:
        """Log density of class 1 less that of class 0, priors included."""
        z = (x - self.centre) / self.scale
        log = [c - 0.5 * (((z - m) @ f.T) ** 2).sum(axis=1) for m, f, c in zip(self.means, self.factors, self.constants, strict=True)]
        return log[1] - log[0]

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.a * np.tanh(self.margin(x) / 60) * 60 + self.b, -60, 60)))


def _fit(x: np.ndarray, y: np.ndarray) -> Discriminant:
    centre, scale = x.mean(axis=0), x.std(axis=0) + 1e-6
    z = (x - centre) / scale
    parts = [z[y == c] for c in (0, 1)]
    means = np.array([p.mean(axis=0) for p in parts])
    pooled = sum((p - m).T @ (p - m) for p, m in zip(parts, means, strict=True)) / len(z)
    pooled = (1 - TO_DIAGONAL) * pooled + TO_DIAGONAL * np.diag(np.diag(pooled))
    factors, constants = [], []
    for p, m in zip(parts, means, strict=True):
        weight = max(TO_POOLED, 1 - len(p) / (len(p) + 2 * x.shape[1]))  # the fewer rows, the more of the pooled one
        own = (p - m).T @ (p - m) / max(1, len(p))
        own = (1 - weight) * own + weight * pooled + RIDGE * np.eye(x.shape[1])
        lower = np.linalg.cholesky(own)
        factors.append(np.linalg.inv(lower))
        constants.append(float(np.log(len(p) / len(z)) - np.log(np.diag(lower)).sum()))
    return Discriminant(centre, scale, means, np.array(factors), np.array(constants))


def fit(x: np.ndarray, y: np.ndarray) -> Discriminant | float:
    """The discriminant, calibrated by a logistic curve over margins of rows that were left out; a share if a class is missing."""
    if len({*y.tolist()}) < 2:
        return float(y[0]) if len(y) else 0.5
    whole = _fit(x, y)
    fold = np.arange(len(y)) % 5
    margin = np.full(len(y), np.nan)
    for k in range(5):
        if len({*y[fold != k].tolist()}) == 2 and (fold == k).any():
            margin[fold == k] = _fit(x[fold != k], y[fold != k]).margin(x[fold == k])
    ok = ~np.isnan(margin)
    u, t = np.tanh(margin[ok] / 60) * 60, y[ok]
    best = (np.inf, 1.0, 0.0)
    for a in np.geomspace(0.02, 1.5, 16):  # a grid, as classes that a line parts would draw a slope without bound
        for b in np.linspace(-4, 4, 33):
            v = a * u + b
            best = min(best, (float(np.logaddexp(0, np.where(t == 1, -v, v)).mean()) + 1e-3 * abs(b), float(a), float(b)))
    _, a, b = best
    return Discriminant(whole.centre, whole.scale, whole.means, whole.factors, whole.constants, a, b)


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in text_chunks(batches, "text"):
        x = [statistics(t or b"") for t in batch.column("text").cast(pa.binary()).to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(x, pa.list_(pa.float64()))], ["doc_id", "x"])


def train(docs: DataFrame, labels: DataFrame, max_labelled: int = MAX_LABELLED) -> Discriminant | float:
    """Learns from documents with a label quality of 0 or 1, at most max_labelled of them and none of the held-out fold.

    A doc_id with several labels counts as good if one says so; one with several rows counts once; null ids and labels are skipped.
    """
    known = labels.where("doc_id is not null and quality in (0, 1)").where(document_bucket(F.col("doc_id"), FOLDS) != 0)
    some = known.groupBy("doc_id").agg(F.max("quality").alias("y")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_labelled)
    rows = docs.select("doc_id", F.col("text").cast("string").alias("text")).join(F.broadcast(some.select("doc_id")), "doc_id", "left_semi")
    x = rows.mapInArrow(_features, "doc_id long, x array<double>").groupBy("doc_id").agg(F.min("x").alias("x")).join(F.broadcast(some), "doc_id")
    got = x.orderBy(F.xxhash64("doc_id"), "doc_id").select("x", "y").toPandas()
    if not len(got):
        return 0.5
    return fit(np.array(got["x"].tolist()), got["y"].to_numpy())


def score_documents(docs: DataFrame, model: Discriminant | float, threshold: float = THRESHOLD) -> DataFrame:
    """A row for each row of docs: doc_id, score (0 to 1), predicted (1 if the score is at least threshold). Null texts count as empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_chunks(batches, "text"):
            if batch.num_rows:
                x = np.array([statistics(t or b"") for t in batch.column("text").cast(pa.binary()).to_pylist()])
                s = np.full(len(x), model) if isinstance(model, float) else model.score(x)
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(s), pa.array((s >= threshold).astype(np.int32))], ["doc_id", "score", "predicted"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, score double, predicted int")


def quality(docs: DataFrame, labels: DataFrame, max_labelled: int = MAX_LABELLED) -> DataFrame:
    """A row for each row of docs: doc_id, held_out, score, predicted. Only the text decides a score; labels, lang, source and
    doc_id don't. Without labels of both classes every score is the share of good labels, or 0.5 if there are none."""
    scored = score_documents(docs, train(docs, labels, max_labelled))
    return scored.select("doc_id", (document_bucket(F.col("doc_id"), FOLDS) == 0).alias("held_out"), "score", "predicted")


def drop_low_quality(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of docs that are predicted 1, with all their columns; the texts are judged where they lie, without a join."""
    model = train(docs, labels)
    names = docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_chunks(batches, "text"):
            if batch.num_rows:
                x = np.array([statistics(t or b"") for t in batch.column("text").cast(pa.binary()).to_pylist()])
                s = np.full(len(x), model) if isinstance(model, float) else model.score(x)
                yield batch.filter(pa.array(s >= THRESHOLD))

    return docs.mapInArrow(run, docs.schema).select(names)
