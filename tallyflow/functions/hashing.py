"""Hashes that must equal those of other systems bit by bit, over Arrow batches; and thresholds over them."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# FNV-1a, 64 bits; splitmix64.
FNV_OFFSET, FNV_PRIME = 0xCBF29CE484222325, 0x100000001B3
MIX_GAMMA, MIX_A, MIX_B, SALT = 0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB, 0xC2B2AE3D27D4EB4F


def _by_position(flat: np.ndarray, edges: np.ndarray, start: np.ndarray, step) -> np.ndarray:
    """Folds step over the items of each list, all lists side by side: one pass for each position, over those that reach it."""
    sizes = np.diff(edges)
    order = np.argsort(-sizes, kind="stable")
    h, first, n = start[order], edges[:-1][order], sizes[order]
    for at in range(int(n[0]) if len(n) else 0):
        reach = int(np.searchsorted(-n, -at, "left"))
        h[:reach] = step(h[:reach], flat[first[:reach] + at])
    out = np.empty_like(h)
    out[order] = h
    return out


def finalise(z: np.ndarray) -> np.ndarray:
    """splitmix64's scrambling of unsigned longs."""
    with np.errstate(over="ignore"):
        z = (z ^ (z >> np.uint64(30))) * np.uint64(MIX_A)
        z = (z ^ (z >> np.uint64(27))) * np.uint64(MIX_B)
        return z ^ (z >> np.uint64(31))


def line_hash(line: np.ndarray, seed: int, salt: int = 0) -> np.ndarray:
    """What a line number draws: a function of seed, line and salt alone."""
    with np.errstate(over="ignore"):
        z = np.uint64(seed & (1 << 64) - 1) ^ (line.astype(np.int64).view(np.uint64) * np.uint64(MIX_GAMMA)) ^ np.uint64(salt * SALT & (1 << 64) - 1)
        return finalise(z + np.uint64(MIX_GAMMA))


def _kept(values: np.ndarray, like: pa.Array) -> pa.Array:
    """Null in, null out."""
    return pa.array(values, mask=like.is_null().to_numpy(zero_copy_only=False))


@F.arrow_udf(T.LongType())
def fnv1a64(text: pa.Array) -> pa.Array:
    """FNV-1a of the text in UTF-8, as a signed long."""
    raw = [x or b"" for x in text.cast(pa.binary()).to_pylist()]
    edges = np.r_[0, np.cumsum([len(x) for x in raw])].astype(np.int64)
    flat = np.frombuffer(b"".join(raw), np.uint8).astype(np.uint64)
    with np.errstate(over="ignore"):
        h = _by_position(flat, edges, np.full(len(raw), FNV_OFFSET, np.uint64), lambda h, b: (h ^ b) * np.uint64(FNV_PRIME))
    return _kept(h.view(np.int64), text)


@F.arrow_udf(T.LongType())
def splitmix64(x: pa.Array) -> pa.Array:
    """The scrambling, from signed to signed longs."""
    return _kept(finalise(x.fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)).view(np.int64), x)


@F.arrow_udf(T.IntegerType())
def java_hash(text: pa.Array) -> pa.Array:
    """31 * h + c over UTF-16 units, 32 bits."""
    raw = [(x or "").encode("utf-16-le") for x in text.to_pylist()]
    edges = np.r_[0, np.cumsum([len(x) // 2 for x in raw])].astype(np.int64)
    flat = np.frombuffer(b"".join(raw), np.uint16).astype(np.uint32)
    with np.errstate(over="ignore"):
        h = _by_position(flat, edges, np.zeros(len(raw), np.uint32), lambda h, c: h * np.uint32(31) + c)
    return _kept(h.view(np.int32), text)


def unsigned_order(h: Column) -> Column:
    """Sorts signed longs as unsigned ones."""
    return h.bitwiseXOR(F.lit(-(1 << 63)))


def coin(h: Column, probability: float) -> Column:
    """True for that share of hashes: the top 53 bits against a threshold."""
    return F.shiftrightunsigned(h, 11) < F.lit(int(probability * (1 << 53)))
