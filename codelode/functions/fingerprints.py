"""64-bit fingerprints of key columns, the same in Spark expressions and in NumPy."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, functions as F

_P1, _P2, _P3, _P4, _P5 = (
    np.uint64(x)
    for x in (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5)
)


def fingerprint(*columns: Column, salt: int = 0) -> Column:
    """xxhash64 over the columns and over which of them are null, so (null, 'a') differs from ('a', null)."""
    parts: list[Column] = [F.lit(salt)]
    for c in columns:
        parts += [c.isNull(), c]
    return F.xxhash64(*parts)


def fingerprint128(*columns: Column) -> tuple[Column, Column]:
    """Two independent fingerprints: among 10^10 keys two share both with a chance below 10^-18."""
    return fingerprint(*columns, salt=1), fingerprint(*columns, salt=2)


def _rotl(x: np.ndarray, n: int) -> np.ndarray:
    return (x << np.uint64(n)) | (x >> np.uint64(64 - n))


def xxh64_long(value: np.ndarray, seed: np.ndarray | int) -> np.ndarray:
    """XXH64 of a long with a seed, as Spark's xxhash64 chains it (its first seed is 42)."""
    with np.errstate(over="ignore"):
        seed = np.asarray(seed).astype(np.int64).view(np.uint64) if not isinstance(seed, int) else np.uint64(seed)
        value = np.asarray(value, dtype=np.int64).view(np.uint64)
        h = seed + _P5 + np.uint64(8)
        h = h ^ (_rotl(value * _P2, 31) * _P1)
        h = _rotl(h, 27) * _P1 + _P4
        h = (h ^ (h >> np.uint64(33))) * _P2
        h = (h ^ (h >> np.uint64(29))) * _P3
        return (h ^ (h >> np.uint64(32))).view(np.int64)


def xxh64_longs(*values: np.ndarray) -> np.ndarray:
    """xxhash64(v1, v2, ...) of Spark for long columns without nulls."""
    h: np.ndarray | int = 42
    for v in values:
        h = xxh64_long(v, h)
    return np.asarray(h)
