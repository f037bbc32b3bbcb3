"""Removing byte ranges from texts."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

def identity(*more) -> list:
    """Columns t1 and t2: 128 bits that stand for the text (and what else is given)."""
    text = F.coalesce(F.col("text"), F.lit(""))
    return [F.xxhash64(F.lit(1), text, *more).alias("t1"), F.xxhash64(F.lit(2), text, *more).alias("t2")]


def merged(ranges: np.ndarray) -> np.ndarray:
    """Maximal runs (start, end) of half-open ranges that overlap or touch."""
    if not len(ranges):
        return np.zeros((0, 2), np.int64)
    r = ranges[np.argsort(ranges[:, 0], kind="stable")]
    reach = np.maximum.accumulate(r[:, 1])
    new = np.concatenate([[True], r[1:, 0] > reach[:-1]])
    return np.stack([r[new, 0], reach[np.append(np.flatnonzero(new)[1:] - 1, len(r) - 1)]], 1)


def without(data: bytes, runs: np.ndarray) -> bytes:
    """data less the given maximal runs."""
    at, kept = 0, []
    for a, b in runs.tolist():
        kept.append(data[at:a])
        at = b
    kept.append(data[at:])
    return b"".join(kept)


def lists_of(column: pa.Array) -> list[np.ndarray]:
    """A column of lists of longs, null as empty, as arrays."""
    return [np.array(x if x is not None else [], np.int64) for x in column.to_pylist()]
