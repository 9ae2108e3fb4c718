"""Exchange of many small keyed values as packed arrays.

A task sorts what it has by key, packs it into one row for each of ``n``
buckets, and Spark shuffles these rows; a bucket's rows are then merged with
array operations. Keys that a task holds more than once are merged before they
travel, so a key that fills the corpus reaches its bucket once for each task.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

from . import wordhash as wh


def bucket_of(keys: np.ndarray, n: int) -> np.ndarray:
    return ((keys >> wh.U(24)) % wh.U(n)).astype(np.int64)


def deal(keys: np.ndarray, columns: list[np.ndarray], n: int) -> Iterator[tuple[int, list[bytes]]]:
    """(bucket, packed keys and columns) for each bucket that gets something."""
    b = bucket_of(keys, n)
    order = np.argsort(b, kind="stable")
    b = b[order]
    start = np.flatnonzero(np.r_[True, b[1:] != b[:-1]]) if len(b) else np.zeros(0, int)
    for i, j in ranges(start, len(b)):
        at = order[i:j]
        yield int(b[i]), [keys[at].tobytes(), *(c[at].tobytes() for c in columns)]


def rows(names: list[str], dealt: list[tuple[int, list[bytes]]], **fixed: int) -> pa.RecordBatch:
    """A record batch of dealt rows: ``bucket``, fixed integers, and one binary column for each name."""
    cols = [pa.array([b for b, _ in dealt], pa.int64()), *(pa.array([v] * len(dealt), pa.int64()) for v in fixed.values())]
    cols += [pa.array([p[k] for _, p in dealt], pa.binary()) for k in range(len(names))]
    return pa.RecordBatch.from_arrays(cols, ["bucket", *fixed, *names])


def merged(table: pa.Table, name: str, dtype) -> np.ndarray:
    """All of a packed column's values, one row after the other."""
    return np.frombuffer(b"".join(table.column(name).to_pylist()), dtype)


def ranges(start: np.ndarray, n: int) -> list[tuple[int, int]]:
    """Begin and end of each group, from where they begin and the number of all values."""
    return list(zip(start, np.append(start[1:], n), strict=True)) if len(start) else []


def group_starts(*keys: np.ndarray) -> np.ndarray:
    """Where each group of equal keys begins, in sorted arrays."""
    n = len(keys[0])
    if not n:
        return np.zeros(0, np.int64)
    new = np.ones(n, bool)
    new[1:] = False
    for k in keys:
        new[1:] |= k[1:] != k[:-1]
    return np.flatnonzero(new)
