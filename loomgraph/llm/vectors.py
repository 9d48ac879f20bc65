"""What the two operators on embeddings share: which vectors take part, and vectors as bytes."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F


def usable(v: str) -> Column:
    """Not null, not zero, and without null, NaN or infinite components."""
    bad = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    return F.col(v).isNotNull() & (F.size(v) > 0) & ~F.coalesce(F.exists(v, bad), F.lit(True)) & F.coalesce(F.exists(v, lambda x: x != 0), F.lit(False))


def matrix(lists: pa.Array, d: int) -> np.ndarray:
    """Vectors of d components, as rows of doubles."""
    return np.asarray(lists.flatten(), float).reshape(-1, d)


def stack(blobs: list[bytes], d: int) -> np.ndarray:
    return np.frombuffer(b"".join(blobs), float).reshape(-1, d)


def to_blobs(x: np.ndarray) -> pa.Array:
    x = np.ascontiguousarray(x, float)
    return pa.array([r.tobytes() for r in x], pa.binary())


def groups(batches, key: int):
    """Runs of rows that agree in the first `key` columns, over a task's rows sorted by them, as (values, table)."""
    now, held = None, []
    for batch in batches:
        cols = [batch.column(i).to_numpy(zero_copy_only=False) for i in range(key)]
        n = batch.num_rows
        new = np.zeros(n + 1, bool)
        new[0] = new[n] = True
        for c in cols:
            new[1:n] |= c[1:] != c[:-1]
        at = np.flatnonzero(new)
        for a, b in zip(at[:-1], at[1:], strict=True):
            k = tuple(c[a] for c in cols)
            if k != now:
                if held:
                    yield now, pa.Table.from_batches(held)
                now, held = k, []
            held.append(batch.slice(a, b - a))
    if held:
        yield now, pa.Table.from_batches(held)
