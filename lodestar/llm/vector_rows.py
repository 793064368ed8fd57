"""Vectors as rows of integers."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Steps of a unit, and the magnitude that integers are held within, so that sums of their squares stay in a long.
STEPS, MOST = 256, 1 << 24
#: Vector components that are made integers at a time.
_CELLS = 1 << 20


def finite(v: Column) -> Column:
    """Neither null nor with a null or non-finite component."""
    return v.isNotNull() & F.forall(F.coalesce(v, F.array()), lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))


def first_rows(rows: DataFrame, n: int, column: str = "embedding") -> list:
    """The n rows of the smallest vec_ids, null ones last, equal ones by vector."""
    return rows.select("vec_id", column).orderBy(F.col("vec_id").asc_nulls_last(), column).limit(n).collect()


def blocks(batches: Iterator[pa.RecordBatch], size: int, column: str = "embedding") -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    """Slices of the batches and their vectors, all of `size` components, as doubles that are integers: floor(STEPS * x)."""
    step = max(1, _CELLS // size)
    for batch in batches:
        for i in range(0, batch.num_rows, step):
            part = batch.slice(i, step)
            x = part.column(column).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, size)
            yield part, np.clip(np.floor(STEPS * x), -MOST, MOST)
