"""What the operators on vectors share: which vectors count, matrices out of Arrow lists, whole sums as rows."""

from __future__ import annotations

from collections.abc import Iterator
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WHOLE = pa.decimal128(38, 0)
# Sums of 64-bit numbers are emptied before they reach this.
ROOM = 2.0**62


def is_finite(vector: str) -> Column:
    """True where the vector is there and holds finite numbers only."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < float("inf")))
    return F.coalesce(F.col(vector).isNotNull() & finite, F.lit(False))


def by_width(column: pa.ListArray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(rows, their vectors as a matrix of doubles) for each length among the vectors of a batch."""
    lengths = np.diff(column.offsets.to_numpy())
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    starts = np.cumsum(lengths) - lengths
    for width in np.unique(lengths):
        rows = np.flatnonzero(lengths == width)
        yield rows, flat[starts[rows][:, None] + np.arange(width)]


def floors(values: np.ndarray, scale: float, limit: float) -> np.ndarray:
    """``floor(scale * x)`` as long; what lies beyond ``limit`` counts as that."""
    return np.clip(np.floor(scale * values), -limit, limit).astype(np.int64)


def wholes(numbers: np.ndarray) -> pa.Array:
    """Whole numbers, 64 bits or Python's own, as decimals."""
    if numbers.dtype == object:
        return pa.array([Decimal(int(x)) for x in numbers], WHOLE)
    return pa.array(numbers, pa.int64()).cast(WHOLE)


def exact_type(largest: float, terms: int) -> type:
    """The kind of numbers in which a sum of ``terms`` squares of numbers up to ``largest`` is exact."""
    return np.int64 if float(largest) ** 2 * max(1, terms) < ROOM else object


def summed(parts: DataFrame, keys: list[str]) -> dict[tuple, int]:
    """Exact sums of the column ``total`` by key. One row per key reaches the driver: a bound by kinds of keys, not rows."""
    rows = parts.groupBy(*keys).agg(F.sum("total").alias("total")).collect()
    return {tuple(row[k] for k in keys): int(row["total"]) for row in rows}
