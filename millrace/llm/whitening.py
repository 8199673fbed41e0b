"""Whitening of vectors: eigenvectors found in single precision and refined by matrix products in extended precision.

The covariance is exact: two scans count whole numbers, first their sums, then the products of what is left after the
(whole) mean is taken off. Its eigenvectors start as those of LAPACK in float32. Each Ogita-Aishima step then takes
four matrix products in extended precision and roughly squares the error; eigenvalues too close for a step to tell
apart form a cluster, whose block of the matrix, less the cluster's mean, is solved on its own.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import map_arrow
from millrace.llm.vectors import ROOM, by_width, exact_type, floors, is_finite, summed, wholes

SCALE = 64
SHIFT = 1_000_000
# Whole numbers beyond this count as this, so that sums of products of 10^12 rows stay within 38 digits.
LIMIT = 2.0**40
EXTENDED = np.longdouble
MOST_STEPS = 40


@dataclass
class Model:
    """What whitens vectors of one length.

    ``mean`` is the whole part of each dimension's mean and ``rest`` (from 0 to n - 1) is what the sum has beyond n
    times that. ``values`` and ``vectors`` (a row each) are the eigenpairs by falling value; ``trace`` is that of the
    covariance. ``identity_error`` is measured on the rows.
    """

    n: int
    mean: np.ndarray
    rest: np.ndarray
    values: np.ndarray
    vectors: np.ndarray
    trace: float
    identity_error: float | None = None

    def usable(self) -> np.ndarray:
        """Which components vary at all: an eigenvalue of rounding size can't be divided by."""
        least = len(self.mean) * np.finfo(np.float64).eps * (self.values[0] if len(self.values) else 0.0)
        return self.values > least

    def whiten(self, rows: np.ndarray) -> np.ndarray:
        """Whole numbers less ``mean`` to whitened rows; NaN at components that don't vary."""
        usable = self.usable()
        weights = self.vectors[usable] / np.sqrt(self.values[usable])[:, None]
        out = np.full((len(rows), len(usable)), np.nan)
        out[:, usable] = (rows.astype(np.float64) - self.rest.astype(np.float64) / self.n) @ weights.T
        return out

    def deviations(self, rows: np.ndarray) -> np.ndarray:
        """Sum over dimensions of ``(n * x - sum)^2``, exact, of whole numbers less ``mean``."""
        largest = float(np.abs(rows).max()) if rows.size else 0.0
        kind = exact_type(largest, rows.shape[1])
        squares = (rows.astype(kind) ** 2).sum(axis=1)
        mixed = rows.astype(object) @ self.rest.astype(object) if largest * self.n * rows.shape[1] >= ROOM else rows @ self.rest
        if (largest + 1) ** 2 * float(self.n) ** 2 * max(1, rows.shape[1]) >= ROOM:
            squares, mixed = squares.astype(object), mixed.astype(object)
        return self.n * self.n * squares - 2 * self.n * mixed + sum(int(r) ** 2 for r in self.rest)


def _clusters(values: np.ndarray, width: float) -> list[np.ndarray]:
    """Places of values that lie within ``width`` of a neighbour, where there are two or more."""
    order = np.argsort(values, kind="stable")
    cuts = np.flatnonzero(np.diff(values[order]) > width) + 1
    return [places for places in np.split(order, cuts) if len(places) > 1]


def _step(matrix: np.ndarray, size: float, basis: np.ndarray) -> tuple[np.ndarray, float]:
    """One refinement step, with a solve of its own for each cluster. Returns the basis and the size of the change."""
    applied = matrix @ basis
    gram = np.eye(len(matrix), dtype=EXTENDED) - basis.T @ basis
    seen = basis.T @ applied
    # Equal on both sides of the diagonal, so that rounding turns close vectors about each other but not apart.
    gram, seen = (gram + gram.T) / 2, (seen + seen.T) / 2
    values = np.diag(seen) / (1 - np.diag(gram))
    off = np.linalg.norm((seen - np.diag(np.diag(seen))).astype(np.float64), 2)
    width = 2 * (off + size * np.linalg.norm(gram.astype(np.float64), 2))
    apart = values[None, :] - values[:, None]
    near = np.abs(apart) <= width
    change = np.where(near, gram / 2, (seen + values[None, :] * gram) / np.where(near, 1, apart))
    basis = basis + basis @ change
    moved = float(np.abs(change).max())
    for places in _clusters(values, width):
        own = basis[:, places]
        block = own.T @ (matrix @ own - values[places].mean() * own)
        block = (block + block.T) / 2
        largest = np.abs(block - np.diag(np.diag(block))).max()
        if largest > 4 * len(matrix) * np.finfo(EXTENDED).eps * size:
            scale = np.abs(block).max()
            turned = np.linalg.eigh((block / scale).astype(np.float32))[1]
            basis[:, places] = own @ turned.astype(EXTENDED)
            moved = max(moved, 1e-6)
    return basis, moved


def eigenpairs(matrix: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(values, vectors as rows) of a symmetric matrix, by falling value; the largest entry of a vector is positive."""
    matrix = np.asarray(matrix, dtype=EXTENDED)
    largest = np.abs(matrix).max() if matrix.size else EXTENDED(0)
    if not largest > 0:
        return np.zeros(len(matrix)), np.eye(len(matrix))
    matrix = matrix / largest
    size = float(np.linalg.norm(matrix.astype(np.float64), 2))
    basis = np.linalg.eigh(matrix.astype(np.float32))[1].astype(EXTENDED)
    last = np.inf
    for _ in range(MOST_STEPS):
        basis, moved = _step(matrix, size, basis)
        # At the end steps only stir the last bits.
        if moved <= 16 * len(matrix) * np.finfo(EXTENDED).eps or (moved < 1e-8 and moved > last / 4):
            break
        last = moved
    basis = basis / np.sqrt((basis * basis).sum(axis=0))
    values = (basis * (matrix @ basis)).sum(axis=0)
    order = np.argsort(-values, kind="stable")
    vectors = basis.T[order].astype(np.float64)
    peaks = vectors[np.arange(len(vectors)), np.abs(vectors).argmax(axis=1)]
    return (values[order] * largest).astype(np.float64), vectors * np.sign(peaks)[:, None]


def _whole(values: np.ndarray, scale: float, shift: int) -> np.ndarray:
    return floors(values, scale, LIMIT) + shift


def _sums(rows: DataFrame, scale: float, shift: int) -> dict[tuple, int]:
    """(width, dimension): sum, and (width, -1): rows."""

    def work(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
        held: dict[int, np.ndarray] = {}
        for batch in stream:
            for places, values in by_width(batch.column(0)):
                numbers = _whole(values, scale, shift).sum(axis=0).astype(object)
                counted = np.append(numbers, len(places))
                held[values.shape[1]] = held.get(values.shape[1], 0) + counted
        for width, sums in held.items():
            dims = pa.array([*range(width), -1], pa.int32())
            yield pa.table({"width": pa.array([width] * (width + 1), pa.int32()), "dim": dims, "total": wholes(sums)})

    return summed(map_arrow(rows, work, "width int, dim int, total decimal(38,0)"), ["width", "dim"])


def _products(rows: DataFrame, means: dict[int, np.ndarray], scale: float, shift: int) -> dict[tuple, int]:
    """(width, i, j) with i <= j: sum of the products of dimensions i and j, each less its whole mean."""

    def emptied(width: int, sums: np.ndarray) -> pa.Table:
        i, j = np.triu_indices(width)
        return pa.table(
            {"width": pa.array(np.full(len(i), width), pa.int32()), "i": pa.array(i, pa.int32()), "j": pa.array(j, pa.int32()), "total": wholes(sums[i, j])}
        )

    def work(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
        held: dict[int, tuple[np.ndarray, float]] = {}
        for batch in stream:
            for places, values in by_width(batch.column(0)):
                width = values.shape[1]
                centred = _whole(values, scale, shift) - means[width]
                bound = float(np.abs(centred).max()) ** 2 * len(places) if centred.size else 0.0
                if bound >= ROOM:
                    big = centred.astype(object)
                    yield emptied(width, big.T @ big)
                    continue
                # Doubles hold these sums exactly below 2^53, and are many times faster.
                product = (centred.T.astype(np.float64) @ centred.astype(np.float64)).astype(np.int64) if bound < 2.0**53 else centred.T @ centred
                sums, reached = held.get(width, (None, 0.0))
                if sums is not None and reached + bound >= ROOM:
                    yield emptied(width, sums)
                    sums, reached = None, 0.0
                held[width] = (product if sums is None else sums + product, reached + bound)
        for width, (sums, _) in held.items():
            yield emptied(width, sums)

    return summed(map_arrow(rows, work, "width int, i int, j int, total decimal(38,0)"), ["width", "i", "j"])


def covariance(n: int, rest: np.ndarray, products: np.ndarray) -> np.ndarray:
    """Extended-precision covariance (divisor n) from exact sums; ``products`` holds Python's whole numbers."""
    above = n * products - np.outer(rest.astype(object), rest.astype(object))
    extended = np.array([EXTENDED(str(x)) for x in above.ravel()], dtype=EXTENDED).reshape(above.shape)
    return extended / EXTENDED(str(n * n))


def fit(df: DataFrame, vector: str, components: int = 32, scale: float = SCALE, shift: int = SHIFT) -> dict[int, Model]:
    """A model for each length of vector among the rows whose vector is there and finite, over all of them.

    Entries count as ``floor(scale * x) + shift``. Vectors of another length are a fit list of their own. The driver
    gets sums, width^2 / 2 numbers a length however many rows there are. A model keeps ``components`` eigenpairs at
    most. An empty table gives no model.
    """
    rows = df.where(is_finite(vector)).select(F.col(vector).alias("values"))
    sums = _sums(rows, scale, shift)
    counts = {width: n for (width, dim), n in sums.items() if dim == -1}
    totals = {width: [sums[width, d] for d in range(width)] for width in counts}
    means = {width: np.array([s // counts[width] for s in totals[width]], dtype=np.int64) for width in counts}
    products = _products(rows, means, scale, shift)
    models = {}
    for width, n in counts.items():
        rest = np.array([s - n * int(m) for s, m in zip(totals[width], means[width], strict=True)], dtype=np.int64)
        exact = np.empty((width, width), dtype=object)
        for i in range(width):
            for j in range(i, width):
                exact[i, j] = exact[j, i] = products[width, i, j]
        matrix = covariance(n, rest, exact)
        values, vectors = eigenpairs(matrix)
        models[width] = Model(n, means[width], rest, values[:components], vectors[:components], float(np.trace(matrix)))
    for width, error in identity_errors(df, vector, models, scale, shift).items():
        models[width].identity_error = error
    return models


def identity_errors(df: DataFrame, vector: str, models: dict[int, Model], scale: float = SCALE, shift: int = SHIFT) -> dict[int, float]:
    """Largest absolute entry of (covariance of the whitened rows - identity), measured over all rows, per length."""
    rows = df.where(is_finite(vector)).select(F.col(vector).alias("values"))

    def work(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
        held: dict[int, np.ndarray] = {}
        for batch in stream:
            for _, values in by_width(batch.column(0)):
                model = models[values.shape[1]]
                white = model.whiten(_whole(values, scale, shift) - model.mean)[:, model.usable()]
                held[values.shape[1]] = held.get(values.shape[1], 0) + np.vstack((white.sum(axis=0), white.T @ white))
        for width, sums in held.items():
            i, j = np.indices(sums.shape).reshape(2, -1)
            yield pa.table(
                {"width": pa.array(np.full(len(i), width), pa.int32()), "i": pa.array(i, pa.int32()), "j": pa.array(j, pa.int32()), "total": pa.array(sums.ravel())}
            )

    parts = map_arrow(rows, work, "width int, i int, j int, total double")
    found: dict[int, dict] = {}
    for row in parts.groupBy("width", "i", "j").agg(F.sum("total").alias("total")).collect():
        found.setdefault(row["width"], {})[row["i"], row["j"]] = row["total"]
    errors = {}
    for width, sums in found.items():
        k = max(j for _, j in sums) + 1
        table = np.array([[sums[i, j] for j in range(k)] for i in range(k + 1)]) / models[width].n
        errors[width] = float(np.abs(table[1:] - np.outer(table[0], table[0]) - np.eye(k)).max())
    return errors


def whiten(df: DataFrame, ident: str, vector: str, models: dict[int, Model], scale: float = SCALE, shift: int = SHIFT) -> DataFrame:
    """Every row whose vector is there and finite, whitened by the model of its length.

    Returns ``ident``, n, deviation (decimal; sum over dimensions of ``(n * x - sum)^2``, exact; null beyond 38
    digits), whitened (an array by component; null where a component doesn't vary, as when there are fewer rows than
    dimensions), explained (an array: share of the trace; null if nothing varies), identity_error (null if nothing
    varies). Null and repeated ids are rows like others; vectors of a length no model knows are left out.
    """
    rows = df.where(is_finite(vector) & F.size(vector).isin(list(models))).select(F.col(ident).alias("ident"), F.col(vector).alias("values"))
    kind = rows.schema["ident"].dataType.simpleString()

    def work(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
        for batch in stream:
            for places, values in by_width(batch.column(1)):
                width = values.shape[1]
                model = models[width]
                centred = _whole(values, scale, shift) - model.mean
                white = model.whiten(centred)
                ends = pa.array(np.arange(len(places) + 1) * white.shape[1], pa.int32())
                deviations = model.deviations(centred)
                if deviations.dtype == object:
                    deviations = np.array([d if d < 10**38 else None for d in deviations], dtype=object)
                    deviations = pa.array([None if d is None else str(d) for d in deviations], pa.string())
                else:
                    deviations = pa.array(deviations, pa.int64()).cast(pa.string())
                yield pa.table(
                    {
                        "ident": batch.column(0).take(pa.array(places)),
                        "width": pa.array(np.full(len(places), width), pa.int32()),
                        "deviation": deviations,
                        "whitened": pa.ListArray.from_arrays(ends, pa.array(white.ravel(), from_pandas=True)),
                    }
                )

    found = map_arrow(rows, work, f"ident {kind}, width int, deviation string, whitened array<double>")
    facts = []
    for width, model in models.items():
        share = [float(v) / model.trace if model.trace > 0 else None for v in model.values]
        share = F.array(*[F.lit(s).cast("double") for s in share]).cast("array<double>")
        fact = F.struct(F.lit(model.n).cast("long").alias("n"), share.alias("explained"), F.lit(model.identity_error).cast("double").alias("identity_error"))
        facts += [F.lit(width), fact]
    if not facts:
        return found.select(
            F.col("ident").alias(ident), F.lit(0).cast("long").alias("n"), F.col("deviation").cast("decimal(38,0)").alias("deviation"), "whitened",
            F.col("whitened").alias("explained"), F.lit(None).cast("double").alias("identity_error"),
        )
    fact = F.element_at(F.create_map(*facts), F.col("width"))
    return found.withColumn("fact", fact).select(
        F.col("ident").alias(ident), "fact.n", F.col("deviation").cast("decimal(38,0)").alias("deviation"), "whitened", "fact.explained", "fact.identity_error"
    )
