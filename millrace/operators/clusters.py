"""k-means as Spark jobs of its own: seeding by hash draws, and steps until nothing moves.

A step is one pass over the points and one aggregation: tasks add up, per cluster, how many points are nearest and their
sums, and only these numbers (k times the dimensions) are shuffled and reach the driver. The points are never moved.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.operators.ranking import top


@dataclass
class Clusters:
    """``centres`` (a row each), the steps taken, and whether the last step moved nothing."""

    centres: np.ndarray
    steps: int
    settled: bool


def _usable(points: DataFrame, vector: str, width: int | None = None) -> DataFrame:
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < float("inf")))
    kept = points.where(F.col(vector).isNotNull() & finite)
    return kept if width is None else kept.where(F.size(vector) == width)


def _matrix(column: pa.ListArray, width: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, width)


def _nearest(rows: np.ndarray, centres: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(number of the nearest centre, ties to the lower; its squared distance)."""
    number, squared = np.zeros(len(rows), np.int64), np.full(len(rows), np.inf)
    for place, centre in enumerate(centres):
        apart = ((rows - centre) ** 2).sum(axis=1)
        closer = apart < squared
        number[closer], squared[closer] = place, apart[closer]
    return number, squared


def seeds(points: DataFrame, vector: str, ident: str, k: int, rounds: int = 4, seed: int = 7) -> np.ndarray:
    """k-means||: in each round a point becomes a candidate with a chance in proportion to its squared distance from the
    candidates so far, about ``2 k`` a round; the candidates, weighted by the points nearest to them, are then reduced to
    ``k`` on the driver. Draws are hashes of the id and the round, so another run finds the same."""
    first = _usable(points, vector).where(F.col(ident).isNotNull())
    found = top(first, [F.xxhash64(ident, F.lit(seed)), F.col(ident)], 1).select(vector).head()
    if found is None:
        return np.zeros((0, 0))
    candidates = np.array([found[0]], dtype=np.float64)
    rows = first.where(F.size(vector) == candidates.shape[1])
    for number in range(rounds):
        total = _spread(rows, vector, candidates)
        if total == 0:
            break
        held = candidates
        draw = (F.pmod(F.xxhash64(ident, F.lit(f"{seed}/{number}")), F.lit(1 << 52)) / F.lit(float(1 << 52))).alias("draw")

        def work(stream: Iterator[pa.RecordBatch], held: np.ndarray = held, total: float = total) -> Iterator[pa.RecordBatch]:
            for batch in stream:
                _, squared = _nearest(_matrix(batch.column(0), held.shape[1]), held)
                chosen = np.flatnonzero(batch.column(1).to_numpy() < 2 * k * squared / total)
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(chosen)).cast(pa.list_(pa.float64()))], names=["v"])

        drawn = rows.select(vector, draw).mapInArrow(work, "v array<double>").distinct().orderBy("v").collect()
        candidates = np.concatenate([candidates, np.array([r["v"] for r in drawn], dtype=np.float64).reshape(-1, candidates.shape[1])])
    weights = _totals(rows, vector, candidates)[:, 0]
    return _reduced(candidates, weights, k, seed)


def _reduced(candidates: np.ndarray, weights: np.ndarray, k: int, seed: int) -> np.ndarray:
    """k-means++ on the weighted candidates."""
    draw = np.random.default_rng(seed)
    chosen = [int(weights.argmax())]
    while len(chosen) < min(k, len(candidates)):
        _, squared = _nearest(candidates, candidates[chosen])
        chance = weights * squared
        if chance.sum() <= 0:
            break
        chosen.append(int(draw.choice(len(candidates), p=chance / chance.sum())))
    return candidates[chosen]


def _spread(rows: DataFrame, vector: str, centres: np.ndarray) -> float:
    def work(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in stream:
            _, squared = _nearest(_matrix(batch.column(0), centres.shape[1]), centres)
            yield pa.RecordBatch.from_arrays([pa.array([float(squared.sum())])], names=["s"])

    return rows.select(vector).mapInArrow(work, "s double").agg(F.coalesce(F.sum("s"), F.lit(0.0))).head()[0]


def _totals(rows: DataFrame, vector: str, centres: np.ndarray) -> np.ndarray:
    """For each centre how many points are nearest to it, and their sums."""

    def work(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.zeros((len(centres), centres.shape[1] + 1))
        for batch in stream:
            values = _matrix(batch.column(0), centres.shape[1])
            number, _ = _nearest(values, centres)
            held[:, 0] += np.bincount(number, minlength=len(centres))
            np.add.at(held[:, 1:], number, values)
        cluster, place = np.indices(held.shape).reshape(2, -1)
        yield pa.RecordBatch.from_arrays([pa.array(cluster), pa.array(place), pa.array(held.ravel())], names=["cluster", "place", "total"])

    parts = rows.select(vector).mapInArrow(work, "cluster long, place long, total double")
    found = np.zeros((len(centres), centres.shape[1] + 1))
    for row in parts.groupBy("cluster", "place").agg(F.sum("total").alias("total")).collect():
        found[row["cluster"], row["place"]] = row["total"]
    return found


def fit(points: DataFrame, vector: str, start: np.ndarray, most_steps: int = 50, still: float = 1e-9) -> Clusters:
    """Steps from the centres ``start`` until no centre moves by more than ``still``, at most ``most_steps``.

    A centre without points stays where it is. Vectors of another length than the centres', null ones and ones with
    null, NaN or infinite components take no part.
    """
    centres = np.array(start, dtype=np.float64)
    rows = _usable(points, vector, centres.shape[1] if centres.size else 0)
    for step in range(1, most_steps + 1):
        if not centres.size:
            return Clusters(centres, 0, True)
        totals = _totals(rows, vector, centres)
        counts = totals[:, :1]
        moved = np.where(counts > 0, totals[:, 1:] / np.maximum(counts, 1), centres)
        distance = float(np.abs(moved - centres).max())
        centres = moved
        if distance <= still:
            return Clusters(centres, step, True)
    return Clusters(centres, most_steps, False)


def assign(points: DataFrame, vector: str, ident: str, centres: np.ndarray) -> DataFrame:
    """(``ident``, cluster, distance) of every vector ``fit`` takes, ties to the lower number."""
    rows = _usable(points, vector, centres.shape[1] if centres.size else -1).select(F.col(ident).alias("i"), F.col(vector).alias("v"))

    def work(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in stream:
            number, squared = _nearest(_matrix(batch.column(1), centres.shape[1]), centres)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(number, pa.int32()), pa.array(np.sqrt(squared))], names=["i", "cluster", "distance"])

    found = rows.mapInArrow(work, f"i {rows.schema['i'].dataType.simpleString()}, cluster int, distance double")
    return found.withColumnRenamed("i", ident)
