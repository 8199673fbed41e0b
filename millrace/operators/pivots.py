"""Exact nearest neighbours that skip blocks of points: blocks around pivots, and the triangle inequality.

Some points are drawn as pivots. Every point goes to its nearest pivot, and a pivot's points, in order of their distance
to it, are cut into blocks: shells between two distances. A query knows its own distances to the pivots, and from these
a distance within which there are k points for sure. A shell that the query's ball of that radius doesn't reach holds no
neighbour and is never met. On vectors without any clusters few shells can be skipped, and ``neighbours.nearest`` does
the same with less ado.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.operators.ranking import row_numbers, top
from millrace.session import written

PIVOTS = 64
BLOCK = 2048
PACK = 256


def _finite(vector: str) -> Column:
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < float("inf")))
    return F.coalesce(F.col(vector).isNotNull() & finite, F.lit(False))


def _rows(column: pa.ListArray, width: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, width)


def _distances(rows: np.ndarray, others: np.ndarray) -> np.ndarray:
    return np.stack([np.sqrt(((rows - o) ** 2).sum(axis=1)) for o in others], axis=1)


def meetings(points: DataFrame, queries: DataFrame, k: int, vector: str, id_: str, label: str, pivots: int, block: int) -> DataFrame | None:
    """(asked, held): packs of queries with the blocks they must look into; None where there are no points.

    Both hold arrays of structs. The driver gets the pivots and two numbers for each.
    """
    used = points.where(_finite(vector)).select(F.col(id_).alias("id"), F.col(label).alias("label"), F.col(vector).alias("v"))
    drawn = top(used, [F.xxhash64("id"), F.col("id")], pivots).select("v").collect()
    if not drawn:
        return None
    width = len(drawn[0][0])
    if not used.where(F.size("v") != width).isEmpty():
        raise ValueError("the points must have one length")
    centres = np.unique(np.array([r[0] for r in drawn], dtype=np.float64).reshape(len(drawn), width), axis=0)

    def place(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in stream:
            away = _distances(_rows(batch.column(2), width), centres)
            own = away.argmin(axis=1)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(own, pa.int32()), pa.array(away[np.arange(len(own)), own])], names=["id", "label", "v", "pivot", "away"]
            )

    kinds = {f.name: f.dataType.simpleString() for f in used.schema}
    placed = used.mapInArrow(place, f"id {kinds['id']}, label {kinds['label']}, v {kinds['v']}, pivot int, away double")
    # In ranges over pivot and distance, so a pivot with most of the points is many tasks.
    numbered = written(row_numbers(placed, ["pivot"], ["away", "id"], "number"), "placed")
    shells = numbered.groupBy("pivot", F.floor((F.col("number") - 1) / block).alias("shell")).agg(
        F.min("away").alias("low"), F.max("away").alias("high"), F.collect_list(F.struct("id", "label", "v")).alias("held")
    )
    sure = np.full(len(centres), np.inf)
    for row in numbered.where(F.col("number") == k).select("pivot", "away").collect():
        sure[row["pivot"]] = row["away"]
    reach = np.full(len(centres), -np.inf)
    for row in numbered.groupBy("pivot").agg(F.max("away").alias("high")).collect():
        reach[row["pivot"]] = row["high"]

    asked = queries.where(_finite(vector) & (F.size(vector) == width)).select("query_id", F.col(vector).alias("v"))

    def ask(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in stream:
            away = _distances(_rows(batch.column(1), width), centres)
            within = (away + sure).min(axis=1)
            within += 1e-9 * (1 + np.where(np.isfinite(within), within, 0) + away.max(axis=1, initial=0))
            query, pivot = np.nonzero(away - reach <= within[:, None])
            taken = pa.array(query)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(taken), batch.column(1).take(taken), pa.array(pivot, pa.int32()), pa.array(away[query, pivot]), pa.array(within[query])],
                names=["query_id", "v", "pivot", "away", "within"],
            )

    kinds = {f.name: f.dataType.simpleString() for f in asked.schema}
    packs = max(1, -(-asked.count() // PACK))
    wanted = asked.mapInArrow(ask, f"query_id {kinds['query_id']}, v {kinds['v']}, pivot int, away double, within double")
    wanted = wanted.groupBy("pivot", F.pmod(F.xxhash64("query_id"), F.lit(packs)).alias("pack")).agg(
        F.min(F.col("away") - F.col("within")).alias("least"), F.max(F.col("away") + F.col("within")).alias("most"),
        F.collect_list(F.struct("query_id", "v", "away", "within")).alias("asked"),
    )
    met = wanted.join(shells, "pivot").where((F.col("low") <= F.col("most")) & (F.col("high") >= F.col("least")))
    return met.select("asked", "held", "low", "high")


def nearest(
    points: DataFrame, queries: DataFrame, k: int, vector: str, id_: str, label: str, pivots: int = PIVOTS, block: int = BLOCK
) -> DataFrame:
    """The k nearest points of every query: ``(query_id, id, label, distance, rn)``, ties to the smaller id.

    As ``neighbours.nearest``, for points of one length; queries of another length find nothing. Null vectors and
    vectors with null, NaN or infinite components take no part. Ids of points must not be null.
    """
    met = meetings(points, queries, k, vector, id_, label, pivots, block)
    kinds = {f.name: f.dataType.simpleString() for f in points.schema.fields}
    fields = f"query_id {queries.schema['query_id'].dataType.simpleString()}, `{id_}` {kinds[id_]}, `{label}` {kinds[label]}, distance double"
    if met is None:
        return queries.sparkSession.createDataFrame([], f"{fields}, rn int")

    def search(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in stream:
            for row in range(batch.num_rows):
                wanted, held = batch.column(0)[row].values, batch.column(1)[row].values
                low, high = batch.column(2)[row].as_py(), batch.column(3)[row].as_py()
                width = len(held.field("v")[0])
                rows, asked = _rows(held.field("v"), width), _rows(wanted.field("v"), width)
                away, within = wanted.field("away").to_numpy(), wanted.field("within").to_numpy()
                ids = held.field("id").to_pylist()
                chosen, owner, distance = [], [], []
                for number in np.flatnonzero((away - within <= high) & (away + within >= low)):
                    apart = np.sqrt(((rows - asked[number]) ** 2).sum(axis=1))
                    keep = min(k, len(apart))
                    close = np.flatnonzero(apart <= np.partition(apart, keep - 1)[keep - 1])
                    best = sorted(close, key=lambda i: (apart[i], ids[i]))[:k]
                    chosen += [int(i) for i in best]
                    distance += [float(apart[i]) for i in best]
                    owner += [int(number)] * len(best)
                taken = pa.array(chosen, pa.int64())
                columns = [wanted.field("query_id").take(pa.array(owner, pa.int64())), held.field("id").take(taken), held.field("label").take(taken)]
                yield pa.RecordBatch.from_arrays([*columns, pa.array(distance, pa.float64())], names=["query_id", id_, label, "distance"])

    found = met.mapInArrow(search, fields)
    order = Window.partitionBy("query_id").orderBy("distance", id_)
    return found.withColumn("rn", F.row_number().over(order)).where(F.col("rn") <= k)
