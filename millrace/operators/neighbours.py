"""k nearest neighbours and a vote among them; k-means clusters."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

QUERY_BLOCK = 256
POINT_BLOCK = 4096


def _blocks(rows: DataFrame, columns: list[str], vector: str, size: int, name: str) -> DataFrame:
    """One row per ``size`` rows of vectors of one length: the columns and vectors as arrays."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < float("inf")))
    numbered = rows.where(F.col(vector).isNotNull() & finite)
    numbered = numbered.withColumn("_block", F.floor(F.monotonically_increasing_id() / size))
    fields = F.struct(*columns, F.transform(vector, lambda x: x.cast("double")).alias("_vector"))
    return numbered.groupBy("_block", F.size(vector).alias("_width")).agg(F.collect_list(fields).alias(name))


def nearest(points: DataFrame, queries: DataFrame, k: int, vector: str, id_: str, label: str) -> DataFrame:
    """The k nearest points of every query: ``(query_id, id, label, distance, rn)``, ties to the smaller id.

    ``queries`` has ``query_id`` and the vector. Queries and points are packed into blocks, and each query block
    meets each point block once, in one job: a pair of blocks gives k rows per query, and only those are shuffled.
    Vectors meet vectors of their own length; null vectors and vectors with null, NaN or infinite
    components take no part.
    """
    lanes = int(points.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    have = _blocks(points, [id_, label], vector, POINT_BLOCK, "_points")
    have = have.withColumn("_lane", F.pmod(F.xxhash64("_block"), F.lit(lanes)))
    asked = _blocks(queries, ["query_id"], vector, QUERY_BLOCK, "_queries")
    asked = asked.withColumn("_lane", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(lanes - 1).cast("long"))))
    pairs = have.select("_lane", "_width", "_points").join(asked.select("_lane", "_width", "_queries"), ["_lane", "_width"])

    def matrix(vectors: pa.Array, width: int) -> np.ndarray:
        return vectors.flatten().to_numpy(zero_copy_only=False).reshape(-1, width)

    def search(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in stream:
            for row in range(batch.num_rows):
                width = batch.column(0)[row].as_py()
                held, wanted = batch.column(1)[row].values, batch.column(2)[row].values
                points_, queries_ = matrix(held.field("_vector"), width), matrix(wanted.field("_vector"), width)
                ids = held.field(id_).to_pylist()
                squared = (points_**2).sum(axis=1)
                room = 1e-9 * (1.0 + squared.max() + (queries_**2).sum(axis=1).max())
                keep = min(k, len(points_))
                chosen, owner, distance = [], [], []
                for number, query in enumerate(queries_):
                    # Candidates by the fast formula with room for its rounding, then exact distances, so that
                    # ties at the cut are decided by id.
                    gap = squared - 2.0 * points_ @ query
                    near = np.flatnonzero(gap <= np.partition(gap, keep - 1)[keep - 1] + room)
                    exact = np.sqrt(((points_[near] - query) ** 2).sum(axis=1))
                    best = sorted(range(len(near)), key=lambda i: (exact[i], ids[near[i]]))[:k]
                    chosen += [int(near[i]) for i in best]
                    distance += [float(exact[i]) for i in best]
                    owner += [number] * len(best)
                taken, owners = pa.array(chosen, pa.int64()), pa.array(owner, pa.int64())
                columns = [wanted.field("query_id").take(owners), held.field(id_).take(taken), held.field(label).take(taken)]
                yield pa.RecordBatch.from_arrays([*columns, pa.array(distance, pa.float64())], names=["query_id", id_, label, "distance"])

    kinds = {f.name: f.dataType.simpleString() for f in points.schema.fields}
    query_kind = queries.schema["query_id"].dataType.simpleString()
    found = pairs.select("_width", "_points", "_queries").mapInArrow(
        search, f"query_id {query_kind}, `{id_}` {kinds[id_]}, `{label}` {kinds[label]}, distance double"
    )
    return _first_k(found, k, id_)


def _first_k(found: DataFrame, k: int, id_: str) -> DataFrame:
    order = Window.partitionBy("query_id").orderBy("distance", id_)
    return found.withColumn("rn", F.row_number().over(order)).where(F.col("rn") <= k)


def vote(neighbours: DataFrame, label: str) -> DataFrame:
    """The label most neighbours have; of equally frequent ones the smallest."""
    votes = neighbours.groupBy("query_id", label).agg(F.count("*").alias("votes"))
    best = F.min_by(F.struct(label, "votes"), F.struct(-F.col("votes"), F.col(label)))
    return votes.groupBy("query_id").agg(best.alias("_best")).select("query_id", "_best.*")


def centroids(points: DataFrame, vector: str, label: str) -> DataFrame:
    """Mean vector of every label, summed per dimension so that a hot label is spread out."""
    sums = (
        points.select(label, F.posexplode(vector).alias("dim", "x"))
        .groupBy(label, "dim")
        .agg(F.avg(F.col("x").cast("double")).alias("x"))
    )
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("dim", "x"))), lambda s: s["x"])
    return sums.groupBy(label).agg(ordered.alias(vector))


def kmeans(points: DataFrame, vector: str, k: int, seed: int = 7) -> DataFrame:
    """Every point with the number of its cluster."""
    prepared = points.withColumn("_features", array_to_vector(F.transform(vector, lambda x: x.cast("double"))))
    model = KMeans(k=k, seed=seed, featuresCol="_features", predictionCol="cluster").fit(prepared)
    return model.transform(prepared).drop("_features")


def assigned(points: DataFrame, centres: DataFrame, vector: str, id_: str, label: str) -> DataFrame:
    """One step of k-means from given centres: every point with the nearest ``centre_id`` and the distance.

    ``centres`` has ``centre_id`` and the vector; ``centroids`` of the result by ``centre_id`` are the next centres.
    """
    asked = points.select(F.col(id_).alias("query_id"), vector)
    known = centres.select(F.col("centre_id").alias(id_), vector, F.lit(0).alias(label))
    return nearest(known, asked, 1, vector, id_, label).select(F.col("query_id").alias("_id"), F.col(id_).alias("centre_id"), "distance").withColumnRenamed("_id", id_)
