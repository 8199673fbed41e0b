"""Exact top-k inner products over a bit-sliced index."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from millrace.llm.common import map_arrow

BLOCK = 16384
QUERY_BLOCK = 128


def quantised(df: DataFrame, ident: str, vector: str, scale: int) -> DataFrame:
    """(vec_id, values): ``floor(scale * x)`` as long; vectors with null or non-finite components are left out."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < float("inf")))
    kept = df.where(F.col(vector).isNotNull() & finite)
    values = F.transform(F.col(vector), lambda x: F.floor(F.lit(float(scale)) * x.cast("double")).cast("long"))
    return kept.select(F.col(ident).cast("long").alias("vec_id"), values.alias("values"))


def _blocks(stream: Iterator[pa.RecordBatch], size: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Ids and values in blocks of at most ``size`` rows of one length, ordered by id."""
    held: dict[int, list] = {}
    for batch in stream:
        ids = np.array(batch.column(0).to_pylist(), dtype=np.int64)
        lists = batch.column(1)
        lengths = np.diff(lists.offsets.to_numpy())
        flat = lists.flatten().to_numpy(zero_copy_only=False)
        ends = np.cumsum(lengths)
        for width in np.unique(lengths):
            rows = np.flatnonzero(lengths == width)
            values = flat[(ends[rows] - width)[:, None] + np.arange(width)[None, :]].astype(np.int64)
            waiting = held.setdefault(int(width), [])
            waiting.append((ids[rows], values))
            if sum(len(i) for i, _ in waiting) >= size:
                yield from _cut(held.pop(int(width)), size)
    for waiting in held.values():
        yield from _cut(waiting, size)


def _cut(waiting: list, size: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    ids, values = np.concatenate([i for i, _ in waiting]), np.concatenate([v for _, v in waiting])
    order = np.argsort(ids, kind="stable")
    for start in range(0, len(order), size):
        rows = order[start : start + size]
        yield ids[rows], values[rows]


def _packed(bits: np.ndarray) -> np.ndarray:
    """Rows of booleans as rows of 64-bit words."""
    octets = np.packbits(bits, axis=-1, bitorder="little")
    pad = -octets.shape[-1] % 8
    return np.ascontiguousarray(np.pad(octets, [(0, 0)] * (octets.ndim - 1) + [(0, pad)])).view(np.uint64)


def build_index(vectors: DataFrame) -> DataFrame:
    """One row per block of vectors: ids in order, each component's least value, and its bit slices.

    A slice is a bitmap over the block's rows: bit b of (component - least value of the component).
    Blocks hold at most ``BLOCK`` rows.
    """

    def work(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
        for ids, values in _blocks(stream, BLOCK):
            low = values.min(axis=0) if len(values) else np.zeros(0, np.int64)
            above = (values - low).astype(np.uint64)
            bits = max(1, int(above.max()).bit_length()) if above.size else 1
            slices = [_packed(((above >> np.uint64(b)) & np.uint64(1)).T.astype(bool)) for b in range(bits)]
            slices = np.stack(slices, axis=1) if values.shape[1] else np.zeros((0, bits, 0), np.uint64)
            yield pa.table(
                {
                    "width": pa.array([values.shape[1]], pa.int32()),
                    "bits": pa.array([bits], pa.int32()),
                    "ids": pa.array([ids.tobytes()], pa.binary()),
                    "low": pa.array([low.tobytes()], pa.binary()),
                    "slices": pa.array([slices.tobytes()], pa.binary()),
                }
            )

    return map_arrow(vectors, work, "width int, bits int, ids binary, low binary, slices binary")


def _added(levels: dict[int, np.ndarray]) -> list[np.ndarray]:
    """Bitmaps by power of two, added up with carry-save adders: the slices of the sums."""
    total, power = [], 0
    while levels:
        maps = levels.pop(power, None)
        carries = []
        while maps is not None and len(maps) > 1:
            if len(maps) == 2:
                carries.append((maps[0] & maps[1])[None])
                maps = (maps[0] ^ maps[1])[None]
                break
            third = len(maps) // 3
            a, b, c = maps[:third], maps[third : 2 * third], maps[2 * third : 3 * third]
            half = a ^ b
            carries.append((a & b) | (half & c))
            maps = np.concatenate((half ^ c, maps[3 * third :]))
        if carries:
            more = levels.get(power + 1)
            levels[power + 1] = np.concatenate([*carries, *([more] if more is not None else [])])
        total.append(None if maps is None else maps[0])
        power += 1
    return total


def _best(slices: list[np.ndarray | None], allowed: np.ndarray, k: int) -> np.ndarray:
    """Rows of the k largest sums, from the most significant slice down; ties go to the first rows."""
    sure, open_ = np.zeros_like(allowed), allowed
    need = min(k, int(np.bitwise_count(allowed).sum()))
    for bitmap in reversed(slices):
        if bitmap is None:
            continue
        high = open_ & bitmap
        count = int(np.bitwise_count(high).sum())
        if count > need:
            open_ = high
        else:
            sure |= high
            need -= count
            open_ = open_ & ~bitmap
        if not need:
            break
    rows = np.flatnonzero(np.unpackbits(sure.view(np.uint8), bitorder="little"))
    if need:
        ties = np.flatnonzero(np.unpackbits(open_.view(np.uint8), bitorder="little"))[:need]
        rows = np.concatenate((rows, ties))
    return rows


def search_block(query: np.ndarray, own: int, ids: np.ndarray, low: np.ndarray, slices: np.ndarray, k: int) -> tuple:
    """(ids, scores) of the block's k best rows for one query, by bitmap arithmetic only.

    A negative weight counts the complement of a slice, so every bitmap is added with a positive power.
    """
    width, bits, words = slices.shape
    allowed = _packed((ids != own)[None])[0]
    weights = [int(w) for w in query]
    constant = sum(w * int(x) for w, x in zip(weights, low, strict=True))
    constant += sum(w * ((1 << bits) - 1) for w in weights if w < 0)
    size = np.array([abs(w) for w in weights], dtype=object if any(abs(w) >> 62 for w in weights) else np.int64)
    negative = np.array([w < 0 for w in weights], dtype=bool)
    signed = np.where(negative[:, None, None], ~slices, slices) if width else slices
    levels: dict[int, list] = {}
    for power in range(max([0, *(abs(w).bit_length() for w in weights)])):
        dims = np.flatnonzero((size >> power) & 1)
        if len(dims):
            for bit in range(bits):
                levels.setdefault(power + bit, []).append(signed[dims, bit])
    total = _added({power: np.concatenate(maps) for power, maps in levels.items()})
    rows = _best(total, allowed, k)
    scores = []
    for row in rows:
        word, bit = int(row) // 64, np.uint64(int(row) % 64)
        scores.append(constant + sum(1 << p for p, m in enumerate(total) if m is not None and (m[word] >> bit) & np.uint64(1)))
    return ids[rows], scores


def top_k(points: DataFrame, queries: DataFrame, k: int = 10, blocks: int | None = None) -> DataFrame:
    """The ``k`` points with the largest integer inner product for every query, ties to the smaller id.

    Both sides hold (vec_id, values) of ``quantised``. A point with the query's own id is no partner
    of it, and vectors meet only vectors of their own length; a repeated row takes part as often as
    it is there. Null ids take no part. Queries meet the index block by block: every pair of a query
    block and an index block gives at most ``k`` rows per query, and the best of these are ranked.
    Scores beyond 64 bits are set to the nearest long.

    Returns query_id, rank, vec_id, score.
    """
    spark = points.sparkSession
    points, queries = points.where("vec_id IS NOT NULL"), queries.where("vec_id IS NOT NULL")
    blocks = blocks or max(1, -(-points.count() // BLOCK))
    index = build_index(points.repartition(blocks))
    lanes = max(1, min(blocks, int(spark.conf.get("spark.sql.shuffle.partitions"))))

    def packs(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
        for ids, values in _blocks(stream, QUERY_BLOCK):
            yield pa.table(
                {
                    "width": pa.array([values.shape[1]], pa.int32()),
                    "asked": pa.array([ids.tobytes()], pa.binary()),
                    "values": pa.array([values.tobytes()], pa.binary()),
                }
            )

    asked = map_arrow(queries, packs, "width int, asked binary, values binary")
    asked = asked.withColumn("query_block", F.monotonically_increasing_id())
    asked = asked.withColumn("lane", F.explode(F.sequence(F.lit(0), F.lit(lanes - 1))))
    index = index.withColumn("lane", F.pmod(F.spark_partition_id(), F.lit(lanes)))
    pairs = index.join(asked, ["lane", "width"]).select(
        "query_block", "width", "bits", "ids", "low", "slices", "asked", "values"
    )

    def work(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
        for batch in stream:
            for row in batch.to_pylist():
                width, bits = row["width"], row["bits"]
                ids, low = np.frombuffer(row["ids"], np.int64), np.frombuffer(row["low"], np.int64)
                slices = np.frombuffer(row["slices"], np.uint64).reshape(width, bits, -1 if width else 0)
                own = np.frombuffer(row["asked"], np.int64)
                values = np.frombuffer(row["values"], np.int64).reshape(len(own), width)
                if not width:
                    slices = np.zeros((0, bits, -(-len(ids) // 64)), np.uint64)
                out = {"query_id": [], "query_no": [], "vec_id": [], "score": []}
                for place, query in enumerate(values):
                    found, scores = search_block(query, int(own[place]), ids, low, slices, k)
                    out["query_id"] += [int(own[place])] * len(found)
                    out["query_no"] += [row["query_block"] * QUERY_BLOCK + place] * len(found)
                    out["vec_id"] += [int(i) for i in found]
                    out["score"] += [max(-(2**63), min(2**63 - 1, s)) for s in scores]
                yield pa.table({name: pa.array(column, pa.int64()) for name, column in out.items()})

    found = map_arrow(pairs, work, "query_id long, query_no long, vec_id long, score long")
    order = Window.partitionBy("query_id", "query_no").orderBy(F.desc("score"), "vec_id")
    ranked = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")
