"""Joining documents by the Jaccard similarity of their word shingles, with count-vector bounds.

Shingles are hashed into groups; the counts per group are a document's point. The overlap of two
documents is at most the sum of the smaller counts, so a pair (or a pair of tree nodes, with the largest
counts of their members) below the overlap it needs is out without a look at the shingles.

Points alone cannot part a large corpus: a document of n shingles reaches all points within n/4, and
random documents of one size lie closer than that unless there are about n/25 groups or more, where boxes
of a tree overlap. So documents first meet by their rarest shingles: two sets with a similarity of t
share one of the (1 - t)n + 1 rarest of either. Trees are built inside these meetings.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from millrace.llm.common import map_arrow, texts_of
from millrace.llm.components import components
from millrace.operators.ranking import row_numbers
from millrace.session import written

WORDS = 5
PERCENT = 80
LEAF = 256
HUBS = 4
SKETCH = 1 << 20
FILTER = 1 << 23
_FACTOR = np.uint64(0x9E3779B97F4A7C15)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingles(text: str) -> np.ndarray:
    """Sorted 64-bit hashes of the distinct shingles of ``WORDS`` words; A-Z count as a-z."""
    words = text.encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    hashed = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
    span = min(WORDS, len(words))
    total = np.full(len(words) - span + 1, np.uint64(span))
    for place in range(span):
        total = _mixed(total * _FACTOR + hashed[place : len(words) - span + 1 + place])
    return np.unique(total)


def counts_of(found: np.ndarray) -> bytes:
    """Counts per group, one or two shingles each; a power of two of groups. Bytes, or where a count is above 255
    (texts of millions of shingles) 32-bit numbers after a first byte."""
    groups = 1 << max(3, min(16, len(found).bit_length() - 1))
    counts = np.bincount((found & np.uint64(groups - 1)).astype(np.int64), minlength=groups)
    if counts.max(initial=0) < 256:
        return counts.astype(np.uint8).tobytes()
    return b"\x01" + counts.astype("<u4").tobytes()


def counts_in(data: bytes) -> np.ndarray:
    if len(data) & 1:
        return np.frombuffer(data, "<u4", offset=1).astype(np.int64)
    return np.frombuffer(data, np.uint8).astype(np.int64)


def folded(counts: np.ndarray, groups: int) -> np.ndarray:
    """The same point with fewer groups: groups that agree in their low bits are added."""
    return counts.reshape(-1, groups).sum(axis=0)


def bound(one: np.ndarray, other: np.ndarray) -> int:
    """No pair with these counts shares more shingles than this."""
    groups = min(len(one), len(other))
    return int(np.minimum(folded(one, groups), folded(other, groups)).sum())


def enough(shared, n: int, m: int, percent: int = PERCENT):
    """Whether ``shared`` common shingles of sets of n and m make the similarity."""
    return 100 * shared >= percent * (n + m - shared)


def profiles(docs: DataFrame, ident: str, text: str) -> DataFrame:
    """Rows of two kinds, from one pass: for each document its number of shingles, the key of its set (two
    64-bit hashes) and its counts; and parts of a sketch that counts in how many documents shingles occur.

    Copies inside a task are sketched once. The sketch has ``SKETCH`` counters whatever the corpus.
    """
    rows = docs.select(F.col(ident).alias("ident"), F.col(text).alias("_text"))
    kind = rows.schema["ident"].dataType.simpleString()
    batch_type = to_arrow_type(rows.schema["ident"].dataType)

    def work(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
        sketch, seen, part = np.zeros(SKETCH, np.uint32), set(), SKETCH // 64
        for batch in stream:
            size, first, second, points = [], [], [], []
            for value in texts_of(batch.column(1)):
                found = shingles(value)
                raw = found.tobytes()
                key = xxhash.xxh3_64_intdigest(raw)
                size.append(len(found))
                first.append(key - (1 << 63))
                second.append(xxhash.xxh64_intdigest(raw) - (1 << 63))
                fresh = key not in seen and len(found) > 0
                points.append(counts_of(found) if fresh else None)
                if fresh:
                    seen.add(key)
                    np.add.at(sketch, (found >> np.uint64(44)).astype(np.int64), 1)
            count = len(size)
            yield pa.table(
                {
                    "ident": batch.column(0), "n": pa.array(size, pa.int64()), "node": pa.array(first, pa.int64()),
                    "check": pa.array(second, pa.int64()), "counts": pa.array(points, pa.binary()),
                    "part": pa.nulls(count, pa.int32()), "sketch": pa.nulls(count, pa.binary()),
                }
            )
        filled = [i for i in range(64) if sketch[i * part : (i + 1) * part].any()]
        count = len(filled)
        yield pa.table(
            {
                "ident": pa.nulls(count, batch_type), "n": pa.nulls(count, pa.int64()), "node": pa.nulls(count, pa.int64()),
                "check": pa.nulls(count, pa.int64()), "counts": pa.nulls(count, pa.binary()), "part": pa.array(filled, pa.int32()),
                "sketch": pa.array([sketch[i * part : (i + 1) * part].tobytes() for i in filled], pa.binary()),
            }
        )

    return map_arrow(rows, work, f"ident {kind}, n long, node long, check long, counts binary, part int, sketch binary")


def _sketch_sum(found: DataFrame) -> np.ndarray:
    """The sketch of the whole corpus; ``SKETCH`` numbers."""

    def add(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
        total = sum(np.frombuffer(s, np.uint32).astype(np.int64) for s in group["sketch"])
        return pd.DataFrame({"part": [key[0]], "total": [total.tobytes()]})

    parts = found.where("part IS NOT NULL").select("part", "sketch").groupBy("part").applyInPandas(add, "part int, total binary")
    out = np.zeros(SKETCH, np.int64)
    for row in parts.collect():
        out[row["part"] * SKETCH // 64 : (row["part"] + 1) * SKETCH // 64] = np.frombuffer(row["total"], np.int64)
    return out


def meetings(docs: DataFrame, text: str, sketch: np.ndarray, percent: int = PERCENT) -> DataFrame:
    """(shingle, node, n, place): each distinct set under the rarest of its shingles, so many that similar sets share one.

    Rarity is the sketch's count, then the hash: one order for all documents, which is all that is needed for
    no pair to be lost. ``place`` is how many rarer shingles the set has. Copies inside a task give one.
    """
    shared = docs.sparkSession.sparkContext.broadcast(sketch)

    def work(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
        seen: set[int] = set()
        for batch in stream:
            keys, nodes, sizes, places = [], [], [], []
            for value in texts_of(batch.column(0)):
                found = shingles(value)
                key = xxhash.xxh3_64_intdigest(found.tobytes())
                if not len(found) or key in seen:
                    continue
                seen.add(key)
                least = -(-percent * len(found) // 100)
                order = np.lexsort((found, shared.value[(found >> np.uint64(44)).astype(np.int64)]))
                chosen = found[order[: len(found) - least + 1]]
                keys.append(chosen.view(np.int64))
                nodes.append(np.full(len(chosen), key - (1 << 63), np.int64))
                sizes.append(np.full(len(chosen), len(found), np.int32))
                places.append(np.arange(len(chosen), dtype=np.int32))
            if keys:
                columns = map(np.concatenate, (keys, nodes, sizes, places))
                yield pa.table(list(map(pa.array, columns)), names=["shingle", "node", "n", "place"])

    return map_arrow(docs.select(text), work, "shingle long, node long, n int, place int")


def _survivors(pairs: DataFrame, percent: int) -> DataFrame:
    """(a, b) of pairs with sizes and counts of both whose bound allows the similarity."""

    def work(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
        for batch in stream:
            columns = [c.to_pylist() for c in batch.columns]
            keep = []
            for place, (n, m, one, other) in enumerate(zip(*columns[2:], strict=True)):
                if 100 * min(n, m) >= percent * max(n, m):
                    if enough(bound(counts_in(one), counts_in(other)), n, m, percent):
                        keep.append(place)
            kept = pa.Table.from_batches([batch]).take(pa.array(keep, pa.int64()))
            yield kept.select(["a", "b"])

    return map_arrow(pairs.select("a", "b", "na", "nb", "ca", "cb"), work, "a long, b long")


def _verified(pairs: DataFrame, docs: DataFrame, nodes: DataFrame, ident: str, text: str, percent: int) -> DataFrame:
    """(a, b) of those pairs whose sets are as similar as asked, by the sets themselves.

    Only documents that stand for a node of a pair are cut into shingles again: a filter of ``FILTER`` bits
    over their ids goes to the tasks, whatever the number of pairs; what passes it by chance finds no pair.
    """
    spark = docs.sparkSession
    ends = pairs.select(F.col("a").alias("node")).union(pairs.select(F.col("b").alias("node"))).distinct()
    wanted = written(nodes.join(ends.hint("merge"), "node").select("node", "ident"), "wanted")
    held = wanted.select(place_of("ident").alias("place")).groupBy(F.floor(F.col("place") / 64).cast("long").alias("word"))
    held = held.agg(F.expr("bit_or(shiftleft(1L, cast(place % 64 as int)))").alias("bits"))
    words = np.zeros(FILTER // 64, np.int64)
    for row in held.collect():
        words[row["word"]] = row["bits"]
    shared = spark.sparkContext.broadcast(words)

    rows = docs.select(F.col(ident).alias("ident"), place_of(ident).alias("place"), F.col(text).alias("_text"))

    def cut(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
        for batch in stream:
            at = batch.column(1).to_numpy()
            chosen = np.flatnonzero((shared.value[at // 64] >> (at % 64)) & 1)
            part = pa.Table.from_batches([batch]).take(pa.array(chosen))
            sets, keys = [], []
            for value in part.column(2).to_pylist():
                raw = shingles(value or "").tobytes()
                sets.append(raw)
                keys.append(xxhash.xxh3_64_intdigest(raw) - (1 << 63))
            yield pa.table({"node": pa.array(keys, pa.int64()), "found": pa.array(sets, pa.binary())})

    # A row for each wanted document, and a few that pass by chance and find no pair; copies only repeat a link.
    sets = written(map_arrow(rows, cut, "node long, found binary"), "sets")
    joined = pairs.hint("merge").join(sets.select(F.col("node").alias("a"), F.col("found").alias("fa")), "a")
    joined = joined.hint("merge").join(sets.select(F.col("node").alias("b"), F.col("found").alias("fb")), "b")

    def compare(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
        for batch in stream:
            keep = []
            for row in range(batch.num_rows):
                one = np.frombuffer(batch.column(2)[row].as_buffer(), np.uint64)
                other = np.frombuffer(batch.column(3)[row].as_buffer(), np.uint64)
                shared_ = len(np.intersect1d(one, other, assume_unique=True))
                if enough(shared_, len(one), len(other), percent):
                    keep.append(row)
            yield pa.Table.from_batches([batch]).select(["a", "b"]).take(pa.array(keep, pa.int64()))

    return written(map_arrow(joined.select("a", "b", "fa", "fb"), compare, "a long, b long"), "links")


def place_of(ident: str):
    return F.pmod(F.xxhash64(ident), F.lit(FILTER))


def _leaf_pairs(members: DataFrame, nodes: DataFrame, percent: int) -> DataFrame:
    """(a, b) of members of one meeting but different components whose bound allows the similarity.

    A pair counts where it meets first, by its rarest common shingle: the two then share at most what either has from
    there on, so late places are out as well.

    A meeting is ordered by size and packed into leaves of ``LEAF`` members, the last level of a tree over its
    points. Leaves whose sizes are too far apart never meet; of the others the boxes are compared first,
    then the members. Members are ranked without their counts, which are large; a meeting of one leaf isn't moved again.
    """
    ranked = row_numbers(members, ["meeting"], ["n", "node"], "_rank")
    ranked = ranked.select("*", F.floor((F.col("_rank") - 1) / LEAF).alias("leaf")).drop("_rank")
    ends = ranked.groupBy("meeting").agg(F.max("leaf").alias("last"))
    held = ranked.join(ends, "meeting").hint("merge").join(nodes.select("node", "counts"), "node")
    leaves = held.groupBy("meeting", "leaf").agg(
        F.first("last").alias("last"), F.min("n").alias("low"), F.max("n").alias("high"),
        F.collect_list(F.struct("node", "component", "n", "place", "counts")).alias("members"),
    )
    leaves = written(leaves, "leaves")
    single = leaves.where("last = 0").select(F.col("members").alias("l_members"), F.lit(None).cast(leaves.schema["members"].dataType).alias("r_members"))
    several = leaves.where("last > 0")
    left = several.select("meeting", *(F.col(c).alias(f"l_{c}") for c in ("leaf", "low", "high", "members")))
    right = several.select("meeting", *(F.col(c).alias(f"r_{c}") for c in ("leaf", "low", "high", "members")))
    close = (F.col("l_leaf") <= F.col("r_leaf")) & (F.col("r_low") * percent <= F.col("l_high") * 100)
    pairs = single.unionByName(left.join(right, "meeting").where(close).select("l_members", "r_members"))

    def points(side: list[dict]) -> tuple:
        n = np.array([m["n"] for m in side], np.int64)
        rest = n - np.array([m["place"] for m in side])
        counts = [counts_in(m["counts"]) for m in side]
        groups = min(64, min(map(len, counts)))
        return n, rest, np.array([m["component"] for m in side]), [m["node"] for m in side], counts, np.stack([folded(c, groups) for c in counts])

    def work(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
        for batch in stream:
            for row in batch.to_pylist():
                n, rest, part, node, counts, point = points(row["l_members"])
                m, left_, other, mate, more, spot = points(row["r_members"] or row["l_members"])
                groups = min(point.shape[1], spot.shape[1])
                point, spot = point.reshape(len(n), -1, groups).sum(axis=1), spot.reshape(len(m), -1, groups).sum(axis=1)
                box = int(np.minimum(point.max(axis=0), spot.max(axis=0)).sum())
                a, b = [], []
                if enough(box, int(n.min()), int(m.min()), percent):
                    for i in range(len(n)):
                        mates = np.flatnonzero(enough(np.minimum(rest[i], left_), int(n[i]), m, percent) & (other != part[i]))
                        most = np.minimum(point[i], spot[mates]).sum(axis=1)
                        for j in mates[enough(most, int(n[i]), m[mates], percent)].tolist():
                            if enough(bound(counts[i], more[j]), int(n[i]), int(m[j]), percent):
                                a.append(min(node[i], mate[j]))
                                b.append(max(node[i], mate[j]))
                yield pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    return map_arrow(pairs, work, "a long, b long").distinct()


def _labels(nodes: DataFrame, links: DataFrame) -> DataFrame:
    """(node, component) of every node."""
    found = components(links)
    return nodes.select("node").join(found, "node", "left").select("node", F.coalesce("component", "node").alias("component"))


def similar_classes(docs: DataFrame, ident: str = "doc_id", text: str = "text", percent: int = PERCENT) -> DataFrame:
    """One row per document: ``ident``, n_shingles, component_id.

    Two documents link when their shingle sets' similarity is ``percent`` hundredths or more; the component id is
    the smallest ``ident`` that links reach, the own one included. Documents with equal sets are one node.
    Null and empty texts, and texts without words, have no shingles and link with nothing. Repeated rows link
    like copies; a null id is never the smallest unless there is no other.

    Nodes of one meeting first test ``HUBS`` of them, so a group of copies costs as many tests as it has nodes, times
    ``HUBS``; only nodes that are still in different components are then compared through the tree.
    """
    found = written(profiles(docs, ident, text), "profiles")
    rows = found.where("part IS NULL")
    nodes = rows.where("n > 0").groupBy("node").agg(
        F.min("ident").alias("ident"), F.first("n").alias("n"), F.max("counts").alias("counts")
    )
    nodes = written(nodes, "nodes")
    met = meetings(docs, text, _sketch_sum(found), percent)
    whole = Window.partitionBy("shingle")
    first = F.row_number().over(whole.orderBy("node")) == 1
    same = F.lag("node").over(whole.orderBy("node"))
    met = met.withColumn("_fresh", first | (same != F.col("node")))
    met = met.withColumn("_least", F.min("node").over(whole)).withColumn("_most", F.max("node").over(whole))
    print_ = F.sum(F.when(F.col("_fresh"), F.shiftright(F.xxhash64("node"), 16))).over(whole)
    met = met.withColumn("meeting", F.xxhash64(print_, "_least", "_most"))
    met = written(met.where("_fresh AND _least <> _most").groupBy("meeting", "node").agg(F.first("n").alias("n"), F.min("place").alias("place")), "met")

    every = Window.partitionBy("meeting")
    entry = F.struct("node", "n", "place")
    hubs = [F.min_by(entry, F.struct(F.xxhash64("node", F.lit(turn)), "node")).over(every) for turn in range(HUBS)]
    pairs = met.withColumn("hubs", F.array(*hubs)).withColumn("hub", F.explode(F.array_distinct("hubs")))
    shared = F.least(F.col("n") - F.col("place"), F.col("hub.n") - F.col("hub.place"))
    pairs = pairs.where((F.col("node") != F.col("hub.node")) & enough(shared, F.col("n"), F.col("hub.n"), percent))
    pairs = pairs.select(F.least("node", "hub.node").alias("a"), F.greatest("node", "hub.node").alias("b")).distinct()
    left = nodes.select(F.col("node").alias("a"), F.col("n").alias("na"), F.col("counts").alias("ca"))
    right = nodes.select(F.col("node").alias("b"), F.col("n").alias("nb"), F.col("counts").alias("cb"))
    # Joined by sorting at every size: pairs and nodes both grow with the documents.
    near = written(_survivors(pairs.hint("merge").join(left, "a").hint("merge").join(right, "b"), percent), "near")
    links = _verified(near, docs, nodes, ident, text, percent)
    labels = _labels(nodes, links)

    placed = met.join(labels, "node")
    split = placed.withColumn("_low", F.min("component").over(every)).withColumn("_high", F.max("component").over(every))
    split = split.where("_low <> _high").select("meeting", "node", "component", "n", "place")
    rest = _leaf_pairs(split, nodes, percent).join(near, ["a", "b"], "left_anti")
    rest = written(rest, "pairs")
    if not rest.isEmpty():
        labels = _labels(nodes, links.unionByName(_verified(rest, docs, nodes, ident, text, percent)))
    least = labels.join(nodes.select("node", "ident"), "node")
    smallest = least.groupBy("component").agg(F.min("ident").alias("component_id"))
    ids = least.join(smallest, "component").select("node", "component_id")
    out = rows.select("ident", "n", "node").join(ids, "node", "left")
    return out.select(
        F.col("ident").alias(ident),
        F.col("n").alias("n_shingles"),
        F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("ident")).alias("component_id"),
    )
