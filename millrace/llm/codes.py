"""Product codes of vectors: Lloyd rounds on cover trees, in whole numbers.

Each task builds, for every block of vectors and every part of them, a cover tree: a node holds the points within its
radius, its children lie within half of that and further than half from each other, and a child's points stand together
in the tree's order, so that a difference of cumulative sums is a whole subtree's sum. The trees are written once. In a
round a node goes to its centre's nearest entry with all below it where the triangle inequality allows no other; only
ambiguous nodes are opened, and at the leaves points are compared exactly.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import map_arrow
from millrace.llm.vectors import by_width, exact_type, floors, is_finite, summed, wholes
from millrace.operators.ranking import top_per_group
from millrace.session import written

SCALE = 4096
PARTS = 8
ENTRIES = 16
ROUNDS = 6
BLOCK = 4096
LEAF = 8
# Whole numbers beyond this count as this; doubles hold all of them below.
LIMIT = 2.0**53


@dataclass
class Tree:
    """Points in tree order. Node k covers the points ``first[k]`` up to ``last[k]``, the first of which is its centre;
    its children are the nodes ``child[k]`` up to ``child[k] + children[k]``. ``radius`` is that of its points."""

    order: np.ndarray
    first: np.ndarray
    last: np.ndarray
    radius: np.ndarray
    child: np.ndarray
    children: np.ndarray


def _squares(points: np.ndarray, others: np.ndarray) -> np.ndarray:
    """Exact squared distances, broadcast over all but the last axis."""
    apart = points - others
    return (apart * apart).sum(axis=-1)


def cover_tree(points: np.ndarray, leaf: int = LEAF) -> Tree:
    """The cover tree of a block's points; equal points share a node of radius 0."""
    order = np.arange(len(points))
    first, last, radius, child, children = [0], [len(points)], [_reach(points, order)], [], []
    node = 0
    while node < len(first):
        begin, end = first[node], last[node]
        child.append(len(first))
        children.append(0)
        if end - begin > leaf and radius[node] > 0:
            inside = order[begin:end]
            near = radius[node] / 2
            groups = []
            while len(inside):
                apart = np.sqrt(_squares(points[inside], points[inside[0]]).astype(np.float64))
                mine = apart <= near
                groups.append((inside[mine], float(apart[mine].max())))
                inside = inside[~mine]
            at = begin
            for members, reach in groups:
                order[at : at + len(members)] = members
                first.append(at)
                last.append(at + len(members))
                radius.append(reach)
                at += len(members)
            children[node] = len(groups)
        node += 1
    kinds = (np.int32, np.int32, np.float64, np.int32, np.int32)
    return Tree(order.astype(np.int32), *(np.array(c, dtype=k) for c, k in zip((first, last, radius, child, children), kinds, strict=True)))


def _reach(points: np.ndarray, order: np.ndarray) -> float:
    if not len(order):
        return 0.0
    return float(np.sqrt(_squares(points[order], points[order[0]]).astype(np.float64).max()))


def assign(tree: Tree, points: np.ndarray, codebook: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """Runs of points in tree order and their nearest entries, ties to the lower: (first, last, entry, comparisons).

    ``points`` are in tree order, ``points`` and ``codebook`` of a kind that holds squared distances exactly.
    """
    found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    nodes, compared = np.array([0]), 0
    while len(nodes):
        squares = _squares(points[tree.first[nodes]][:, None, :], codebook[None, :, :])
        compared += len(nodes)
        nearest = squares.argmin(axis=1)
        apart = np.sqrt(squares.astype(np.float64))
        every = np.arange(len(nodes))
        best = apart[every, nearest]
        apart[every, nearest] = np.inf
        second, radius = apart.min(axis=1), tree.radius[nodes]
        # A little more than twice the radius, for the rounding of roots.
        sure = (best + 2 * radius * (1 + 1e-9) + 1e-9 * (1 + best) < second * (1 - 1e-12)) | (radius == 0)
        found.append((tree.first[nodes[sure]], tree.last[nodes[sure]], nearest[sure]))
        nodes = nodes[~sure]
        leaves = nodes[tree.children[nodes] == 0]
        lone = _ranges(tree.first[leaves], tree.last[leaves] - tree.first[leaves])
        for begin in range(0, len(lone), BLOCK):
            some = lone[begin : begin + BLOCK]
            found.append((some, some + 1, _squares(points[some][:, None, :], codebook[None, :, :]).argmin(axis=1)))
        compared += len(lone)
        nodes = nodes[tree.children[nodes] > 0]
        nodes = _ranges(tree.child[nodes], tree.children[nodes])
    first, last, entry = (np.concatenate(c) for c in zip(*found, strict=True))
    return first, last, entry, compared


def _ranges(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """All numbers of the ranges, one range after the other."""
    ends = np.cumsum(lengths)
    return np.repeat(starts - (ends - lengths), lengths) + np.arange(int(ends[-1]) if len(ends) else 0)


def bounds(width: int, parts: int = PARTS) -> np.ndarray:
    """Where the parts begin and end: equal, or where that can't be, the first ones longer by one."""
    sizes = np.full(parts, width // parts) + (np.arange(parts) < width % parts)
    return np.concatenate(([0], np.cumsum(sizes)))


def build(df: DataFrame, vector: str, carried: Sequence[str], scale: float = SCALE, parts: int = PARTS) -> DataFrame:
    """One row per block of at most ``BLOCK`` vectors of one length: the carried columns as arrays ``c0``, ``c1`` …,
    largest (absolute component), kind and values (whole components, row by row), and a tree for each part."""
    rows = df.where(is_finite(vector)).select(F.col(vector).alias("v"), *(F.col(c).alias(f"c{i}") for i, c in enumerate(carried)))
    kinds = [f.dataType.simpleString() for f in rows.schema.fields[1:]]
    node_columns = ("order", "first", "last", "radius", "child", "children")

    def block(values: np.ndarray, held: list[pa.Array]) -> pa.Table:
        largest = float(np.abs(values).max()) if values.size else 0.0
        kind = "<i4" if largest < 2**31 else "<i8"
        edges = bounds(values.shape[1], parts)
        working = values.astype(exact_type(2 * largest, values.shape[1]))
        trees = [cover_tree(working[:, a:b]) for a, b in zip(edges[:-1], edges[1:], strict=True)]
        out = {
            "width": pa.array([values.shape[1]], pa.int32()), "largest": pa.array([largest]), "kind": pa.array([kind]),
            "vals": pa.array([values.astype(kind).tobytes()], pa.binary()),
        }
        out |= {f"t_{c}": pa.array([[getattr(t, c).tobytes() for t in trees]], pa.list_(pa.binary())) for c in node_columns}
        ends = pa.array([0, len(values)], pa.int32())
        return pa.table(out | {f"c{i}": pa.ListArray.from_arrays(ends, column) for i, column in enumerate(held)})

    def work(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
        waiting: dict[int, list] = {}
        for batch in stream:
            for places, values in by_width(batch.column(0)):
                whole = floors(values, scale, LIMIT)
                for begin in range(0, len(places), BLOCK):
                    some = pa.array(places[begin : begin + BLOCK])
                    held = waiting.setdefault(values.shape[1], [])
                    held.append((whole[begin : begin + BLOCK], [c.take(some) for c in batch.columns[1:]]))
                    if sum(len(v) for v, _ in held) >= BLOCK:
                        yield from joined(waiting.pop(values.shape[1]))
        for held in waiting.values():
            yield from joined(held)

    def joined(held: list) -> Iterator[pa.Table]:
        values = np.concatenate([v for v, _ in held])
        columns = [pa.concat_arrays([c[i] for _, c in held]) for i in range(len(kinds))]
        for begin in range(0, len(values), BLOCK):
            yield block(values[begin : begin + BLOCK], [c.slice(begin, BLOCK) for c in columns])

    fields = "width int, largest double, kind string, vals binary, " + ", ".join(f"t_{c} array<binary>" for c in node_columns)
    return map_arrow(rows, work, fields + "".join(f", c{i} array<{k}>" for i, k in enumerate(kinds)))


def _opened(row: dict, codebooks: list[np.ndarray]) -> Iterator[tuple[int, Tree, np.ndarray, np.ndarray]]:
    """(part, tree, its points in tree order, its codebook) of a block, in numbers that hold the squares exactly."""
    values = np.frombuffer(row["vals"], row["kind"]).astype(np.int64)
    edges = bounds(row["width"], len(codebooks))
    values = values.reshape(-1, row["width"]) if row["width"] else np.zeros((len(row["c0"]), 0), np.int64)
    largest = max([row["largest"], *(float(np.abs(c).max()) for c in codebooks if c.size)])
    exact = exact_type(2 * largest, row["width"])
    for part, book in enumerate(codebooks):
        names = zip(("order", "first", "last", "radius", "child", "children"), (*["<i4"] * 3, "<f8", *["<i4"] * 2), strict=True)
        tree = Tree(*(np.frombuffer(row[f"t_{c}"][part], k) for c, k in names))
        yield part, tree, values[:, edges[part] : edges[part + 1]][tree.order].astype(exact), book.astype(exact)


def _read(stream: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    for batch in stream:
        for place in range(batch.num_rows):
            yield batch.slice(place, 1).to_pylist()[0]


def first_entries(df: DataFrame, ident: str, vector: str, scale: float = SCALE, parts: int = PARTS, entries: int = ENTRIES) -> dict[int, list[np.ndarray]]:
    """By length of vector, a codebook for each part: the parts of the vectors of smallest id; repeated ids by vector."""
    rows = df.where(is_finite(vector) & F.col(ident).isNotNull()).select(F.col(ident).alias("i"), F.col(vector).alias("v"), F.size(vector).alias("w"))
    books = {}
    chosen: dict[int, list] = {}
    for row in top_per_group(rows, ["w"], [F.col("i"), F.col("v")], entries, "place").orderBy("w", "place").collect():
        chosen.setdefault(row["w"], []).append(row["v"])
    for width, vectors in chosen.items():
        values = floors(np.array(vectors, dtype=np.float64).reshape(len(vectors), width), scale, LIMIT)
        edges = bounds(width, parts)
        books[width] = [values[:, a:b] for a, b in zip(edges[:-1], edges[1:], strict=True)]
    return books


def train(trees: DataFrame, books: dict[int, list[np.ndarray]], rounds: int = ROUNDS) -> dict[int, list[np.ndarray]]:
    """Codebooks after ``rounds`` Lloyd rounds over all trees; each entry becomes the floor of its parts' mean.

    A round is one job: counts and sums per entry and position, a number of rows that the codebooks bound, reach the
    driver. Entries that nothing goes to stay.
    """
    for _ in range(rounds):
        books = _round(trees, books)
    return books


def _round(trees: DataFrame, books: dict[int, list[np.ndarray]]) -> dict[int, list[np.ndarray]]:
    columns = ("width", "part", "entry", "place")

    def work(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
        held: dict[tuple[int, int], np.ndarray] = {}
        for row in _read(stream):
            for part, tree, points, book in _opened(row, books[row["width"]]):
                first, last, entry, _ = assign(tree, points, book)
                sums = np.concatenate((np.zeros_like(points[:1]), np.cumsum(points, axis=0)))
                counted = np.column_stack((last - first, sums[last] - sums[first]))
                total = np.zeros((len(book), counted.shape[1]), counted.dtype)
                np.add.at(total, entry, counted)
                held[row["width"], part] = held.get((row["width"], part), 0) + total.astype(object)
        for (width, part), total in held.items():
            entry, place = np.indices(total.shape).reshape(2, -1)
            keys = (np.full(len(entry), width), np.full(len(entry), part), entry, place)
            out = {c: pa.array(k, pa.int32()) for c, k in zip(columns, keys, strict=True)}
            yield pa.table(out | {"total": wholes(total.ravel())})

    narrow = trees.where(F.col("width").isin(list(books)))
    totals = summed(map_arrow(narrow, work, "width int, part int, entry int, place int, total decimal(38,0)"), list(columns))
    new = {}
    for width, old in books.items():
        new[width] = [book.copy() for book in old]
        for part, book in enumerate(new[width]):
            for entry in range(len(book)):
                count = totals.get((width, part, entry, 0), 0)
                if count:
                    book[entry] = [totals[width, part, entry, d + 1] // count for d in range(book.shape[1])]
    return new


def encode(trees: DataFrame, books: dict[int, list[np.ndarray]]) -> DataFrame:
    """One row per vector: the carried columns ``c0`` …, width, code (two hex digits a part), error (decimal; squared
    distances summed over parts)."""
    carried = [f for f in trees.schema.fields if f.name.startswith("c") and f.name[1:].isdigit()]
    digits = np.array([b"%02x" % i for i in range(256)], dtype="S2")

    def work(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
        for batch in stream:
            for place in range(batch.num_rows):
                held = batch.slice(place, 1)
                row = held.to_pylist()[0]
                n, own = len(row["c0"]), books[row["width"]]
                codes, error = np.zeros((n, len(own)), np.int64), 0
                for part, tree, points, book in _opened(row, own):
                    first, last, entry, _ = assign(tree, points, book)
                    by_place = np.argsort(first)
                    ordered = np.repeat(entry[by_place], (last - first)[by_place])
                    codes[tree.order, part] = ordered
                    mine = np.zeros(n, points.dtype)
                    mine[tree.order] = _squares(points, book[ordered])
                    error = error + mine
                text = digits[codes].tobytes().decode()
                step = 2 * len(own)
                out = {f.name: held.column(f.name).flatten() for f in carried}
                out |= {"width": pa.array(np.full(n, row["width"]), pa.int32())}
                out |= {"code": pa.array([text[i * step : (i + 1) * step] for i in range(n)], pa.string()), "error": wholes(error)}
                yield pa.table(out)

    fields = ", ".join(f"{f.name} {f.dataType.elementType.simpleString()}" for f in carried)
    return map_arrow(trees.where(F.col("width").isin(list(books))), work, f"{fields}, width int, code string, error decimal(38,0)")


def digest(books: list[np.ndarray]) -> str:
    """SHA-256 of all entries' components, decimal, by part, entry and place, joined by commas."""
    return hashlib.sha256(",".join(str(int(x)) for book in books for x in book.ravel()).encode()).hexdigest()


def compress(
    df: DataFrame, ident: str, vector: str, label: str, scale: float = SCALE, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS
) -> tuple[DataFrame, dict[int, list[np.ndarray]]]:
    """(rows, codebooks by length of vector) of the vectors that are there and finite.

    Components count as ``floor(scale * x)``. Rows hold ``ident``, ``label``, code, error (decimal), label_error
    (decimal; the error summed over equal labels, nulls together) and codebooks_sha256. Vectors of another length have
    codebooks of their own; where no row of a length has an id, its rows are left out, as no entry starts. Fewer rows
    than ``entries`` give as many entries as there are. Rows of null or repeated id are rows like others. A length that
    ``parts`` doesn't divide has its first parts longer by one.
    """
    if not 0 < entries <= 256:
        raise ValueError("a code has two hex digits a part: 1 to 256 entries")
    trees = written(build(df, vector, [ident, label], scale, parts), "cover-trees")
    books = train(trees, first_entries(df, ident, vector, scale, parts, entries), rounds)
    coded = written(encode(trees, books), "codes")
    sums = coded.groupBy("c1").agg(F.sum("error").alias("label_error"))
    joined = coded.join(sums.withColumnRenamed("c1", "same"), F.col("c1").eqNullSafe(F.col("same")))
    known = [x for width, own in books.items() for x in (F.lit(width), F.lit(digest(own)))]
    sha = F.element_at(F.create_map(*known), F.col("width")) if known else F.lit(None).cast("string")
    rows = joined.select(F.col("c0").alias(ident), F.col("c1").alias(label), "code", "error", "label_error", sha.alias("codebooks_sha256"))
    return rows, books
