"""Removing long strings that an earlier document holds already, by ranks of prefixes at growing offsets.

A string of ``LENGTH`` bytes repeats only if every part of it does. Ranks are 64-bit fingerprints of parts, equal for
equal parts, so no global numbering is needed between rounds; Spark deals and sorts them by rank, and positions leave
as soon as their rank is unique:

1. Half strings. Of all halves inside one string the least rank stands for it, so one position in thirteen is
   ranked, and equal strings have the same. Halves that occur once leave with the strings they stand for.
2. Seven eighths. Strings that start far before their half share more bytes before it, the others more after it: of
   four kinds of them the part that all strings of a kind share is ranked, and those whose part occurs once leave.
3. Stretches. Strings of the first two or the last two kinds in a row are ranked by all their bytes. What an earlier
   document has in whole is a repeat. If all stretches that share the same part are equal, no more is to be found.
4. Strings. Of the other stretches the first document of each has its strings ranked one by one: the edges of repeats.

Between rounds the tasks get a bitmap of the ranks that stay, of one bit for eight bytes of text within
``FILTER_BITS``; a rank that passes it by chance is only ranked once more. Rows that Spark shuffles hold many sorted
ranks of one range, packed.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
import zstandard
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import map_arrow
from millrace.session import written

LENGTH = 50
FILTER_BITS = 27, 30
LAST = np.iinfo(np.int64).max
BUCKET_BYTES = 16 << 20
CHUNK = 256
MASK = 0x7FFFFFFF
FLUSH = 1_000_000
SHORT = np.uint64(16)
HIGH = np.uint64(0xFFFFFFFF00000000)
FINE, COARSE = 4, 2
_ODD = 0x9E3779B97F4A7C15


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Stretches(NamedTuple):
    """Neighbouring strings of one half: its place, the first string's start and their count."""

    place: np.ndarray
    start: np.ndarray
    count: np.ndarray

    def only(self, keep: np.ndarray) -> Stretches:
        return Stretches(*(column[keep] for column in self))


class Ranks:
    """Ranks of substrings of one text after another, from prefix sums of a polynomial modulo 2 ** 64."""

    def __init__(self, length: int) -> None:
        self.length, self.half = length, length // 2
        self.up = np.ones(1, np.uint64)
        self.down = np.ones(1, np.uint64)
        self.letter = _mixed(np.arange(1, 257, dtype=np.uint64) * np.uint64(_ODD))

    def read(self, raw: bytes) -> bool:
        """False where the text is shorter than a string."""
        if len(raw) < self.length:
            return False
        while len(self.up) <= len(raw):
            n = len(self.up)
            self.up = np.concatenate((self.up, self.up * np.uint64(pow(_ODD, n, 1 << 64))))
            self.down = np.concatenate((self.down, self.down * np.uint64(pow(_ODD, -n, 1 << 64))))
        values = self.letter[np.frombuffer(raw, np.uint8)] * self.up[: len(raw)]
        self.sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(values, dtype=np.uint64)))
        return True

    def of(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        size = (ends - starts).astype(np.uint64)
        return _mixed((self.sums[ends] - self.sums[starts]) * self.down[starts] + size * np.uint64(0xD6E8FEB86659FD93))

    def stretches(self) -> Stretches:
        """Strings of one half in a row: the first half of least rank, which follows from the bytes of the string."""
        half = self.half
        ranks = _mixed((self.sums[half:] - self.sums[:-half]) * self.down[: len(self.sums) - half])
        window, size = self.length - half + 1, 1
        # The place stands in the lower bits.
        least = (ranks & HIGH) | np.arange(len(ranks), dtype=np.uint64)
        while size * 2 <= window:
            least = np.minimum(least[:-size], least[size:])
            size *= 2
        if size < window:
            least = np.minimum(least[: len(least) - (window - size)], least[window - size :])
        starts = np.flatnonzero(_heads(least))
        return Stretches((least[starts] & ~HIGH).astype(np.int64), starts, np.diff(np.append(starts, len(least))))

    def halves(self, found: Stretches) -> np.ndarray:
        return self.of(found.place, found.place + self.half)

    def parted(self, found: Stretches, kinds: int) -> tuple[np.ndarray, np.ndarray, Stretches]:
        """Stretches by how far before the half their strings start, of ``kinds`` kinds: (the row in ``found`` times
        ``kinds`` plus the kind, the rank of what all strings of the kind share, the stretch)."""
        edges = np.arange(kinds + 1) * (self.length - self.half + 1) // kinds
        first, last = found.place[:, None] - edges[1:] + 1, found.place[:, None] - edges[:-1]
        start = np.maximum(first, found.start[:, None])
        count = np.minimum(last, (found.start + found.count)[:, None] - 1) - start + 1
        at = np.flatnonzero(count > 0)
        place, first, last, start, count = np.repeat(found.place, kinds)[at], *(x.ravel()[at] for x in (first, last, start, count))
        return at, self.of(last, first + self.length), Stretches(place, start, count)


def _packed(column: np.ndarray) -> bytes:
    """Bytes of equal weight side by side, compressed; small after sorting or where values are small."""
    width = column.dtype.itemsize
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(column.view(np.uint8).reshape(-1, width).T).tobytes())


def _unpacked(data: bytes, kind: str) -> np.ndarray:
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(data, max_output_size=1 << 31), np.uint8)
    width = np.dtype(kind).itemsize
    return np.ascontiguousarray(raw.reshape(width, -1).T).view(kind).ravel()


def _sorted_packed(column: np.ndarray) -> bytes:
    return _packed(np.diff(column, prepend=np.uint64(0)))


def _sorted_unpacked(data: bytes) -> np.ndarray:
    return np.cumsum(_unpacked(data, "<u8"), dtype=np.uint64)


def _ranges(ranks: np.ndarray, bits: int) -> Iterator[tuple[int, slice]]:
    """Slices of sorted ranks by their first ``bits`` bits."""
    number = (ranks >> np.uint64(64 - bits)).astype(np.int64)
    edges = np.flatnonzero(np.diff(number, prepend=-1))
    for start, end in zip(edges, [*edges[1:], len(ranks)], strict=True):
        yield int(number[start]), slice(start, end)


def _heads(*columns: np.ndarray) -> np.ndarray:
    """Where a new value of the sorted columns starts."""
    new = np.zeros(len(columns[0]), bool)
    new[:1] = True
    for column in columns:
        new[1:] |= column[1:] != column[:-1]
    return new


def _least(ranks: np.ndarray, other: np.ndarray | None, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order by (rank, other, document), and in it the least document of each (rank, other), repeated."""
    keys = (ranks,) if other is None else (ranks, other)
    order = np.lexsort((doc, *keys[::-1]))
    heads = np.flatnonzero(_heads(*(k[order] for k in keys)))
    return order, np.repeat(doc[order][heads], np.diff(np.append(heads, len(order))))


def _tag(raw: bytes) -> int:
    """As Spark's ``xxhash64``, cut to ``MASK``."""
    return xxhash.xxh64_intdigest(raw, seed=42) & MASK


class _Texts:
    """Texts of a task's batches with their ids; copies only while they have the least id so far."""

    def __init__(self, tags: bool) -> None:
        self.seen: dict[int, int] = {}
        self.tags = tags

    def of(self, batch: pa.RecordBatch) -> Iterator[tuple[int, int, bytes]]:
        for start in range(0, batch.num_rows, CHUNK):
            part = batch.slice(start, CHUNK)
            for ident, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                if not text:
                    continue
                raw = text.encode("utf-8", "surrogatepass")
                key = xxhash.xxh3_64_intdigest(raw)
                doc = LAST if ident is None else ident
                if self.seen.get(key, doc + 1) > doc:
                    self.seen[key] = doc
                    yield doc, _tag(raw) if self.tags else 0, raw


class _Bitmap:
    """Which ranks stay, by their first ``size`` bits; ``rows`` hold the parts of the ranges of ``bits`` bits."""

    def __init__(self, rows: list, bits: int, size: int) -> None:
        self.size = size
        self.data = np.zeros((1 << size) // 8, np.uint8)
        part = len(self.data) >> bits
        for row in rows:
            self.data[row["bucket"] * part : (row["bucket"] + 1) * part] = np.frombuffer(zstandard.decompress(row["bits"]), np.uint8)

    def stays(self, ranks: np.ndarray) -> np.ndarray:
        at = (ranks >> np.uint64(64 - self.size)).astype(np.int64)
        return (self.data[at >> 3] >> (at & 7).astype(np.uint8)) & 1 == 1


def _filter_bits(total: int) -> int:
    """One bit for eight bytes of text, within ``FILTER_BITS``."""
    return max(FILTER_BITS[0], min(FILTER_BITS[1], int(np.ceil(np.log2(max(1, total / 8))))))


def _bits_of(ranks: np.ndarray, bits: int, size: int) -> bytes:
    """The part of the bitmap that ranks of one range fill."""
    part = np.zeros((1 << size) >> bits, bool)
    part[(ranks >> np.uint64(64 - size)).astype(np.int64) & (len(part) - 1)] = True
    return zstandard.compress(np.packbits(part, bitorder="little").tobytes())


def _repeated(docs: DataFrame, of: Callable[[Ranks], np.ndarray], bits: int, size: int, length: int) -> DataFrame:
    """(bucket, bits): the bitmap of ranks that ``of`` gives for two texts or more."""

    def gather(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
        ranks, texts, held, many = Ranks(length), _Texts(False), [], 0

        def flushed() -> pa.Table:
            found = np.sort(np.concatenate(held))
            # Each rank at most twice: more often says no more. The bitmap needs no more than its first bits.
            found = found[_heads(found) | np.concatenate(([False], _heads(found)[:-1]))]
            parts = [(b, _sorted_packed(found[s] >> SHORT)) for b, s in _ranges(found, bits)]
            return pa.table({"bucket": pa.array([b for b, _ in parts], pa.int32()), "ranks": pa.array([r for _, r in parts], pa.binary())})

        for batch in stream:
            for _, _, raw in texts.of(batch):
                if ranks.read(raw):
                    held.append(np.unique(of(ranks)))
                    many += len(held[-1])
            if many > FLUSH:
                yield flushed()
                held, many = [], 0
        if many:
            yield flushed()

    def meet(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
        found = np.sort(np.concatenate([_sorted_unpacked(r) for r in group["ranks"]]))
        return pd.DataFrame({"bucket": [key[0]], "bits": [_bits_of(found[~_heads(found)] << SHORT, bits, size)]})

    packed = map_arrow(docs, gather, "bucket int, ranks binary")
    return packed.groupBy("bucket").applyInPandas(meet, "bucket int, bits binary")


# Kind 0: places to compare, in the range of their rank; 2: places known to repeat, in the range of their document.
PLACES = "kind int, bucket int, ranks binary, other binary, doc binary, tag binary, start binary, count binary"
# Kind 1: the bitmap of stretches whose strings are to be ranked; 2: places that repeat.
MET = "kind int, bucket int, bits binary, doc binary, tag binary, start binary, count binary"
SPAN = (("doc", "<i8"), ("tag", "<i4"), ("start", "<i4"), ("count", "<i4"))


def _place_table(kind: int, parts: list[tuple]) -> pa.Table:
    """Packed rows of (bucket, ranks, other, doc, tag, start, count), None where a kind has no such column."""
    columns: list[list] = [[] for _ in range(8)]
    for bucket, ranks, *rest in parts:
        columns[0].append(kind)
        columns[1].append(bucket)
        columns[2].append(None if ranks is None else _sorted_packed(ranks))
        for column, values in zip(columns[3:], rest, strict=True):
            column.append(None if values is None else _packed(values))
    kinds = [pa.int32(), pa.int32(), *[pa.binary()] * 6]
    return pa.table([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=[f.split()[0] for f in PLACES.split(", ")])


def _joined(spans: tuple[np.ndarray, ...]) -> tuple[np.ndarray, ...]:
    """(doc, tag, start, count) of places, sorted, neighbours joined."""
    doc, tag, start, count = spans
    order = np.lexsort((start, tag, doc))
    doc, tag, start, count = (c[order] for c in spans)
    heads = _heads(doc, tag)
    heads[1:] |= start[1:] != start[:-1] + count[:-1]
    at = np.flatnonzero(heads)
    return doc[at], tag[at], start[at], np.add.reduceat(count, at).astype(np.int32)


def _by_document(spans: tuple[np.ndarray, ...], bits: int) -> list[tuple]:
    """(bucket, doc, tag, start, count) of places in ranges of a hash of the document, neighbours joined."""
    if not len(spans[0]):
        return []
    doc, tag, start, count = _joined(spans)
    range_ = (_mixed(doc.view(np.uint64)) >> np.uint64(64 - bits)).astype(np.int64)
    order = np.argsort(range_, kind="stable")
    edges = np.flatnonzero(_heads(range_[order]))
    parts = []
    for first, last in zip(edges, [*edges[1:], len(order)], strict=True):
        rows = order[first:last]
        parts.append((int(range_[rows[0]]), doc[rows], tag[rows], start[rows], count[rows]))
    return parts


def _known(spans: tuple[np.ndarray, ...], bits: int) -> pa.Table:
    return _place_table(2, [(bucket, None, None, *columns) for bucket, *columns in _by_document(spans, bits)])


def _spans_of(group: pd.DataFrame) -> tuple[np.ndarray, ...]:
    return tuple(np.concatenate([_unpacked(r, kind) for r in group[name]]) for name, kind in SPAN)


def _stretch_rank(part: np.ndarray, other: np.ndarray, doc: np.ndarray, bits: int) -> np.ndarray:
    """A rank of a stretch of a document in the range of what its strings share."""
    low = _mixed(other ^ _mixed(doc.view(np.uint64))) >> np.uint64(bits)
    return (part >> np.uint64(64 - bits) << np.uint64(64 - bits)) | low


def _met(places: DataFrame, bits: int, size: int) -> DataFrame:
    """``MET``: of places to compare those whose rank an earlier document has, and the known ones, by document (kind 2);
    the bitmap of the first stretches of each kind where several kinds share a part (kind 1)."""

    def meet(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
        kind, bucket = key
        spans, rows = _spans_of(group), []
        if kind == 0:
            rank = np.concatenate([_sorted_unpacked(r) for r in group["ranks"]])
            stretches = group["other"].iloc[0] is not None
            other = np.concatenate([_unpacked(r, "<u8") for r in group["other"]]) if stretches else None
            order, least = _least(rank, other, spans[0])
            spans = tuple(c[order] for c in spans)
            late = spans[0] > least
            if stretches:
                rank, other = rank[order], other[order]
                heads = np.flatnonzero(_heads(rank))
                several = other[heads] != other[np.append(heads[1:], len(rank)) - 1]
                split = np.repeat(several, np.diff(np.append(heads, len(rank)))) & ~late
                found = _stretch_rank(rank[split] << SHORT, other[split], spans[0][split], bits)
                rows.append((1, bucket, _bits_of(found, bits, size), *[None] * len(SPAN)))
            spans = tuple(c[late] for c in spans)
        rows += [(2, b, None, *map(_packed, columns)) for b, *columns in _by_document(spans, bits)]
        return pd.DataFrame(rows, columns=["kind", "bucket", "bits", *(n for n, _ in SPAN)])

    return places.groupBy("kind", "bucket").applyInPandas(meet, MET)


def _gathered(work: Callable[[Ranks, int, int, list], int], length: int, tags: bool, flush: Callable[[list], Iterator[pa.Table]]):
    """A pass over texts that hands arrays to ``flush`` whenever many are held."""

    def run(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
        ranks, texts, held, size = Ranks(length), _Texts(tags), [], 0
        for batch in stream:
            for doc, tag, raw in texts.of(batch):
                if ranks.read(raw):
                    size += work(ranks, doc, tag, held)
                if size > FLUSH // 2:
                    yield from flush(held)
                    held, size = [], 0
        if held:
            yield from flush(held)

    return run


def _columns(held: list) -> list[np.ndarray]:
    return [np.concatenate([row[i] for row in held]) for i in range(len(held[0]))]


def _compared(rank: np.ndarray, other: np.ndarray | None, spans: tuple[np.ndarray, ...], bits: int) -> Iterator[pa.Table]:
    """Places of the least document of each rank, to compare with other tasks; the others are known to repeat."""
    order, least = _least(rank, other, spans[0])
    rank, spans = rank[order], tuple(c[order] for c in spans)
    late = spans[0] > least
    if late.any():
        yield _known(tuple(c[late] for c in spans), bits)
    rank, spans = rank[~late], tuple(c[~late] for c in spans)
    if other is None:
        yield _place_table(0, [(b, rank[s], None, *(c[s] for c in spans)) for b, s in _ranges(rank, bits)])
    else:
        other = other[order][~late]
        yield _place_table(0, [(b, rank[s] >> SHORT, other[s], *(c[s] for c in spans)) for b, s in _ranges(rank, bits)])


class _Stretching:
    """The stretches of a text that the parts ranked so far leave, with the rank of what their strings share."""

    def __init__(self, halves: Broadcast, fine: Broadcast | None = None) -> None:
        self.halves, self.fine = halves, fine

    def of(self, ranks: Ranks) -> tuple[np.ndarray, Stretches]:
        found = ranks.stretches()
        found = found.only(self.halves.value.stays(ranks.halves(found)))
        at, part, stretches = ranks.parted(found, FINE)
        if self.fine is None:
            return part, stretches
        keep = np.zeros(len(found.start) * COARSE, bool)
        keep[at[self.fine.value.stays(part)] * COARSE // FINE] = True
        at, part, stretches = ranks.parted(found, COARSE)
        return part[keep[at]], stretches.only(keep[at])

    def whole(self, ranks: Ranks) -> tuple[np.ndarray, np.ndarray, Stretches]:
        """And with short ranks of all their bytes, which tell apart stretches of one part."""
        part, found = self.of(ranks)
        return part, ranks.of(found.start, found.start + found.count - 1 + ranks.length) >> SHORT, found


def _stretch_places(docs: DataFrame, stretching: _Stretching, bits: int, length: int, tags: bool) -> DataFrame:
    """``PLACES`` of stretches, ranked by what their strings share and by their bytes, those known to repeat in the
    same task."""

    def work(ranks: Ranks, doc: int, tag: int, held: list) -> int:
        part, whole, found = stretching.whole(ranks)
        n = len(part)
        if n:
            held.append((part, whole, np.full(n, doc, np.int64), np.full(n, tag, np.int32), found.start.astype(np.int32), found.count.astype(np.int32)))
        return n

    def flush(held: list) -> Iterator[pa.Table]:
        part, whole, *spans = _columns(held)
        yield from _compared(part >> SHORT << SHORT, whole, tuple(spans), bits)

    return map_arrow(docs, _gathered(work, length, tags, flush), PLACES)


def _string_places(docs: DataFrame, stretching: _Stretching, split: Broadcast, bits: int, length: int, tags: bool) -> DataFrame:
    """``PLACES`` of the single strings of the stretches in ``split``."""

    def work(ranks: Ranks, doc: int, tag: int, held: list) -> int:
        part, whole, found = stretching.whole(ranks)
        keep = split.value.stays(_stretch_rank(part, whole, np.full(len(part), doc, np.int64), bits))
        start, count = found.start[keep], found.count[keep]
        n = int(count.sum())
        if n:
            first = np.cumsum(count) - count
            at = np.repeat(start - first, count) + np.arange(n)
            held.append((ranks.of(at, at + length), np.full(n, doc, np.int64), np.full(n, tag, np.int32), at.astype(np.int32)))
        return n

    def flush(held: list) -> Iterator[pa.Table]:
        rank, doc, tag, at = _columns(held)
        yield from _compared(rank, None, (doc, tag, at, np.ones(len(at), np.int32)), bits)

    return map_arrow(docs, _gathered(work, length, tags, flush), PLACES)


def _spans(met: DataFrame) -> DataFrame:
    """(doc, tag, starts, counts): the places of each document, packed."""

    def gather(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
        doc, tag, start, count = _joined(_spans_of(group))
        edges = np.append(np.flatnonzero(_heads(doc, tag)), len(doc))
        rows = [(int(doc[a]), int(tag[a]), start[a:b].tobytes(), count[a:b].tobytes()) for a, b in zip(edges[:-1], edges[1:], strict=True)]
        return pd.DataFrame(rows, columns=["doc", "tag", "starts", "counts"])

    rows = met.select("bucket", *(n for n, _ in SPAN))
    return rows.groupBy("bucket").applyInPandas(gather, "doc long, tag int, starts binary, counts binary")


def remove_repeats(docs: DataFrame, ident: str = "doc_id", text: str = "text", length: int = LENGTH) -> DataFrame:
    """Documents without the bytes of any ``length``-byte string that also starts in a document of smaller id.

    Texts are UTF-8 bytes; strings never cross documents and are judged on the input. Overlapping strings all
    count. Returns ``ident``, n_bytes, n_removed, n_spans (maximal removed runs), kept (the remaining bytes).

    Null text is empty; texts shorter than ``length`` stay. ``ident`` is an integer; a null id is larger than all
    others. Rows that share an id are no earlier documents of each other. Ranks have 64 bits: two different strings
    of a corpus of n strings meet with a chance of about n * n / 2 ** 65.
    """
    rows = docs.select(F.col(ident).cast("long").alias("ident"), F.col(text).alias("text"))
    total = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    bits = max(6, min(16, int(np.ceil(np.log2(max(1, total / BUCKET_BYTES))))))
    own = rows.select("ident", F.coalesce("text", F.lit("")).alias("text"), F.coalesce("ident", F.lit(int(LAST))).alias("doc"))
    sums = own.select("doc", F.unhex(F.md5("text")).alias("sum"), (F.xxhash64("text").bitwiseAND(MASK)).cast("int").alias("tag"))
    sums = written(sums.distinct(), "sums")
    # Ids of several texts are told apart by a tag of the text; elsewhere it would only take room.
    tags = not sums.groupBy("doc").count().where("count > 1").isEmpty()
    size = _filter_bits(total)
    share = rows.sparkSession.sparkContext.broadcast

    def shared(found: DataFrame) -> Broadcast:
        return share(_Bitmap(found.collect(), bits, size))

    halves = shared(written(_repeated(rows, lambda ranks: ranks.halves(ranks.stretches()), bits, size, length), "halves"))
    wide = _Stretching(halves)
    fine = shared(written(_repeated(rows, lambda ranks: wide.of(ranks)[0], bits, size, length), "parts"))
    stretching = _Stretching(halves, fine)
    places = written(_met(_stretch_places(rows, stretching, bits, length, tags), bits, size), "stretches")
    split = shared(places.where("kind = 1").select("bucket", "bits"))
    strings = _met(_string_places(rows, stretching, split, bits, length, tags), bits, size)
    spans = _spans(places.where("kind = 2").unionByName(strings))
    firsts = sums.groupBy("sum").agg(F.min("doc").alias("first"))
    copies = sums.join(firsts, "sum").where("first < doc").select("doc", F.col("tag") if tags else F.lit(0).alias("tag"))
    whole = copies.select("doc", "tag", F.lit(None).cast("binary").alias("starts"), F.lit(None).cast("binary").alias("counts"))
    spans = spans.unionByName(whole).groupBy("doc").agg(F.collect_list(F.struct("tag", "starts", "counts")).alias("found"))
    flagged = own.join(spans, "doc", "left").select("ident", "text", "found")

    def cut(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
        for whole in stream:
            for begin in range(0, whole.num_rows, CHUNK):
                batch = whole.slice(begin, CHUNK)
                out: list[list] = [[], [], [], []]
                for row in range(batch.num_rows):
                    raw = batch.column(1)[row].as_py().encode("utf-8", "surrogatepass")
                    tag = _tag(raw) if tags else 0
                    gone = np.zeros(len(raw) + 1, np.int32)
                    for held in batch.column(2)[row].as_py() or ():
                        if held["tag"] != tag or len(raw) < length:
                            continue
                        if held["starts"] is None:  # a copy of an earlier document
                            start, count = np.zeros(1, int), np.full(1, len(raw) - length + 1)
                        else:
                            start, count = (np.frombuffer(held[n], "<i4").astype(int) for n in ("starts", "counts"))
                        np.add.at(gone, start, 1)
                        np.add.at(gone, start + count - 1 + length, -1)
                    covered = np.cumsum(gone[:-1]) > 0
                    out[0].append(len(raw))
                    out[1].append(int(covered.sum()))
                    out[2].append(int((covered & ~np.concatenate(([False], covered[:-1]))[: len(covered)]).sum()) if len(raw) else 0)
                    out[3].append(np.frombuffer(raw, np.uint8)[~covered].tobytes())
                kinds = (pa.int64(), pa.int64(), pa.int64(), pa.binary())
                yield pa.table([batch.column(0), *(pa.array(c, k) for c, k in zip(out, kinds, strict=True))], names=["ident", "n_bytes", "n_removed", "n_spans", "kept"])

    return map_arrow(flagged, cut, "ident long, n_bytes long, n_removed long, n_spans long, kept binary").withColumnRenamed("ident", ident)
