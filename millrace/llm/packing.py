"""Packing token sequences by shortest-pack-first over the histogram of their lengths."""

from __future__ import annotations

import base64
import json
import zlib
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import map_arrow, texts_of
from millrace.operators.ranking import row_numbers
from millrace.session import written

WIDTH = 1024
END = 0


def encoding(path: str | None = None):
    """The byte-level BPE of ``path``, a file of ranks; by default the public 50k vocabulary.

    Its ids are those of the same vocabulary's tokenizer file, several times faster to get. The added
    tokens of that file, the ``.json`` beside the ranks where there is one, are special tokens here.
    """
    import public_tokenizers
    import tiktoken

    source = Path(path or public_tokenizers.path("byte_bpe_50k.tiktoken"))
    with open(source, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    file = source.with_suffix(".json")
    added = json.loads(file.read_text(encoding="utf-8")).get("added_tokens", []) if file.exists() else []
    special = {token["content"]: token["id"] for token in added}
    return tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=special)


def encode(code, text: str) -> np.ndarray:
    """The ids of ``text``: it is cut at added tokens, which are one id each, as the tokenizer file does."""
    return code.encode_to_numpy(text, allowed_special="all")


def pieces(
    docs: DataFrame, ident: str = "doc_id", text: str = "text", width: int = WIDTH, path: str | None = None, ids: bool = False
) -> DataFrame:
    """Every document's token ids and a closing 0, cut after each ``width`` ids.

    Returns ``ident``, start (ids before the piece), length, ids_crc32 (of the little-endian unsigned
    32-bit ids), doc_tokens; with ``ids`` also the ids themselves. Null text is empty: one piece, the
    closing id. Each id lies in exactly one piece. Whole texts are encoded.
    """
    columns = docs.select(F.col(ident).alias("_ident"), F.col(text).alias("_text"))
    kind = columns.schema["_ident"].dataType.simpleString()
    fields = f"`{ident}` {kind}, start long, length long, ids_crc32 long, doc_tokens long" + ", ids array<int>" * ids

    def work(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
        code = encoding(path)
        for batch in stream:
            row, start, length, crc, total, held = [], [], [], [], [], []
            for number, value in enumerate(texts_of(batch.column(1))):
                found = np.append(encode(code, value), END).astype("<u4")
                for begin in range(0, len(found), width):
                    part = found[begin : begin + width]
                    row.append(number)
                    start.append(begin)
                    length.append(len(part))
                    crc.append(zlib.crc32(part.tobytes()))
                    total.append(len(found))
                    if ids:
                        held.append(part.astype(np.int32))
            columns = [batch.column(0).take(pa.array(row, pa.int64()))]
            columns += [pa.array(c, pa.int64()) for c in (start, length, crc, total)]
            if ids:
                columns.append(pa.array(held, pa.list_(pa.int32())))
            names = [ident, "start", "length", "ids_crc32", "doc_tokens", *["ids"] * ids]
            yield pa.table(columns, names=names)

    return map_arrow(columns, work, fields)


def patterns(histogram: dict[int, int], width: int = WIDTH) -> list[tuple[int, tuple[int, ...]]]:
    """(count, lengths) of packs that together hold the histogram.

    Lengths go in longest first, all pieces of one length at once. They join the shortest open packs
    that have room, as many as there are, and open new packs for the rest. Every step uses up a length
    or a kind of pack, so there are a few thousand kinds however many pieces there are.
    """
    room: dict[int, list[list]] = {width: []}
    for length in sorted(histogram, reverse=True):
        left = histogram[length]
        for free in range(width - 1, length - 1, -1):
            kinds = room.get(free, [])
            while left and kinds:
                kind = kinds.pop()
                used = min(left, kind[0])
                if kind[0] > used:
                    kinds.append([kind[0] - used, kind[1]])
                room.setdefault(free - length, []).append([used, (*kind[1], length)])
                left -= used
            if not left:
                break
        # What is left opens packs; several pieces of one length share a pack where they fit.
        fit = width // length
        if left >= fit:
            room.setdefault(width - fit * length, []).append([left // fit, (length,) * fit])
        if left % fit:
            room.setdefault(width - left % fit * length, []).append([1, (length,) * (left % fit)])
    return [(count, pack) for kinds in room.values() for count, pack in kinds]


def slots(packs: list[tuple[int, tuple[int, ...]]]) -> dict[int, np.ndarray]:
    """For each length rows (first rank, first sequence, offset): which ranks go where, in order of rank."""
    places: dict[int, list] = {}
    ranks: dict[int, int] = {}
    sequence = 0
    for count, pack in packs:
        offset = 0
        for length in pack:
            first = ranks.get(length, 0)
            places.setdefault(length, []).append((first, sequence, offset))
            ranks[length] = first + count
            offset += length
        sequence += count
    return {length: np.array(rows, dtype=np.int64) for length, rows in places.items()}


def pack(cut: DataFrame, ident: str = "doc_id", width: int = WIDTH) -> DataFrame:
    """``cut`` (of ``pieces``) with sequence_id and offset.

    Only the histogram of lengths, at most ``width`` rows, is planned on the driver; the table of slots
    that goes to the tasks holds some thousand rows, whatever the corpus. Pieces of one length are
    ranked over all tasks, so the commonest length is no single task. An empty table gives no rows.
    """
    cut = written(cut, "pieces")
    histogram = {row["length"]: row["n"] for row in cut.groupBy("length").agg(F.count("*").alias("n")).collect()}
    table = cut.sparkSession.sparkContext.broadcast(slots(patterns(histogram, width)))
    ranked = row_numbers(cut, ["length"], [ident, "start", "ids_crc32"], "_rank")
    names = cut.columns
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in cut.schema)

    def work(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in stream:
            length = batch.column("length").to_numpy()
            rank = batch.column("_rank").to_numpy().astype(np.int64) - 1
            sequence, offset = np.zeros(len(rank), np.int64), np.zeros(len(rank), np.int64)
            for value in np.unique(length):
                rows = np.flatnonzero(length == value)
                places = table.value[int(value)]
                at = places[np.searchsorted(places[:, 0], rank[rows], side="right") - 1]
                sequence[rows] = at[:, 1] + rank[rows] - at[:, 0]
                offset[rows] = at[:, 2]
            kept = [batch.column(n) for n in names]
            yield pa.RecordBatch.from_arrays(
                [*kept, pa.array(sequence), pa.array(offset)], names=[*names, "sequence_id", "offset"]
            )

    return map_arrow(ranked.select(*names, "_rank"), work, f"{fields}, sequence_id long, offset long")


def sequences(packed: DataFrame) -> DataFrame:
    """(sequence_id, ids): the packed sequences; ``packed`` must carry ids. A sequence is at most ``width`` ids."""
    rows = packed.groupBy("sequence_id").agg(F.array_sort(F.collect_list(F.struct("offset", "ids"))).alias("parts"))
    return rows.select("sequence_id", F.flatten(F.transform("parts", lambda p: p["ids"])).alias("ids"))
