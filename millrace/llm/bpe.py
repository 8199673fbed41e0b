"""Byte-level BPE on length-bucketed matrices: texts to token ids and back.

Each match of the pattern is a piece. Pieces whose bytes are one token are that token; the others stand as rows of a
matrix, pieces of similar length together, padded. In every round each row merges its leftmost pair of least rank, found
in a hash table of pairs; the row closes up by one place, rows without a pair left are taken out, and the matrix narrows.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import map_arrow, texts_of

NONE = np.int32(2**31 - 1)
FREE = np.uint64(2**64 - 1)
ODD = np.uint64(0x9E3779B97F4A7C15)
#: Cells of one matrix, characters cut at a time, pieces held as already seen, and bytes of them.
CELLS, CHARS, SEEN, SEEN_BYTES = 1 << 20, 1 << 19, 1 << 17, 1 << 24
#: Longer pieces merge all equal pairs of a round at once.
LONG = 1024


class Vocabulary:
    """Ranks as arrays: the tokens' bytes end to end, and an open-addressed hash table of the pairs that make a token.

    A pair's rank is that of its bytes put together, however the token was made in training. The size is that of the
    vocabulary, some ten MB for 50,000 tokens.
    """

    def __init__(self, ranks: dict[bytes, int], pattern: str) -> None:
        self.ranks, self.pattern = ranks, pattern
        size = max(ranks.values(), default=-1) + 1
        tokens = [b""] * size
        for token, rank in ranks.items():
            tokens[rank] = token
        self.known = np.array([bool(t) for t in tokens], dtype=bool)
        self.lengths = np.array([len(t) for t in tokens], dtype=np.int64)
        self.starts = np.cumsum(self.lengths) - self.lengths
        self.bytes = np.frombuffer(b"".join(tokens), dtype=np.uint8)
        self.single = np.array([ranks[bytes([b])] for b in range(256)], dtype=np.int32)
        pairs = [
            (ranks[token[:cut]], ranks[token[cut:]], rank)
            for token, rank in ranks.items()
            for cut in range(1, len(token))
            if token[:cut] in ranks and token[cut:] in ranks
        ]
        left, right, made = np.array(pairs, dtype=np.int64).reshape(-1, 3).T
        self._fill(left.astype(np.int32), right.astype(np.int32), made.astype(np.int32))

    def _fill(self, left: np.ndarray, right: np.ndarray, made: np.ndarray) -> None:
        bits = max(4, int(3 * max(1, len(made))).bit_length())
        self.shift, self.mask = np.uint64(64 - bits), np.uint64((1 << bits) - 1)
        self.keys, self.made, self.probes = np.full(1 << bits, FREE), np.full(1 << bits, NONE), 0
        keys = self._key(left, right)
        slots, waiting = (keys * ODD) >> self.shift, np.arange(len(keys))
        while len(waiting):
            self.probes += 1
            free = waiting[self.keys[slots[waiting]] == FREE]
            first = free[np.unique(slots[free], return_index=True)[1]]
            self.keys[slots[first]], self.made[slots[first]] = keys[first], made[first]
            waiting = np.setdiff1d(waiting, first, assume_unique=True)
            slots[waiting] = (slots[waiting] + np.uint64(1)) & self.mask

    @staticmethod
    def _key(left: np.ndarray, right: np.ndarray) -> np.ndarray:
        return (left.astype(np.uint64) << np.uint64(32)) | right.astype(np.uint64)

    def pair_ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The rank of each pair, ``NONE`` where it makes no token or either side is padding (below 0)."""
        shape = left.shape
        keys = self._key(np.maximum(left, 0), np.maximum(right, 0)).ravel()
        out = np.full(len(keys), NONE)
        open_ = np.flatnonzero(((left >= 0) & (right >= 0)).ravel())
        slots = (keys[open_] * ODD) >> self.shift
        for _ in range(self.probes):
            if not len(open_):
                break
            held = self.keys[slots]
            hit = held == keys[open_]
            out[open_[hit]] = self.made[slots[hit]]
            more = ~hit & (held != FREE)
            open_, slots = open_[more], (slots[more] + np.uint64(1)) & self.mask
        return out.reshape(shape)

    def merge(self, pieces: list[bytes]) -> list[np.ndarray]:
        """The ids of each piece."""
        out: list[np.ndarray] = [np.zeros(0, np.int32)] * len(pieces)
        lengths = np.array([len(p) for p in pieces], dtype=np.int64)
        for bucket in np.unique(np.ceil(np.log2(np.maximum(lengths, 1)))):
            width = int(2**bucket)
            rows = np.flatnonzero((lengths <= width) & (lengths > width // 2))
            if width > LONG:
                for row in rows:
                    out[row] = self._merge_long(self.single[np.frombuffer(pieces[row], np.uint8)])
                continue
            step = max(1, CELLS // width)
            for begin in range(0, len(rows), step):
                self._merge_rows(pieces, rows[begin : begin + step], lengths, out)
        return out

    def _merge_rows(self, pieces: list[bytes], rows: np.ndarray, lengths: np.ndarray, out: list[np.ndarray]) -> None:
        used = lengths[rows]
        width = int(used.max())
        inside = np.arange(width) < used[:, None]
        ids = np.full((len(rows), width), -1, np.int32)
        ids[inside] = self.single[np.frombuffer(b"".join(pieces[r] for r in rows), np.uint8)]
        ranks = self.pair_ranks(ids[:, :-1], ids[:, 1:])
        while True:
            at = ranks.argmin(axis=1) if ranks.shape[1] else np.zeros(len(rows), np.int64)
            best = ranks[np.arange(len(rows)), at] if ranks.shape[1] else np.full(len(rows), NONE)
            done = best == NONE
            if done.any():
                for place in np.flatnonzero(done):
                    out[rows[place]] = ids[place, : used[place]].copy()
                left = ~done
                rows, used, ids, ranks, at, best = rows[left], used[left], ids[left], ranks[left], at[left], best[left]
            if not len(rows):
                return
            every = np.arange(len(rows))
            ids[every, at] = best
            ids, ranks = _closed(ids, at + 1), _closed(ranks, at)
            used = used - 1
            before = np.flatnonzero(at > 0)
            ranks[before, at[before] - 1] = self.pair_ranks(ids[before, at[before] - 1], best[before])
            after = np.flatnonzero(at < ranks.shape[1])
            ranks[after, at[after]] = self.pair_ranks(best[after], ids[after, at[after] + 1])
            most = int(used.max())
            if most < ids.shape[1] * 3 // 4:
                ids, ranks = np.ascontiguousarray(ids[:, :most]), np.ascontiguousarray(ranks[:, : max(0, most - 1)])

    def _merge_long(self, ids: np.ndarray) -> np.ndarray:
        """One long piece. A round takes every pair of least rank from the left, up to the first whose merging makes a
        pair of lower rank still: what merging them one by one would do."""
        ranks = self.pair_ranks(ids[:-1], ids[1:])
        while len(ranks):
            best = ranks.min()
            if best == NONE:
                break
            at = np.flatnonzero(ranks == best)
            # Of pairs that share a token every second one, from the left.
            heads = np.flatnonzero(np.diff(at, prepend=-2) != 1)
            at = at[(np.arange(len(at)) - np.repeat(heads, np.diff(heads, append=len(at)))) % 2 == 0]
            left = np.where(at > 0, ids[at - 1], -1)
            left[1:][np.diff(at) == 2] = best
            right = np.where(at + 2 < len(ids), ids[np.minimum(at + 2, len(ids) - 1)], -1)
            made = np.full(len(at), best)
            lower = (self.pair_ranks(left, made) < best) | (self.pair_ranks(made, right) < best)
            if lower.any():
                at = at[: int(lower.argmax()) + 1]
            ids[at] = best
            kept = np.ones(len(ids), bool)
            kept[at + 1] = False
            ids = ids[kept]
            ranks = ranks[np.delete(np.arange(len(ranks)), at)]
            at = at - np.arange(len(at))
            before, after = at[at > 0] - 1, at[at < len(ids) - 1]
            ranks[before] = self.pair_ranks(ids[before], ids[before + 1])
            ranks[after] = self.pair_ranks(ids[after], ids[after + 1])
        return ids

    def decode(self, ids: np.ndarray) -> np.ndarray:
        """The bytes of all ids, end to end. An id without a token is an error."""
        if len(ids) and (ids.max() >= len(self.known) or not self.known[ids].all()):
            raise ValueError("an id is not in the vocabulary")
        return self.bytes[_spans(self.starts[ids], self.lengths[ids])]


def _closed(table: np.ndarray, at: np.ndarray) -> np.ndarray:
    """``table`` without the cell ``at`` of each row."""
    kept = np.ones(table.shape, bool)
    kept[np.arange(len(table)), at] = False
    return table[kept].reshape(len(table), table.shape[1] - 1)


def _spans(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The places of all spans, one span after the other."""
    ends = np.cumsum(lengths)
    return np.repeat(starts - (ends - lengths), lengths) + np.arange(int(ends[-1]) if len(ends) else 0)


class Encoder:
    """Texts to ids, with a bounded memory of pieces already merged."""

    def __init__(self, vocabulary: Vocabulary) -> None:
        self.vocabulary, self.pattern = vocabulary, regex.compile(vocabulary.pattern)
        self._forget()

    def _forget(self) -> None:
        self.numbers: dict[str, int] = {}
        self.ids, self.starts, self.lengths = np.zeros(0, np.int32), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def _numbered(self, pieces: list[str]) -> np.ndarray:
        """A number for every piece; the ids of new ones are worked out together."""
        if len(self.numbers) > SEEN or self.ids.nbytes > SEEN_BYTES:
            self._forget()
        numbers = self.numbers
        known = len(numbers)
        for piece in set(pieces).difference(numbers):
            numbers[piece] = len(numbers)
        new = [p.encode("utf-8", "replace") for p in islice(reversed(numbers), len(numbers) - known)][::-1]
        if new:
            ranks = self.vocabulary.ranks
            found = [np.array([ranks[p]], np.int32) if p in ranks else None for p in new]
            rest = [place for place, ids in enumerate(found) if ids is None]
            for place, ids in zip(rest, self.vocabulary.merge([new[p] for p in rest]), strict=True):
                found[place] = ids
            lengths = np.array([len(ids) for ids in found], dtype=np.int64)
            self.starts = np.concatenate((self.starts, len(self.ids) + np.cumsum(lengths) - lengths))
            self.lengths = np.concatenate((self.lengths, lengths))
            self.ids = np.concatenate((self.ids, *found))
        return np.fromiter(map(numbers.__getitem__, pieces), np.int64, len(pieces))

    def _of(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all pieces end to end, ids of each)."""
        numbers = self._numbered(pieces)
        lengths = self.lengths[numbers]
        return self.ids[_spans(self.starts[numbers], lengths)], lengths

    def encode(self, texts: list[str]) -> Iterator[list[np.ndarray]]:
        """The ids of each text, some texts at a time: about ``CHARS`` characters, or one longer text."""
        begin = 0
        while begin < len(texts):
            end, size = begin, 0
            while end < len(texts) and (end == begin or size + len(texts[end]) <= CHARS):
                size += len(texts[end])
                end += 1
            if size > CHARS:
                matches = (m.group() for m in self.pattern.finditer(texts[begin]))
                parts = []
                while pieces := list(islice(matches, CHARS // 4)):
                    parts.append(self._of(pieces)[0])
                yield [np.concatenate([np.zeros(0, np.int32), *parts])]
            else:
                cut = [self.pattern.findall(text) for text in texts[begin:end]]
                ids, lengths = self._of([piece for pieces in cut for piece in pieces])
                places = np.concatenate(([0], np.cumsum(lengths)))
                bounds = places[np.cumsum([0, *map(len, cut)])]
                yield [ids[a:b] for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
            begin = end


def vocabulary(path: str | None = None, pattern: str | None = None) -> Vocabulary:
    """From a file of ranks (base64 of a token's bytes, its rank); by default the public 50k ranks and their pattern."""
    import public_tokenizers

    with open(path or public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb") as lines:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
    return Vocabulary(ranks, pattern or public_tokenizers.PATTERN)


def encode(docs: DataFrame, words: Vocabulary, ident: str = "doc_id", text: str = "text") -> DataFrame:
    """(``ident``, ids): the token ids of every whole text, as little-endian unsigned 32-bit numbers end to end.

    Null text is empty and has no ids. Strings of special tokens are ordinary text. Null and repeated ids are rows like
    others. The vocabulary goes to the tasks as a broadcast; its size does not depend on the documents.
    """
    rows = docs.select(F.col(ident).alias("ident"), F.col(text).alias("text"))
    shared = docs.sparkSession.sparkContext.broadcast(words)

    def work(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
        encoder = Encoder(shared.value)
        for batch in stream:
            done = 0
            for found in encoder.encode(texts_of(batch.column(1))):
                ids = pa.array([f.astype("<u4").tobytes() for f in found], pa.binary())
                yield pa.table({ident: batch.column(0).slice(done, len(found)), "ids": ids})
                done += len(found)

    return map_arrow(rows, work, f"`{ident}` {rows.schema['ident'].dataType.simpleString()}, ids binary")


def decode(encoded: DataFrame, words: Vocabulary, ident: str = "doc_id", ids: str = "ids") -> DataFrame:
    """(``ident``, ids, decoded): the bytes that the ids of ``encode`` stand for. Null ids are none."""
    rows = encoded.select(F.col(ident).alias("ident"), F.col(ids).alias("ids"))
    shared = encoded.sparkSession.sparkContext.broadcast(words)

    def work(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
        for batch in stream:
            row, held, size = 0, [], 0
            for value in batch.column(1):
                packed = value.as_py() or b""
                held.append(shared.value.decode(np.frombuffer(packed, "<u4")).tobytes())
                size += len(packed)
                if size > 4 * CHARS:
                    yield _decoded(batch, row, held)
                    row, held, size = row + len(held), [], 0
            yield _decoded(batch, row, held)

    def _decoded(batch: pa.RecordBatch, row: int, held: list[bytes]) -> pa.Table:
        return pa.table(
            {ident: batch.column(0).slice(row, len(held)), "ids": batch.column(1).slice(row, len(held)), "decoded": pa.array(held, pa.binary())}
        )

    return map_arrow(rows, work, f"`{ident}` {rows.schema['ident'].dataType.simpleString()}, ids binary, decoded binary")
