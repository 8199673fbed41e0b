"""I-Match fingerprints with randomised lexicon subsets."""

from __future__ import annotations

import base64
import hashlib
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from millrace.llm.common import map_arrow, texts_of, words_of
from millrace.session import written

SIGNS = ".,;:!?()[]{}\"'|#$%&*"
SUBSETS = 16
EMPTY = "...."
SCALES = 2
BUCKETS = 256


def terms(text: str) -> set[str]:
    """Distinct lower-case words without the signs around them."""
    found = {word.strip(SIGNS) for word in set(words_of(text.lower()))}
    found.discard("")
    return found


def lexicon(docs: DataFrame, text: str = "text", least: float = 0.001, most: float = 0.2) -> list[str]:
    """The terms of a band of inverse document frequency: in more than one text, and in ``least`` to ``most`` of all.

    Every text counts. The band holds at most (mean terms per text / ``least``) terms, however large the
    corpus: that bounds what the driver and the tasks hold. Counts are combined in each task and shuffled
    as packed lists, one for each of ``BUCKETS`` hash ranges of terms.
    """

    def work(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
        counts: Counter[str] = Counter()

        def flushed() -> pa.Table:
            parts: dict[int, list[str]] = {}
            for term in sorted(counts):
                parts.setdefault(zlib.crc32(_bytes(term)) % BUCKETS, []).append(term)
            packed = [zstandard.compress(_bytes("\n".join(t))) for t in parts.values()]
            df = [zstandard.compress(np.array([counts[t] for t in terms_], "<u4").tobytes()) for terms_ in parts.values()]
            kinds = (pa.int32(), pa.binary(), pa.binary())
            columns = zip((list(parts), packed, df), kinds, strict=True)
            return pa.table([pa.array(c, k) for c, k in columns], names=["bucket", "terms", "df"])

        for batch in stream:
            for value in texts_of(batch.column(0)):
                counts.update(terms(value))
            if len(counts) > 1_000_000:
                yield flushed()
                counts = Counter()
        yield flushed()

    texts = docs.count()

    def merge(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
        total: dict[str, int] = {}
        for packed, df in zip(group["terms"], group["df"], strict=True):
            names = zstandard.decompress(packed).decode("utf-8", "surrogatepass").split("\n")
            for term, count in zip(names, np.frombuffer(zstandard.decompress(df), "<u4").tolist(), strict=True):
                total[term] = total.get(term, 0) + count
        return pd.DataFrame({"term": [t for t, n in total.items() if max(2, least * texts) <= n <= most * texts]}, dtype=str)

    packed = map_arrow(docs.select(text), work, "bucket int, terms binary, df binary")
    return [r["term"] for r in packed.groupBy("bucket").applyInPandas(merge, "term string").collect()]


class Prints:
    """Fingerprints of texts under a lexicon.

    A subset of scale s keeps a term of the lexicon with a chance of 2 to the power of -s, by a hash of
    the term and the subset's number. A text of m terms is printed at the two scales at which a
    subset keeps about one of them; a 24-bit hash goes over the sorted terms kept. A text
    without terms of the band is printed with all its terms, one without any with its characters.
    """

    def __init__(self, band: list[str], seed: int = 1) -> None:
        self.band = frozenset(band)
        self.key = str(seed).encode()
        self.held: dict[str, bytes] = {}

    def depths(self, term: str) -> bytes:
        """For each subset how many scales keep the term: trailing zeros of its hash, a byte each."""
        found = self.held.get(term)
        if found is None:
            digest = hashlib.blake2b(_bytes(term), digest_size=4 * SUBSETS, key=self.key).digest()
            words = np.frombuffer(digest, dtype="<u4").tolist()
            found = bytes([(w & -w).bit_length() - 1 if w else 31 for w in words])
            if len(self.held) < 200_000:
                self.held[term] = found
        return found

    def of(self, text: str) -> str:
        found = terms(text)
        chosen = sorted(found & self.band) or sorted(found)
        if not chosen:
            return "-" + _short(text)
        depth = np.frombuffer(b"".join([self.depths(t) for t in chosen]), np.int8).reshape(-1, SUBSETS)
        scale = len(chosen).bit_length() - 1
        parts = []
        for s in range(scale, scale + SCALES):
            kept: list[list[str]] = [[] for _ in range(SUBSETS)]
            rows, subsets = np.nonzero(depth >= s)
            for row, subset in zip(rows.tolist(), subsets.tolist(), strict=True):
                kept[subset].append(chosen[row])
            parts.append(f"{s}:" + "".join([_short("\n".join(k)) if k else EMPTY for k in kept]))
        return ";".join(parts)


def _bytes(text: str) -> bytes:
    return text.encode("utf-8", "surrogatepass")


def _short(text: str) -> str:
    return base64.urlsafe_b64encode(hashlib.blake2b(_bytes(text), digest_size=3).digest()).decode()


def likeness(one: str, other: str) -> float:
    """Share of equal hashes among subsets that keep a term of either text, at the scales both have; equal prints give 1."""
    if one == other:
        return 1.0
    if one[:1] == "-" or other[:1] == "-":
        return 0.0
    first = dict(part.split(":") for part in one.split(";"))
    second = dict(part.split(":") for part in other.split(";"))
    same = held = 0
    for scale in first.keys() & second.keys():
        for at in range(0, 4 * SUBSETS, 4):
            a, b = first[scale][at : at + 4], second[scale][at : at + 4]
            held += a != EMPTY or b != EMPTY
            same += a == b != EMPTY
    return same / held if held else 0.0


def fingerprints(docs: DataFrame, band: list[str], keep: list[str], text: str = "text") -> DataFrame:
    """Columns ``keep`` and fingerprint. Null text is empty; equal texts have equal fingerprints; whole texts count."""
    shared = docs.sparkSession.sparkContext.broadcast(band)
    columns = docs.select(*keep, F.col(text).alias("_text"))
    schema = columns.drop("_text").schema

    def work(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        prints = Prints(shared.value)
        for batch in stream:
            found = [prints.of(value) for value in texts_of(batch.column(batch.num_columns - 1))]
            out = [batch.column(i) for i in range(batch.num_columns - 1)]
            yield pa.RecordBatch.from_arrays([*out, pa.array(found, pa.string())], names=[*schema.names, "fingerprint"])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema)
    return map_arrow(columns, work, f"{fields}, fingerprint string")


def edited(text: str, following: str) -> str:
    """The last quarter of the text, rounded down, replaced by as much of the following text's beginning."""
    quarter = len(text) // 4
    return text[: len(text) - quarter] + following[:quarter]


def edit_trial(docs: DataFrame, band: list[str], ident: str = "doc_id", text: str = "text") -> DataFrame:
    """Fingerprints of every text, of its ``edited`` form, and how like they and the next text's are.

    The next text is that of the next ``ident``, equal ones by their text's hash; null ids come first, and
    the first text follows the last. The rows are sorted over ranges of the id, so a task holds two
    texts at a time; the text at the end of a range meets the first of the next range afterwards: two
    rows per range.

    Returns ``ident``, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next.
    """
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(band)
    rows = docs.select(F.col(ident).alias("ident"), F.coalesce(text, F.lit("")).alias("text"))
    rows = rows.withColumn("tie", F.xxhash64("text"))
    kind = rows.schema["ident"].dataType.simpleString()
    ranged = rows.repartitionByRange("ident", "tie").sortWithinPartitions("ident", "tie", "text")
    names = ["n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
    fields = "n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    kinds = [pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]

    def measured(prints: Prints, value: str, own: str, following: str, after: str) -> tuple:
        changed = edited(value, following)
        other = prints.of(changed)
        digest = hashlib.sha256(_bytes(changed)).hexdigest()
        return len(value), digest, own, other, likeness(own, other), likeness(own, after)

    def walk(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
        prints, before, out = Prints(shared.value), None, []

        def table(results: list) -> pa.Table:
            columns = [pa.array([r[0] for r in results], ident_type), pa.array([r[1] for r in results], pa.int64())]
            columns += [pa.array([r[2][i] for r in results], k) for i, k in enumerate(kinds)]
            columns += [pa.array([r[3] for r in results], pa.string()), pa.array([r[4] for r in results], pa.string())]
            return pa.table(columns, names=["ident", "tie", *names, "text", "edge"])

        for batch in stream:
            ident_type = batch.schema.field("ident").type
            for key, value, tie in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                own = prints.of(value)
                if before is None:
                    out.append((key, tie, (None,) * 6, value, "first"))
                else:
                    out.append((*before[:2], measured(prints, *before[2:], value, own), None, None))
                before = (key, tie, value, own)
            if out:
                yield table(out)
                out = []
        if before is not None:
            yield table([(*before[:2], (None,) * 6, before[2], "last")])

    walked = written(map_arrow(ranged, walk, f"ident {kind}, tie long, {fields}, text string, edge string"), "edits")
    place = Window.orderBy("ident", "tie", F.when(F.col("edge") == "first", 0).otherwise(1), F.xxhash64("text"))
    # Two rows per range, first and last in turn.
    ends = walked.where("edge IS NOT NULL").select("ident", "tie", "text", "edge", F.row_number().over(place).alias("at"))
    ends = written(ends, "ends")
    total = ends.count()
    firsts = ends.where("edge = 'first'").select(
        F.when(F.col("at") == 1, total).otherwise(F.col("at") - 1).alias("at"), F.col("text").alias("following")
    )
    pairs = ends.where("edge = 'last'").join(firsts, "at").select("ident", "text", "following")

    def close(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
        prints = Prints(shared.value)
        for batch in stream:
            texts, others = batch.column(1).to_pylist(), batch.column(2).to_pylist()
            found = [measured(prints, a, prints.of(a), b, prints.of(b)) for a, b in zip(texts, others, strict=True)]
            yield pa.table(
                [batch.column(0), *(pa.array([r[i] for r in found], k) for i, k in enumerate(kinds))], names=["ident", *names]
            )

    closed = map_arrow(pairs, close, f"ident {kind}, {fields}")
    inner = walked.where("edge IS NULL").select("ident", *names)
    return inner.unionByName(closed).withColumnRenamed("ident", ident)
