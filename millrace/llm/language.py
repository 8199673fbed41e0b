"""Language identification: nearest of several TF-IDF centroids per language, by cosine."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import map_arrow, texts_of
from millrace.operators.ranking import top_per_group

BINS = 8192
UNKNOWN = "und"
CHUNK = 256


class Grams:
    """Counts of hashed letter bigrams and trigrams; anything but letters is one space."""

    def __init__(self) -> None:
        self.letter = np.zeros(0x110000, dtype=bool)
        points = [p for p in range(0x110000) if not 0xD800 <= p < 0xE000 and chr(p).isalpha()]
        self.letter[points] = True

    def codes(self, text: str) -> np.ndarray:
        raw = np.frombuffer(f" {text.lower()} ".encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
        raw = np.where(self.letter[raw], raw, np.uint32(32))
        blank = raw == 32
        return raw[~(blank & np.concatenate(([False], blank[:-1])))]

    def counts(self, text: str) -> np.ndarray | None:
        """None where the text holds no letter."""
        codes = self.codes(text)
        if len(codes) < 3:
            return None
        with np.errstate(over="ignore"):
            pairs = codes[:-1] * np.uint32(0x9E3779B1) + codes[1:] * np.uint32(0x85EBCA6B)
            triples = pairs[:-1] * np.uint32(0x27D4EB2F) + codes[2:] * np.uint32(0xC2B2AE35)
            bins = np.concatenate((pairs * np.uint32(0x2545F491), triples * np.uint32(0x165667B1))) >> np.uint32(19)
        return np.bincount(bins, minlength=BINS)

    def vectors(self, texts: list[str], idf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Unit TF-IDF rows, and which texts have letters."""
        found = np.zeros((len(texts), BINS), dtype=np.float32)
        lettered = np.zeros(len(texts), dtype=bool)
        for row, text in enumerate(texts):
            counts = self.counts(text)
            if counts is not None:
                lettered[row] = True
                found[row] = np.log1p(counts) * idf
        length = np.linalg.norm(found, axis=1, keepdims=True)
        return found / np.where(length > 0, length, 1), lettered


def document_counts(docs: DataFrame, text: str) -> DataFrame:
    """(bin, df): in how many texts each bin occurs, bin -1 for all texts. One row per bin and task is shuffled."""

    def work(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
        grams, seen, total = Grams(), np.zeros(BINS, dtype=np.int64), 0
        for batch in stream:
            for value in texts_of(batch.column(0)):
                counts = grams.counts(value)
                if counts is not None:
                    seen += counts > 0
                    total += 1
        if total:
            yield pa.table({"bin": np.arange(-1, BINS, dtype=np.int32), "df": np.concatenate(([total], seen))})

    return map_arrow(docs.select(text), work, "bin int, df long").groupBy("bin").agg(F.sum("df").alias("df"))


def _clusters(vectors: np.ndarray, count: int, rounds: int) -> np.ndarray:
    """Spherical k-means; the seeds are the mean's nearest row, then the farthest from those chosen."""
    mean = vectors.mean(axis=0)
    chosen = [int(np.argmax(vectors @ mean))]
    nearest = vectors @ vectors[chosen[0]]
    while len(chosen) < min(count, len(vectors)):
        chosen.append(int(np.argmin(nearest)))
        nearest = np.maximum(nearest, vectors @ vectors[chosen[-1]])
    centres = vectors[chosen]
    for _ in range(rounds):
        owner = np.argmax(vectors @ centres.T, axis=1)
        sums = np.zeros_like(centres)
        np.add.at(sums, owner, vectors)
        length = np.linalg.norm(sums, axis=1, keepdims=True)
        centres = np.where(length > 0, sums / np.where(length > 0, length, 1), centres)
    return centres


def _step(hashed: Column) -> Column:
    """On which of some 240 steps a hash lies; it grows with the hash, each step is a fifth wider than the one before."""
    return F.floor(4 * F.log2(F.greatest(hashed / F.lit(2.0**64) + 0.5, F.lit(2.0**-60))))


def _reach(hashes: DataFrame, wanted: int) -> dict[str, int]:
    """Per language the step up to which there are ``wanted`` different hashes, the last one where there are fewer.

    The different hashes of each step are counted, so it does not matter how evenly they lie.
    """
    steps = hashes.distinct().groupBy("lang", _step(F.col("hash")).alias("step")).count().collect()
    reach: dict[str, int] = {}
    held: dict[str, int] = {}
    for row in sorted(steps, key=lambda r: r["step"]):
        if held.get(row["lang"], 0) < wanted:
            reach[row["lang"]] = row["step"]
            held[row["lang"]] = held.get(row["lang"], 0) + row["count"]
    return reach


def train(
    docs: DataFrame, text: str = "text", lang: str = "lang", clusters: int = 4, per_language: int = 1000, rounds: int = 8
) -> dict:
    """Centroids per language from labelled documents.

    Document frequencies cover all rows of ``docs`` with a language. The centroids are fitted on at
    most ``per_language`` different texts of each language, those with the smallest hash of the text,
    and on all where there are no more: copies count once at every size. This bound and ``clusters``
    are what the driver and one group hold. Each centroid keeps a radius, the largest distance of its
    own sample rows, for rejection.
    """
    labelled = docs.select(F.col(text).alias("text"), F.col(lang).alias("lang")).where("lang IS NOT NULL AND text IS NOT NULL")
    counts = {row["bin"]: row["df"] for row in document_counts(labelled, "text").collect()}
    total = counts.get(-1, 0)
    idf = np.array([np.log((1 + total) / (1 + counts.get(b, 0))) + 0.1 for b in range(BINS)], dtype=np.float32)
    labelled = labelled.where(F.col("text").rlike(r"\p{L}"))
    hashed = F.xxhash64("text", F.lit(5))
    reach = _reach(labelled.select("lang", hashed.alias("hash")), per_language)
    if not reach:
        return {"idf": idf, "langs": [], "centres": np.zeros((0, BINS), np.float32), "radii": np.zeros(0)}
    limit = F.create_map(*(F.lit(v) for pair in reach.items() for v in pair))[F.col("lang")]
    # Copies go in every task before the shuffle, so a text of thousands of copies is one row a task.
    distinct = labelled.where(_step(hashed) <= limit).select("lang", "text").distinct()
    sample = top_per_group(distinct, ["lang"], [hashed, F.col("text")], per_language)

    def fit(group: pd.DataFrame) -> pd.DataFrame:
        vectors, lettered = Grams().vectors(list(group["text"]), idf)
        vectors = vectors[lettered]
        if not len(vectors):
            return pd.DataFrame({"lang": [], "centre": [], "radius": []})
        centres = _clusters(vectors, clusters, rounds)
        near = vectors @ centres.T
        owner = near.argmax(axis=1)
        reach = [float(1 - near[owner == k, k].min()) if (owner == k).any() else 0.0 for k in range(len(centres))]
        return pd.DataFrame(
            {"lang": group["lang"].iloc[0], "centre": [c.astype(np.float32).tobytes() for c in centres], "radius": reach}
        )

    rows = sample.groupBy("lang").applyInPandas(fit, "lang string, centre binary, radius double").collect()
    rows = sorted(rows, key=lambda r: (r["lang"], r["centre"]))
    return {
        "idf": idf,
        "langs": [r["lang"] for r in rows],
        "centres": np.array([np.frombuffer(r["centre"], dtype=np.float32) for r in rows]).reshape(-1, BINS),
        "radii": np.array([r["radius"] for r in rows]),
    }


def predict(docs: DataFrame, model: dict, keep: list[str], text: str = "text", slack: float = 1.5) -> DataFrame:
    """Columns ``keep``, ``nearest`` (language of the nearest centroid), ``score`` (its cosine, 0 to 1),
    ``lang_found``: ``nearest``, or ``und`` where the text lies farther from the centroid than ``slack``
    times its radius.

    Null, empty and letterless texts, and every text where no language was learned, give ``und`` and 0.
    Ties go to the language that sorts first. Whole texts count.
    """
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(model)
    columns = docs.select(*keep, F.col(text).alias("_text"))
    schema = columns.drop("_text").schema

    def work(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, grams = shared.value, Grams()
        langs = np.array([*held["langs"], UNKNOWN], dtype=object)
        for batch in stream:
            for start in range(0, batch.num_rows, CHUNK):
                part = batch.slice(start, CHUNK)
                vectors, known = grams.vectors(texts_of(part.column(part.num_columns - 1)), held["idf"])
                if len(held["langs"]):
                    near = vectors @ held["centres"].T
                    best = near.argmax(axis=1)
                    score = np.clip(near[np.arange(len(best)), best].astype(float), 0, 1)
                    far = 1 - score > slack * held["radii"][best] + 1e-6
                else:
                    best, score, far = np.zeros(len(known), int), np.zeros(len(known)), known
                    known = np.zeros(len(known), bool)
                nearest = np.where(known, best, len(langs) - 1)
                out = [part.column(i) for i in range(part.num_columns - 1)]
                out += [
                    pa.array(langs[nearest], pa.string()),
                    pa.array(np.where(known, score, 0.0)),
                    pa.array(np.where(far, UNKNOWN, langs[nearest]), pa.string()),
                ]
                yield pa.RecordBatch.from_arrays(out, names=[*schema.names, "nearest", "score", "lang_found"])

    kept = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema)
    return map_arrow(columns, work, f"{kept}, nearest string, score double, lang_found string")
