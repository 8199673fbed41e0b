"""A training-data pipeline in five stages: toxic documents go, one of each group of near copies stays, secrets are
masked, sources are mixed to their weights, and what is left is packed into token sequences.

Each stage takes the session, the documents its predecessor kept and the folder of the tables, and works on all of
them. All but the last return the columns of ``documents``; the last returns the pieces of ``packing.pack``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm import jaccard, mixing, packing, secrets, toxicity
from millrace.llm.common import table
from millrace.llm.queries import toxic_model
from millrace.operators.ranking import top_per_group
from millrace.session import written

TOXIC_FROM = 0.7


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score less than ``TOXIC_FROM``; null and empty texts stay. The model learns from ``labels``."""
    model = toxic_model(docs, table(spark, sf_dir, "labels"))
    return toxicity.score(docs, model, docs.columns, extra="_score").where(F.col("_score") < TOXIC_FROM).select(docs.columns)


def keep_one_of_similar(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of rows that similarity of 0.8 or more links, the one with the smallest id, rows without an id last.

    A row counts as its id and its text, so unrelated texts that share an id all stay, and copies without an id go like
    any others. Of rows of one id and one text one stays. Texts without words link with nothing and stay.
    """
    worded = F.coalesce(F.regexp_like("text", F.lit(r"[^\x20\x09-\x0D]")), F.lit(False))
    row = F.struct(F.col("doc_id").isNull().alias("unnamed"), F.col("doc_id").alias("id"), F.xxhash64("text").alias("hash"))
    classes = jaccard.similar_classes(docs.where(worded).select(row.alias("row"), "text"), "row", percent=80)
    kept = classes.where(F.col("row") == F.col("component_id")).select("row.id", "row.hash").distinct()
    rows = docs.where(worded).withColumn("_hash", F.xxhash64("text"))
    rows = rows.join(kept, rows["doc_id"].eqNullSafe(kept["id"]) & (rows["_hash"] == kept["hash"]), "left_semi")
    rows = top_per_group(rows, ["doc_id", "_hash"], [F.xxhash64(*docs.columns)], 1, "_place")
    return rows.select(docs.columns).unionByName(docs.where(~worded))


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every span of a secret gives way to a mask; documents without any stay as they are."""
    found = secrets.scan(docs)
    text = secrets.masked(F.col("text"), F.col("found"))
    masked = found.withColumn("text", F.when(F.size("found") > 0, text).otherwise(F.col("text")))
    count = F.when(F.size("found") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))
    return masked.withColumn("n_chars", count).select(docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it."""
    return mixing.mixed(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents with their places in sequences of at most 1024 tokens."""
    return packing.pack(packing.pieces(docs))


STAGES = [
    ("toxicity", drop_toxic),
    ("near_duplicates", keep_one_of_similar),
    ("secrets", mask_secrets),
    ("mixing", mix_sources),
    ("packing", pack_sequences),
]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
