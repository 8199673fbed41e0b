"""The registered queries of these operators, and SQL for the same rows where SQL can say them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm import bpe, codes, fingerprint, jaccard, language, mixing, packing, pages, repeats, search, secrets, toxicity, whitening
from millrace.llm.common import in_fold, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, oracle: str | None = None) -> Callable:
    def register(plan: Callable[[SparkSession, str], DataFrame]) -> Callable:
        QUERIES[name] = plan
        if oracle is not None:
            ORACLES[name] = oracle
        return plan

    return register


@query("op1_main_text")
def op1(spark: SparkSession, folder: str) -> DataFrame:
    found = pages.extract(table(spark, folder, "pages"), ["page_id", "url"])
    return found.withColumn("n_chars", F.length("text").cast("long"))


@query("op2_mix_sources")
def op2(spark: SparkSession, folder: str) -> DataFrame:
    units = mixing.decide(table(spark, folder, "documents"))
    each = units.withColumn("_row", F.explode(F.sequence(F.lit(1).cast("long"), F.col("repeats"))))
    copies = F.col("copies") + F.when(F.col("_row") <= F.col("more"), 1).otherwise(0)
    return each.select("doc_id", "size", "source_size", "target", (F.col("size") * copies).alias("taken"))


@query("op3_secret_scan", secrets.sql())
def op3(spark: SparkSession, folder: str) -> DataFrame:
    found = secrets.scan(table(spark, folder, "documents").select("doc_id", "text"))
    count = lambda n: F.size(F.filter("found", lambda s: s["rule_no"] == n)).cast("long")
    base = secrets.listed(F.filter("found", lambda s: s["rule_no"] < len(secrets.BASE)))
    return found.select(
        "doc_id", count(0).alias("n_assign"), count(1).alias("n_access"), count(2).alias("n_hex"),
        F.sha2(base, 256).alias("base_sha256"), secrets.listed(F.col("found")).alias("spans"),
    )


@query("op4_fingerprint")
def op4(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text")
    return fingerprint.edit_trial(docs, fingerprint.lexicon(docs))


@query("op5_repeats")
def op5(spark: SparkSession, folder: str) -> DataFrame:
    found = repeats.remove_repeats(table(spark, folder, "documents"))
    return found.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def toxic_model(docs: DataFrame, labels: DataFrame) -> dict:
    """Fitted on labelled documents outside the held-out fold."""
    known = labels.where("toxic IS NOT NULL").select("doc_id", "toxic")
    # Joined by sorting at every size, as labels grow with the documents.
    rows = docs.where(~in_fold("doc_id", 3, 1)).select("doc_id", "text").join(known.hint("merge"), "doc_id")
    return toxicity.train(rows)


@query("op6_toxicity")
def op6(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text", in_fold("doc_id", 3, 1).alias("held_out"))
    model = toxic_model(docs, table(spark, folder, "labels"))
    scored = toxicity.score(docs, model, ["doc_id", "held_out"])
    return scored.withColumn("predicted", F.when(F.col("score") >= 0.7, 1).otherwise(0))


@query("op7_packing")
def op7(spark: SparkSession, folder: str) -> DataFrame:
    return packing.pack(packing.pieces(table(spark, folder, "documents")))


@query(
    "op8_topk_search",
    """
    WITH v AS (
        SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS e
        FROM embeddings
        WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
          AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    ), s AS (
        SELECT q.vec_id AS query_id, p.vec_id AS vec_id,
               CAST(list_sum(list_transform(list_zip(q.e, p.e), lambda z: z[1] * z[2])) AS BIGINT) AS score
        FROM v q JOIN v p ON q.vec_id % 100 = 0 AND q.vec_id <> p.vec_id
    )
    SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score
    FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
    WHERE rank <= 10
    """,
)
def op8(spark: SparkSession, folder: str) -> DataFrame:
    points = search.quantised(table(spark, folder, "embeddings"), "vec_id", "embedding", 1024)
    return search.top_k(points, points.where("vec_id % 100 = 0"), 10)


@query("op9_jaccard_join")
def op9(spark: SparkSession, folder: str) -> DataFrame:
    return jaccard.similar_classes(table(spark, folder, "documents"))


@query("op10_language_id")
def op10(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text", "lang")
    docs = docs.withColumn("held_out", in_fold("doc_id", 4, 2))
    model = language.train(docs.where("NOT held_out"))
    found = language.predict(docs, model, ["doc_id", "held_out"])
    return found.select(
        "doc_id", "held_out", F.col("nearest").alias("lang_pred"), "score", (F.col("lang_found") != F.col("nearest")).alias("rejected")
    )


@query("op11_whitening")
def op11(spark: SparkSession, folder: str) -> DataFrame:
    vectors = table(spark, folder, "embeddings").select("vec_id", "embedding")
    models = whitening.fit(vectors, "embedding", components=32)
    found = whitening.whiten(vectors, "vec_id", "embedding", models)
    each = F.posexplode(F.arrays_zip("whitened", "explained")).alias("place", "value")
    return found.select("vec_id", "n", F.expr("try_cast(deviation AS long)").alias("deviation"), "identity_error", each).select(
        "vec_id", (F.col("place") + 1).alias("component"), "n", "deviation", "value.whitened", "value.explained", "identity_error"
    )


@query("op12_byte_bpe")
def op12(spark: SparkSession, folder: str) -> DataFrame:
    words = bpe.vocabulary()
    found = bpe.decode(bpe.encode(table(spark, folder, "documents"), words), words)
    return found.select(
        "doc_id", F.expr("length(ids) div 4").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256")
    )


@query("op13_vector_codes")
def op13(spark: SparkSession, folder: str) -> DataFrame:
    rows, _ = codes.compress(table(spark, folder, "embeddings"), "vec_id", "embedding", "label")
    long = lambda c: F.expr(f"try_cast({c} AS long)").alias(c)
    return rows.select("vec_id", "code", long("error"), long("label_error"), "codebooks_sha256")
