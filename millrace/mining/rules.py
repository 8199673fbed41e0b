"""Association rules from itemsets, and predictions by rules."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.mining.baskets import clean_items, numbered, with_met


def _with_singles(itemsets: DataFrame, items: str) -> None:
    sizes = itemsets.agg(F.count(F.when(F.size(items) == 1, 1)).alias("one"), F.count("*").alias("all")).first()
    if sizes["all"] and not sizes["one"]:
        raise ValueError("the itemsets hold no single items; find them with min_size=1")


def association_rules(itemsets: DataFrame, min_confidence: float, items: str = "items", num: str = "num") -> DataFrame:
    """Rules ``antecedent => consequent`` with one item on the right.

    ``confidence`` is the share of baskets with the antecedent that hold the consequent as
    well. ``itemsets`` must hold the single items too (``min_size=1``): without them the rules
    with one item on the left would be missing, so that is an error.
    """
    _with_singles(itemsets, items)
    whole = itemsets.select(items, F.col(num).alias("both"), F.explode(items).alias("consequent"))
    split = whole.where(F.size(items) > 1).select(
        F.array_remove(items, F.col("consequent")).alias("antecedent"), "consequent", "both"
    )
    left = itemsets.select(F.array_sort(items).alias("antecedent"), F.col(num).alias("left"))
    return (
        split.withColumn("antecedent", F.array_sort("antecedent"))
        .join(left, "antecedent")
        .withColumn("confidence", F.col("both") / F.col("left"))
        .where(F.col("confidence") >= min_confidence)
        .select("antecedent", "consequent", "confidence", F.col("both").alias("num"))
    )


def with_lift(rules: DataFrame, itemsets: DataFrame) -> DataFrame:
    """Add ``lift`` and ``support`` to rules; ``itemsets`` must hold the single items and ``row_num``."""
    _with_singles(itemsets, "items")
    right = itemsets.where(F.size("items") == 1).select(
        F.element_at("items", 1).alias("consequent"), F.col("num").alias("_right"), "row_num"
    )
    return (
        rules.join(right, "consequent")
        .withColumn("lift", F.col("confidence") * F.col("row_num") / F.col("_right"))
        .withColumn("support", F.col("num") / F.col("row_num"))
        .drop("_right", "row_num")
    )


def predict(baskets: DataFrame, rules: DataFrame, items: str = "items") -> DataFrame:
    """Baskets with ``prediction``: consequents of rules that apply, less what they hold.

    Worked out once per different basket. A basket meets only the rules whose rarest
    antecedent item it holds; whether it holds the rest is checked on the row.
    """
    clean = baskets.withColumn("_items", clean_items(F.col(items)))
    told = rules.select(F.col("antecedent").alias("_left"), F.col("consequent").alias("_right"))
    met = with_met(numbered(clean, "_items"), told, "_left").where(~F.array_contains("items", F.col("_right")))
    found = met.groupBy("basket").agg(F.first("items").alias("_items"), F.array_sort(F.collect_set("_right")).alias("prediction"))
    nothing = F.array().cast("array<string>")
    return (
        clean.join(found.drop("basket"), "_items", "left")
        .withColumn("prediction", F.coalesce("prediction", nothing))
        .select(*baskets.columns, "prediction")
    )
