"""Frequent itemsets, level by level.

A basket is extended only by its own later items, and only by those that some frequent set
allows. A level works on rows ``(prefix, rest, weight)``: a frequent set contained in
``weight`` baskets that all go on with the items ``rest``. Counting a level is one
aggregation over (prefix, next item), combined on the map side; the counts that pass give
the next rows by an equality join on the prefix. Nothing but row counts reaches the driver.

Equal baskets are merged into one row with a weight first, so a basket that was bought a
billion times is expanded once. Very wide baskets are dealt out to many tasks by position.
"""

from __future__ import annotations

from fractions import Fraction

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.mining.baskets import clean_items, numbered, only_items
from millrace.session import written

WIDE = 1_000


def needed(min_support: float, rows: int, strict: bool = False) -> int:
    """The smallest count that reaches ``min_support`` (or, if strict, exceeds it).

    The support is the decimal it is written as, and the count exact at any number of rows.
    """
    exact = Fraction(str(min_support)) * rows
    return int(exact // 1) + 1 if strict else max(1, -int(-exact // 1))


def share_for(min_support: float, rows: int) -> float:
    """A share of ``rows`` that, rounded up to a whole count in doubles, gives ``needed``."""
    return max(0.0, min(1.0, (needed(min_support, rows) - 0.5) / rows)) if rows else 0.0


def single_items(baskets: DataFrame, at_least: int, items: str = "items", weight: str | None = None) -> DataFrame:
    """Items in at least ``at_least`` baskets: ``(item, num)``; a row may stand for ``weight`` baskets."""
    many = F.col(weight) if weight else F.lit(1)
    rows = baskets.select(F.explode(items).alias("item"), many.cast("long").alias("_many"))
    counts = rows.groupBy("item").agg(F.sum("_many").alias("num"))
    return counts.where(F.col("num") >= at_least)


def _dealt(merged: DataFrame) -> DataFrame:
    """Add ``lane`` of ``lanes``: a wide basket once per lane, each to expand its share of prefixes."""
    lanes = F.ceil(F.size("items") / F.lit(WIDE)).cast("int")
    narrow = merged.where(F.size("items") <= WIDE).select("items", "weight", F.lit(0).alias("lane"), F.lit(1).alias("lanes"))
    wide = (
        merged.where(F.size("items") > WIDE)
        .withColumn("lanes", lanes * lanes)
        .select("items", "weight", F.explode(F.sequence(F.lit(0), F.col("lanes") - 1)).alias("lane"), "lanes")
        .repartition("items", "lane")
    )
    return narrow.unionByName(wide)


def _rest(items: Column, position: Column) -> Column:
    """The items after a 0-based position."""
    return F.slice(items, position + 2, F.size(items))


def _first_rows(merged: DataFrame) -> DataFrame:
    """Rows of level 1: every item as a prefix with the items after it."""
    mine = F.filter(
        F.sequence(F.lit(0), F.size("items") - 2), lambda i: F.pmod(i, F.col("lanes")) == F.col("lane")
    )
    placed = _dealt(merged).select("items", "weight", F.explode(mine).alias("i"))
    return placed.select(
        F.array(F.element_at("items", F.col("i") + 1)).alias("prefix"),
        _rest(F.col("items"), F.col("i")).alias("rest"),
        "weight",
    )


def _next_rows(rows: DataFrame, passed: DataFrame) -> DataFrame:
    """Rows one item longer: prefix + item for every extension that passed and is followed by more."""
    allowed = passed.groupBy("prefix").agg(F.collect_list("item").alias("allowed"))
    going_on = rows.join(allowed, "prefix").withColumn("rest", F.array_intersect("rest", "allowed"))
    placed = going_on.where(F.size("rest") >= 2).select(
        "prefix", "rest", "weight", F.explode(F.sequence(F.lit(0), F.size("rest") - 2)).alias("i")
    )
    longer = placed.select(
        F.array_append("prefix", F.element_at("rest", F.col("i") + 1)).alias("prefix"),
        _rest(F.col("rest"), F.col("i")).alias("rest"),
        "weight",
    )
    return longer.groupBy("prefix", "rest").agg(F.sum("weight").alias("weight"))


def frequent_itemsets(
    baskets: DataFrame,
    min_support: float,
    items: str = "items",
    max_size: int | None = None,
    min_size: int = 2,
    strict: bool = False,
    trace: str | None = None,
) -> DataFrame:
    """All itemsets of ``min_size`` items or more (to ``max_size``, if given) in enough baskets.

    Rows ``(items, k, num, row_num)``: the sorted set, its size, the number of baskets that
    hold it and the number of all baskets. ``strict`` asks for more than ``min_support``.
    ``trace`` names a folder for the candidates of every level and their counts.
    """
    stored = numbered(baskets.select(clean_items(F.col(items)).alias("items")))
    rows_total = stored.agg(F.sum("weight")).first()[0] or 0
    enough = needed(min_support, rows_total, strict)
    singles = written(single_items(stored, enough, weight="weight"), "itemsets-1")

    levels = [singles.select(F.array("item").alias("items"), F.lit(1).alias("k"), "num")] if min_size <= 1 else []
    pruned = only_items(stored, singles, ["basket", "weight"], at_least=2)
    merged = written(pruned.groupBy("items").agg(F.sum("weight").alias("weight")), "merged-baskets")
    rows = _first_rows(merged)
    size = 1
    while max_size is None or size < max_size:
        size += 1
        pairs = rows.select("prefix", F.explode("rest").alias("item"), "weight")
        counts = pairs.groupBy("prefix", "item").agg(F.sum("weight").alias("num"))
        if trace:
            ck = F.array_join(F.array_append("prefix", F.col("item")), ",").alias("ck")
            counts.select(ck, "num").write.mode("overwrite").parquet(f"{trace}/k={size}")
        passed = written(counts.where(F.col("num") >= enough), f"itemsets-{size}")
        found = passed.count()
        if size >= min_size and found:
            levels.append(
                passed.select(F.array_append("prefix", F.col("item")).alias("items"), F.lit(size).alias("k"), "num")
            )
        # A set of k + 1 items has k + 1 frequent subsets of k items.
        if found <= size:
            break
        if size != max_size:
            rows = written(_next_rows(rows, passed), f"rows-{size}")
    if not levels:
        levels = [singles.limit(0).select(F.array("item").alias("items"), F.lit(1).alias("k"), "num")]
    result = levels[0]
    for level in levels[1:]:
        result = result.unionByName(level)
    return result.withColumn("row_num", F.lit(rows_total).cast("long"))


def fp_growth(
    baskets: DataFrame,
    min_support: float,
    min_confidence: float = 0.8,
    items: str = "items",
    min_size: int = 2,
    partitions: int | None = None,
) -> tuple[DataFrame, DataFrame]:
    """Spark ML's FP-growth: itemsets ``(items, k, num)`` and rules, both over clean baskets.

    Sets are frequent from the same whole count on as with ``frequent_itemsets``.
    """
    settings = {"numPartitions": partitions} if partitions else {}
    clean = baskets.select(clean_items(F.col(items)).alias("items"))
    growth = FPGrowth(itemsCol="items", minSupport=share_for(min_support, clean.count()), minConfidence=min_confidence, **settings)
    model = growth.fit(clean)
    found = model.freqItemsets.select(
        F.array_sort("items").alias("items"), F.size("items").alias("k"), F.col("freq").alias("num")
    )
    return found.where(F.col("k") >= min_size), model.associationRules


def as_report(itemsets: DataFrame) -> DataFrame:
    """Itemsets as ``(frequent_set, k, num, row_num, support, etl_time)``."""
    return itemsets.select(
        F.array_join("items", ",").alias("frequent_set"),
        "k",
        "num",
        "row_num",
        (F.col("num") / F.col("row_num")).alias("support"),
        F.current_timestamp().alias("etl_time"),
    )


def maximal(itemsets: DataFrame) -> DataFrame:
    """Itemsets that no larger frequent set contains; of all sizes, without a ``max_size``.

    Every subset of a frequent set is frequent too, so it is enough to take out the sets that
    miss one item of a set one larger: an equality join, not a containment test.
    """
    covered = itemsets.where(F.size("items") > 1).select(
        F.explode(F.transform("items", lambda x: F.array_remove(F.col("items"), x))).alias("items")
    )
    return itemsets.join(covered.distinct(), "items", "left_anti").select(*itemsets.columns)
