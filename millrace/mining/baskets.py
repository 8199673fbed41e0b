"""Baskets: a table with one array of different items per row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.session import written


def clean_items(items: Column) -> Column:
    """Different items, sorted, without blanks and without the word null in any case."""
    kept = F.filter(items, lambda x: ~x.rlike(r"^[\x00-\x20]*\z") & (F.lower(x) != "null"))
    return F.array_sort(F.array_distinct(kept))


def split_items(column: str, sep: str = ",") -> Column:
    """Clean items of a text column such as ``"a,b,,null,a"``."""
    return clean_items(F.split(column, sep))


def baskets_of(df: DataFrame, basket: str, item: str, name: str = "items") -> DataFrame:
    """Baskets from (basket, item) rows. Repeated pairs go before the shuffle by basket."""
    pairs = df.where(F.col(item).isNotNull()).select(basket, item).distinct()
    return pairs.groupBy(basket).agg(F.array_sort(F.collect_list(item)).alias(name))


def longest(baskets: DataFrame, n: int = 5, items: str = "items") -> DataFrame:
    """The ``n`` longest baskets with their lengths."""
    sized = baskets.withColumn("n_items", F.size(items))
    return sized.orderBy(F.desc("n_items"), F.col(items)).limit(n)


def only_items(baskets: DataFrame, wanted: DataFrame, key: str | list[str], items: str = "items", at_least: int = 1) -> DataFrame:
    """Baskets reduced to the items in ``wanted.item``; shorter ones than ``at_least`` go.

    A join on the item, so ``wanted`` may be of any size, then back together by ``key``.
    """
    keys = [key] if isinstance(key, str) else key
    rows = baskets.select(*keys, F.explode(items).alias("item")).join(wanted.select("item"), "item", "left_semi")
    kept = rows.groupBy(*keys).agg(F.array_sort(F.collect_list("item")).alias(items))
    return kept.where(F.size(items) >= at_least)


def numbered(baskets: DataFrame, items: str = "items") -> DataFrame:
    """Different baskets with a number and how often each occurs: ``(basket, items, weight)``.

    Stored, because a basket must keep its number whatever is computed again.
    """
    different = baskets.groupBy(F.col(items).alias("items")).agg(F.count("*").alias("weight"))
    return written(different.withColumn("basket", F.monotonically_increasing_id()), "numbered-baskets")


def with_met(stored: DataFrame, sets: DataFrame, members: str) -> DataFrame:
    """``(basket, items, weight)`` with the columns of every row of ``sets`` whose members the basket holds.

    A set is looked up by the member that the fewest baskets hold, so an item of every basket brings no
    basket together with every set. A set with a member of no basket is in none; an empty set is in all and
    left out.
    """
    keyed = written(sets.distinct().withColumn("_set", F.monotonically_increasing_id()), "sets")
    single = stored.select("basket", F.explode("items").alias("_anchor"))
    held = single.groupBy("_anchor").agg(F.count("*").alias("_held"))
    each = keyed.select("_set", F.explode(F.array_distinct(members)).alias("_anchor")).join(held, "_anchor")
    rarest = each.groupBy("_set").agg(F.min(F.struct("_held", "_anchor"))["_anchor"].alias("_anchor"))
    met = single.join(rarest, "_anchor").select("basket", "_set")
    rows = met.join(stored, "basket").join(keyed, "_set")
    whole = F.size(F.array_except(members, F.col("items"))) == 0
    return rows.where(whole).select("basket", "items", "weight", *sets.columns)


def containing(baskets: DataFrame, candidates: DataFrame, items: str = "items", candidate: str = "candidate") -> DataFrame:
    """In how many baskets each candidate set is contained: ``(candidate, n)``.

    Equal baskets are looked at once, with a weight.
    """
    met = with_met(numbered(baskets, items), candidates.select(F.col(candidate).alias("_candidate")), "_candidate")
    return met.groupBy(F.col("_candidate").alias(candidate)).agg(F.sum("weight").alias("n"))
