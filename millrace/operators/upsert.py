"""Keyed upsert and delete, copy-on-write.

Stored and new rows meet in one aggregation by key, combined before its shuffle; no row is read twice.
Keys identify stored rows. A stored row with a null in its key matches nothing and stays as it is.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.operators.ranking import top_per_group


def latest(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The last row of every key by ``order``; every task hands on one row per key."""
    return top_per_group(df, keys, [F.desc(c) for c in order], 1, "_rank").drop("_rank")


def _keyed(df: DataFrame, keys: list[str]) -> Column:
    return reduce(lambda a, b: a & b, (F.col(k).isNotNull() for k in keys))


def _place(df: DataFrame, order: list[str], stored: bool, like: DataFrame) -> Column:
    """Where a row stands: stored rows before all changes, these by ``order``."""
    kinds = {f.name: f.dataType for f in like.schema}
    values = [F.lit(None).cast(kinds[c]) if stored else F.col(c) for c in order]
    return F.struct(F.lit(0 if stored else 1).alias("new"), *(v.alias(f"o{i}") for i, v in enumerate(values)))


def upsert(
    base: DataFrame, batch: DataFrame, keys: list[str], precombine: list[str], compare_with_base: bool = False
) -> DataFrame:
    """``base`` with the rows of ``batch`` put in by key.

    Of several batch rows with one key the one with the highest ``precombine`` counts. It
    replaces the stored row; with ``compare_with_base`` only if it is not older than that.
    Write the result to a new path and switch to it, or overwrite the partitions it touches.
    """
    if compare_with_base:
        by_age = [F.col(c).alias(f"o{i}") for i, c in enumerate(precombine)]
        old, new = F.struct(*by_age, F.lit(0).alias("new")), F.struct(*by_age, F.lit(1).alias("new"))
    else:
        old, new = _place(base, precombine, True, batch), _place(batch, precombine, False, batch)
    stored = base.where(_keyed(base, keys)).select(F.struct(*base.columns).alias("_row"), old.alias("_place"))
    fresh = batch.select(F.struct(*base.columns).alias("_row"), new.alias("_place"))
    grouped = stored.union(fresh).groupBy(*(F.col("_row")[k].alias(f"_key{i}") for i, k in enumerate(keys)))
    last = grouped.agg(F.max_by("_row", "_place").alias("_row")).select("_row.*")
    return base.where(~_keyed(base, keys)).unionByName(last)


def apply_changes(
    base: DataFrame, changes: DataFrame, keys: list[str], order: list[str], action: str = "action", present: str = "present"
) -> DataFrame:
    """``base`` after inserts, updates and deletes, in the order of ``order``.

    ``changes`` has the columns of ``base`` (the keys are enough for a delete) plus the action and
    the order columns. Where it has the column ``present``, an array of column names, an update sets only these
    and leaves the others as they are; a row that comes back after a delete starts anew. An action that is
    none of insert, update and delete stops the job.
    """
    others = [c for c in base.columns if c not in keys]
    what = F.col(action)
    stop = F.raise_error(F.concat(F.lit("unknown action: "), F.coalesce(what, F.lit("null"))))
    gone = F.when(what == "delete", True).when(what.isin("insert", "update"), False).otherwise(stop.cast("boolean"))

    def set_(name: str) -> Column:
        return F.array_contains(present, name) if present in changes.columns else F.lit(True)

    fields = [F.struct(F.col(c).alias("value"), set_(c).alias("set")).alias(c) for c in others]
    fresh = changes.select(*keys, *fields, gone.alias("_gone"), _place(changes, order, False, changes).alias("_place"))
    fields = [F.struct(F.col(c).alias("value"), F.lit(True).alias("set")).alias(c) for c in others]
    old = _place(base, order, True, changes).alias("_place")
    stored = base.where(_keyed(base, keys)).select(*keys, *fields, F.lit(False).alias("_gone"), old)

    def when_set(name: str) -> Column:
        return F.when(~F.col("_gone") & F.col(name)["set"], F.col("_place"))

    sums = [F.max(F.when(F.col("_gone"), F.col("_place"))).alias("_died"), F.max(F.when(~F.col("_gone"), F.col("_place"))).alias("_lived")]
    for c in others:
        sums += [F.max_by(F.struct(F.col(c)["value"].alias("value")), when_set(c)).alias(c), F.max(when_set(c)).alias(f"_at_{c}")]
    last = stored.unionByName(fresh).groupBy(*keys).agg(*sums)
    alive = F.col("_lived").isNotNull() & (F.col("_died").isNull() | (F.col("_lived") > F.col("_died")))
    kept = [F.when(F.col("_died").isNull() | (F.col(f"_at_{c}") > F.col("_died")), F.col(c)["value"]).alias(c) for c in others]
    rows = last.where(alive).select(*keys, *kept).select(*base.columns)
    return base.where(~_keyed(base, keys)).unionByName(rows)
