"""Combinations and subsets of an array column, as expressions and as rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MAX_SUBSET_ITEMS = 24


def combinations(items: Column | str, size: int) -> Column:
    """All ``size``-element combinations of an array, in the order of the array.

    Each level extends the sets of the level before with the later elements only, so the
    work is proportional to the output.
    """
    if size < 1:
        raise ValueError("size must be at least 1")
    array = F.col(items) if isinstance(items, str) else items

    def extended(found: Column) -> Column:
        def grow(entry: Column) -> Column:
            return F.transform(
                F.slice(array, entry["next"], F.greatest(F.size(array) - entry["next"] + 1, F.lit(0))),
                lambda item, i: F.struct(
                    F.array_append(entry["combo"], item).alias("combo"), (entry["next"] + i + 1).alias("next")
                ),
            )

        return F.flatten(F.transform(found, grow))

    found = F.transform(array, lambda item, i: F.struct(F.array(item).alias("combo"), (i + 2).alias("next")))
    for _ in range(size - 1):
        found = extended(found)
    return F.transform(found, lambda entry: entry["combo"])


def subsets(items: Column | str, with_empty: bool = False) -> Column:
    """All subsets of an array, the full set included; 2^n of them.

    A longer array than ``MAX_SUBSET_ITEMS`` could not be returned in a row and stops the
    job with an error rather than giving a part of the answer; ``subset_rows`` has no such limit.
    """
    array = F.col(items) if isinstance(items, str) else items
    element = F.slice(array, 1, 1)
    start = F.array(F.slice(element, 1, 0))
    every = F.reduce(
        array, start, lambda acc, item: F.concat(acc, F.transform(acc, lambda part: F.array_append(part, item)))
    )
    fits = F.size(array) <= MAX_SUBSET_ITEMS
    stop = F.raise_error(F.concat(F.lit("subsets: too many items: "), F.size(array).cast("string")))
    found = F.when(array.isNull() | fits, every).otherwise(stop)
    return found if with_empty else F.filter(found, lambda part: F.size(part) > 0)


def subset_rows(df: DataFrame, items: str, name: str = "subset", with_empty: bool = False) -> DataFrame:
    """Every subset of the array as a row of its own, with the other columns; 2^n rows for n items.

    Subsets are numbered by their bits. Rows are made in two steps, the high bits first and dealt out over
    tasks, so a long array is not the work of one task and no row holds all subsets. A null array gives none.
    """
    count = F.size(items)
    low = F.least(count, F.lit(12))
    power = lambda bits: F.pow(F.lit(2.0), bits).cast("long")
    high = df.where(F.col(items).isNotNull()).withColumn("_high", F.explode(F.sequence(F.lit(0).cast("long"), power(count - low) - 1)))
    rows = high.hint("rebalance").withColumn("_low", F.explode(F.sequence(F.lit(0).cast("long"), power(low) - 1)))
    mask = F.col("_high") * power(low) + F.col("_low")

    def held(item: Column, i: Column) -> Column:
        return F.call_function("shiftright", mask, i).bitwiseAND(F.lit(1)) == 1

    found = rows.withColumn(name, F.filter(items, held)).drop("_high", "_low")
    return found if with_empty else found.where(F.size(name) > 0)
