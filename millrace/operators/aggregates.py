"""Group-by jobs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def exact(column: Column | str, scale: int, precision: int = 28) -> Column:
    """A double amount as a decimal of the caller's scale, so that sums do not depend on the order of rows."""
    return (F.col(column) if isinstance(column, str) else column).cast(f"decimal({precision},{scale})")


def daily(df: DataFrame, ts: str, item: str, amount: str) -> DataFrame:
    """Per day: different items, and sum, average, maximum and minimum of the amount.

    Null amounts are skipped. ``avg_all_rows`` divides by every row of the day, null amounts
    included. The sum has the amount's own kind: decimals stay decimals, doubles doubles. The distinct count is planned as (day, item) first, so a hot day is spread
    over its items.
    """
    total = F.sum(amount)
    return df.groupBy(F.to_date(ts).alias("dt")).agg(
        F.countDistinct(item).alias("items"),
        total.alias("sum_amount"),
        (total.cast("double") / F.count(amount)).alias("avg_amount"),
        (total.cast("double") / F.count("*")).alias("avg_all_rows"),
        F.max(amount).alias("max_amount"),
        F.min(amount).alias("min_amount"),
    )


def grouped_having(df: DataFrame, keys: list[str | Column], amount: str, more_than: int) -> DataFrame:
    """Sum and row count by several keys, for groups of more than ``more_than`` rows."""
    return (
        df.groupBy(*keys)
        .agg(F.sum(amount).alias("sum_amount"), F.count("*").alias("cnt"))
        .where(F.col("cnt") > more_than)
    )


def with_share(counts: DataFrame, num: str, total: DataFrame) -> DataFrame:
    """Add ``row_num``, the size of ``total``, and ``support`` = num / row_num to every row."""
    rows = total.agg(F.count("*")).scalar()
    return counts.withColumn("row_num", rows).withColumn(
        "support", F.col(num).cast("double") / F.col("row_num")
    )
