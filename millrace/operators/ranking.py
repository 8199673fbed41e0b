"""Top-N, ordering inside keys, and row numbers that do not need a whole key in one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.session import written


def top(df: DataFrame, order: list[Column], n: int) -> DataFrame:
    """The first ``n`` rows of the whole table: every task keeps ``n``, then they are merged."""
    return df.orderBy(*order).limit(n)


def top_per_group(df: DataFrame, keys: list[str], order: list[Column], n: int, rank: str = "rn") -> DataFrame:
    """The first ``n`` rows of every group, numbered.

    The rank filter is pushed below the shuffle, so a hot group arrives as ``n`` rows per task.
    """
    number = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn(rank, number).where(F.col(rank) <= n)


def secondary_sort(df: DataFrame, keys: list[str], order: list[str], partitions: int | None = None) -> DataFrame:
    """Rows with all values of a key in ``order``, and the keys themselves in order.

    Ranges are cut over keys and values together: one key may span several partitions, in
    order, so a key with a third of all rows is a third of the partitions and not one task.
    """
    columns = [*keys, *order]
    ranged = df.repartitionByRange(partitions, *columns) if partitions else df.repartitionByRange(*columns)
    return ranged.sortWithinPartitions(*columns)


def stored_ranges(df: DataFrame, order: list[str], name: str, partitions: int | None = None) -> DataFrame:
    """``df`` cut into ranges over ``order``, written with the number of the range in ``name``.

    The numbers grow with the order. Written, because a range must keep its rows whatever is
    computed again. ``partitions`` fixes the number of ranges; else there are at most
    ``spark.sql.shuffle.partitions``, and small neighbours are joined at run time.
    """
    ranged = df.repartitionByRange(partitions, *order) if partitions else df.repartitionByRange(*order)
    return written(ranged.withColumn(name, F.spark_partition_id()), "ranges")


def row_numbers(
    df: DataFrame, keys: list[str], order: list[str], name: str = "rn", partitions: int | None = None
) -> DataFrame:
    """Number the rows of every key by ``order``, from 1, also where one key is very large.

    The rows are cut into ranges over keys and order together. Each range counts its rows per
    key; a running total of these few counts is where its numbering starts. ``order`` should
    end in a unique column.
    """
    runs = stored_ranges(df, [*keys, *order], "_range", partitions)
    before = Window.partitionBy(*keys).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    starts = (
        runs.groupBy(*keys, "_range")
        .agg(F.count("*").alias("_n"))
        .select(*keys, "_range", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    )
    inside = Window.partitionBy(*keys, "_range").orderBy(*order)
    numbered = runs.withColumn("_rn", F.row_number().over(inside))
    same = [numbered[c].eqNullSafe(starts[c]) for c in [*keys, "_range"]]
    return numbered.join(starts, same, "left").select(
        *(numbered[c] for c in df.columns), (F.col("_rn") + F.col("_start")).alias(name)
    )
