"""Aggregate functions, composed from built-in aggregates so they combine on the map side."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def sum_value(df: DataFrame, name: str) -> Column:
    """Sum of a column by its declared type.

    Whole numbers add up to a long, decimals to a decimal, floats, strings and timestamps to
    a double (unreadable strings count as null). Booleans, dates, binary and nested types
    have no sum and are refused before the job starts.
    """
    kind = df.schema[name].dataType
    if isinstance(kind, (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.DecimalType)):
        return F.sum(name)
    if isinstance(kind, (T.FloatType, T.DoubleType)):
        return F.sum(F.col(name).cast("double"))
    if isinstance(kind, (T.StringType, T.VarcharType, T.CharType)):
        return F.sum(F.col(name).try_cast("double"))
    if isinstance(kind, (T.TimestampType, T.TimestampNTZType)):
        return F.sum(F.col(name).cast("timestamp").cast("double"))
    raise TypeError(f"sum_value takes numbers, strings or timestamps; {name} is {kind.simpleString()}")


def max_length_value(column: Column | str) -> Column:
    """The longest string; of several equally long ones the smallest."""
    value = F.col(column) if isinstance(column, str) else column
    return F.min_by(value, F.when(value.isNotNull(), F.struct(-F.length(value), value)))


def map_of(df: DataFrame, group: list[str], key: str, value: str, order: list[str], name: str = "kv") -> DataFrame:
    """One map per group from its (key, value) rows; of several values the last by ``order``.

    The rows are first reduced to one per (group, key), with map-side combining, so a hot
    group reaches the second step as its different keys only. Null keys are left out.
    """
    latest = (
        df.where(F.col(key).isNotNull())
        .groupBy(*group, key)
        .agg(F.max_by(F.struct(F.col(value).alias("v")), F.struct(*order, value)).alias("_last"))
    )
    pairs = F.collect_list(F.struct(F.col(key), F.col("_last.v")))
    return latest.groupBy(*group).agg(F.map_from_entries(F.array_sort(pairs)).alias(name))
