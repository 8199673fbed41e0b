"""Joins and set operations.

Left to themselves, equi joins are planned by size and re-planned at run time; a hot key in
a shuffled join is split by adaptive skew handling. The functions here add only what the
planner cannot know.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MAX_BROADCAST_ROWS = 200_000
MAX_BROADCAST_BYTES = 64 * 1024 * 1024


def fits_broadcast(
    df: DataFrame, max_rows: int = MAX_BROADCAST_ROWS, max_bytes: int = MAX_BROADCAST_BYTES
) -> bool:
    """Whether a side is small enough for every executor.

    The planner's estimate answers for a clearly large side without a job; else each task counts its rows and
    their bytes, and only these two numbers are shuffled.
    """
    plan = df._jdf.queryExecution().optimizedPlan()
    # The estimate of a join is the product of its sides; it says nothing.
    if "Join" not in plan.toString() and plan.stats().sizeInBytes() > 64 * max_bytes:
        return False
    size = F.octet_length(F.to_json(F.struct(*(F.col(f"`{c}`") for c in df.columns))))
    rows, width = df.agg(F.count("*"), F.coalesce(F.sum(size), F.lit(0))).head()
    return rows <= max_rows and width <= max_bytes


def lookup_join(
    big: DataFrame, small: DataFrame, on: list[str], how: str = "inner", max_rows: int = MAX_BROADCAST_ROWS
) -> DataFrame:
    """Join without moving ``big`` while the other side is small enough; else a shuffled join."""
    if fits_broadcast(small, max_rows):
        small = F.broadcast(small)
    return big.join(small, on, how)


FILTER_BITS = 1 << 24


def _bit(df: DataFrame, on: list[str], bits: int) -> Column:
    """The place of a row's key in a bitmap, from 1. A key of -0.0 is that of 0.0."""
    kinds = dict(df.dtypes)
    keys = [F.col(f"`{c}`") + F.lit(0.0).cast(kinds[c]) if kinds[c] in ("double", "float") else F.col(f"`{c}`") for c in on]
    return F.pmod(F.xxhash64(*keys), F.lit(bits)) + 1


def possible_matches(big: DataFrame, small: DataFrame, on: list[str], bits: int = FILTER_BITS) -> DataFrame:
    """The rows of ``big`` whose key may be in ``small``: all that are, and of the others about the share of bits set.

    The keys of ``small`` become a bitmap of ``bits`` bits, built in parts by all tasks. It is broadcast, ``bits / 8``
    bytes (2 MB by default) however large either side is, and ``big`` is filtered where it is read. Rows with a null in
    the key match nothing and go. Keys must be of one type on both sides, as their hashes are compared.
    """
    kinds = dict(big.dtypes), dict(small.dtypes)
    if any(kinds[0][c] != kinds[1][c] for c in on):
        raise ValueError("the keys must have the same type on both sides")
    known = [F.col(f"`{c}`").isNotNull() for c in on]
    for condition in known:
        big, small = big.where(condition), small.where(condition)
    place = _bit(small, on, bits)
    maps = small.groupBy(F.bitmap_bucket_number(place).alias("_part")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(place)).alias("_map"))
    placed = big.withColumn("_place", _bit(big, on, bits))
    part, bit = F.bitmap_bucket_number("_place"), F.bitmap_bit_position("_place")
    byte = F.conv(F.hex(F.substring(F.col("_map"), F.floor(bit / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    is_set = byte.bitwiseAND(F.expr("shiftleft(1, cast(bitmap_bit_position(_place) % 8 AS int))")) != 0
    return placed.join(F.broadcast(maps), part == F.col("_part")).where(is_set).select(*big.columns)


def reduced_join(big: DataFrame, small: DataFrame, on: list[str], how: str = "inner", bits: int = FILTER_BITS) -> DataFrame:
    """An inner or left semi join of two large sides of which one has few keys of the other: ``big`` is shuffled only
    where ``possible_matches`` leaves it. Between a broadcast, which ``small`` is too large for, and a full shuffle."""
    if how not in ("inner", "left_semi"):
        raise ValueError("rows that match nothing are taken out: inner and left_semi joins only")
    return possible_matches(big, small, on, bits).join(small.hint("merge"), on, how)


def shuffled_join(left: DataFrame, right: DataFrame, on: list[str], how: str = "inner") -> DataFrame:
    """Sort-merge join on both sides' keys."""
    return left.join(right.hint("merge"), on, how)


def without_groups(df: DataFrame, bad: DataFrame, keys: list[str]) -> DataFrame:
    """Drop every group that has a row in ``bad``."""
    return df.join(bad.select(*keys).distinct(), keys, "left_anti")


def contains_all(haystack: Column | str, needles: Column | str) -> Column:
    """Whether every element of ``needles`` is in ``haystack``."""
    return F.size(F.array_except(needles, haystack)) == 0
