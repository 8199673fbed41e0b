"""The aggregates of ``aggregates`` under names that SQL knows.

SQL functions of Spark cannot hold aggregates, so these run in Python on Arrow batches. They take all values of a group
to one task and hold them there: they are for SQL texts over groups of moderate size. Of large groups, sums are taken in
two steps, of ``slices`` and of their sums. The built-in compositions of ``aggregates`` combine before the shuffle.
"""

from __future__ import annotations

import re

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SLICES = 16

# What SQL reads as a number in a text.
NUMBER = re.compile(r"\s*[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?[dDfF]?\s*")


def _doubles(values: pa.Array) -> pa.Array:
    """Doubles of numbers, texts (unreadable ones are null) and timestamps (seconds); other kinds are refused."""
    kind = values.type
    if pa.types.is_string(kind) or pa.types.is_large_string(kind):
        return pa.array([float(v.strip().rstrip("dDfF")) if v is not None and NUMBER.fullmatch(v) else None for v in values.to_pylist()], pa.float64())
    if pa.types.is_timestamp(kind):
        return pc.divide(values.cast(pa.timestamp("us", kind.tz)).cast(pa.int64()).cast(pa.float64(), safe=False), 1e6)
    if pa.types.is_integer(kind) or pa.types.is_floating(kind) or pa.types.is_decimal(kind):
        return values.cast(pa.float64(), safe=False)
    raise TypeError("sum_value takes numbers, strings or timestamps")


def register_aggregates(spark: SparkSession) -> None:
    """Create ``sum_value`` (double), ``sum_value_long`` (exact, whole numbers), ``max_length_value`` and
    ``map_of(key, value, place)`` (texts; of several values of a key the last by place) in this session.

    Nulls are left out; a group without anything else gives null, of ``map_of`` an empty map.
    """

    @F.arrow_udf("double")
    def sum_value(values: pa.Array) -> float:
        return pc.sum(_doubles(values)).as_py()

    @F.arrow_udf("bigint")
    def sum_value_long(values: pa.Array) -> int:
        if not pa.types.is_integer(values.type):
            raise TypeError("sum_value_long takes whole numbers")
        found = values.drop_null()
        return int(pc.sum(found.cast(pa.decimal128(38, 0))).as_py()) if len(found) else None

    @F.arrow_udf("string")
    def max_length_value(values: pa.Array) -> str:
        return min(values.drop_null().to_pylist(), key=lambda v: (-len(v), v), default=None)

    @F.arrow_udf("map<string,string>")
    def map_of(keys: pa.Array, values: pa.Array, places: pa.Array) -> pa.MapScalar:
        found: dict = {}
        for key, value, place in zip(keys.to_pylist(), values.to_pylist(), places.to_pylist(), strict=True):
            if key is not None and (key not in found or place >= found[key][0]):
                found[key] = (place, value)
        return pa.scalar([(key, found[key][1]) for key in sorted(found)], pa.map_(pa.string(), pa.string()))

    for function in (sum_value, sum_value_long, max_length_value, map_of):
        spark.udf.register(function.__name__, function)


def slices(df: DataFrame, *columns: str) -> DataFrame:
    """``df`` with a column ``slice``: of the rows that a task reads, ``SLICES`` parts by a hash of ``columns``.

    Grouped by its keys and ``slice`` first, a large group is many groups, each no more than what one task reads.
    """
    part = F.pmod(F.xxhash64(*columns), F.lit(SLICES))
    return df.withColumn("slice", F.struct(F.spark_partition_id().alias("task"), part.alias("part")))
