"""Wide rows to key-value cells and back."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.sources.schema import CellColumn, parse_cell_schema


def as_text(df: DataFrame, name: str) -> Column:
    """A column as the text a cell or a text file holds; nested values as JSON."""
    if isinstance(df.schema[name].dataType, (T.ArrayType, T.MapType, T.StructType, T.VariantType)):
        return F.to_json(F.col(f"`{name}`"))
    return F.col(f"`{name}`").cast("string")


def _key(df: DataFrame, keys: list[str], sep: str) -> Column:
    if len(keys) == 1:
        return as_text(df, keys[0])

    def part(name: str) -> Column:
        escaped = F.replace(as_text(df, name), F.lit("\\"), F.lit("\\\\"))
        return F.coalesce(F.replace(escaped, F.lit(sep), F.lit(f"\\{sep}")), F.lit("\\N"))

    return F.concat_ws(sep, *(part(k) for k in keys))


def wide_to_cells(df: DataFrame, keys: list[str] | None = None, family: str = "cf", sep: str = "") -> DataFrame:
    """Cells ``(rowkey, family, qualifier, value)`` from rows.

    The row key is the first column, or ``keys`` joined by ``sep``, which several keys must have to
    stay apart; a null part of such a key is written as ``\\N``, and a backslash stands before a separator or a backslash
    inside a part, so no two keys are written alike. Nulls make no cell. A map-only job.
    """
    keys = keys or df.columns[:1]
    if len(keys) > 1 and not sep:
        raise ValueError("several keys need a separator")
    if "\\" in sep:
        raise ValueError("a backslash can't part keys")
    values = [c for c in df.columns if c not in keys]
    text = df.select(
        _key(df, keys, sep).alias("rowkey"), *(as_text(df, v).alias(v) for v in values)
    )
    return (
        text.unpivot("rowkey", values, "qualifier", "value")
        .where(F.col("value").isNotNull())
        .select("rowkey", F.lit(family).alias("family"), "qualifier", "value")
    )


def sorted_cells(cells: DataFrame, partitions: int | None = None) -> DataFrame:
    """Cells in one total order of row key, family and qualifier, as an ordered bulk load needs.

    Ranges are cut over all three, so one huge row does not end up in one task.
    """
    order = ["rowkey", "family", "qualifier"]
    ranged = cells.repartitionByRange(partitions, *order) if partitions else cells.repartitionByRange(*order)
    return ranged.sortWithinPartitions(*order)


def typed(value: Column, column: CellColumn) -> Column:
    """Cell text as the declared type; unreadable text is null."""
    if isinstance(column.type, T.StringType):
        return value
    if isinstance(column.type, T.BinaryType):
        return value.cast("binary")
    return value.try_cast(column.type)


def cells_to_wide(cells: DataFrame, declared: str) -> DataFrame:
    """Rows from cells by a declared schema ``"rowkey:id:string; family:qualifier:type; …"``.

    Columns come out as ``family_qualifier`` in declared order, missing cells as null. Of
    several versions of a cell the one with the highest ``ts`` counts (if there is a ``ts``).
    """
    columns = parse_cell_schema(declared)
    version = [F.col("ts")] if "ts" in cells.columns else []

    def latest(column: CellColumn) -> Column:
        mine = (F.col("family") == column.family) & (F.col("qualifier") == column.qualifier)
        return F.max(F.when(mine, F.struct(*version, F.col("value"))))["value"]

    rows = cells.groupBy("rowkey").agg(*(latest(c).alias(c.name) for c in columns if not c.is_key))
    return rows.select(
        *(typed(F.col("rowkey") if c.is_key else F.col(f"`{c.name}`"), c).alias(c.name) for c in columns)
    )


def cell_columns(cells: DataFrame) -> DataFrame:
    """The families and qualifiers in use."""
    return cells.select("family", "qualifier").distinct()
