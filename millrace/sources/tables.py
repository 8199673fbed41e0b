"""Catalog tables: scans, parameterised queries, listings, writes."""

from __future__ import annotations

import uuid

from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.sources.files import read_export


def scan(spark: SparkSession, table: str, *columns: str) -> DataFrame:
    """A table (or view, as ``db.table`` too), all columns or some."""
    df = spark.table(table)
    return df.select(*columns) if columns else df


def scan_column(spark: SparkSession, table: str, column: str, name: str = "items") -> DataFrame:
    """One column of a table under a new name."""
    return spark.table(table).select(F.col(column).alias(name))


def query(spark: SparkSession, text: str, args: dict[str, Any] | list | None = None, **frames: DataFrame) -> DataFrame:
    """SQL text with bound parameters; ``{name}`` stands for a DataFrame given by that name."""
    return spark.sql(text, args=args, **frames)


def literal_rows(spark: SparkSession, schema: str, *rows: tuple) -> DataFrame:
    """A small table from constants."""
    return spark.createDataFrame(list(rows), schema)


def table_names(spark: SparkSession, database: str | None = None) -> list[str]:
    return [t.name for t in spark.catalog.listTables(database)]


def database_names(spark: SparkSession) -> list[str]:
    return [d.name for d in spark.catalog.listDatabases()]


def column_listing(df: DataFrame) -> list[tuple[str, str, str]]:
    """Name, type and comment of every column."""
    return [(f.name, f.dataType.simpleString(), f.metadata.get("comment", "")) for f in df.schema.fields]


def create_table(
    spark: SparkSession,
    table: str,
    columns: dict[str, str],
    comment: str = "",
    partitioned_by: list[str] | None = None,
    path: str | None = None,
) -> None:
    """An empty typed Parquet table (and its database), unless it exists."""
    if "." in table:
        spark.sql(f"CREATE DATABASE IF NOT EXISTS {table.rsplit('.', 1)[0]}")
    fields = ", ".join(f"`{name}` {kind}" for name, kind in columns.items())
    parts = f" PARTITIONED BY ({', '.join(partitioned_by)})" if partitioned_by else ""
    place = f" LOCATION '{path}'" if path else ""
    text = comment.replace("'", "\\'")
    spark.sql(f"CREATE TABLE IF NOT EXISTS {table} ({fields}) USING parquet{parts} COMMENT '{text}'{place}")


def save_table(
    df: DataFrame,
    table: str,
    mode: str = "overwrite",
    fmt: str = "parquet",
    partition_by: list[str] | None = None,
    path: str | None = None,
) -> None:
    """Save as a table; files are evened out by size first, so no partition makes tiny ones."""
    writer = df.hint("rebalance", *partition_by) if partition_by else df.hint("rebalance")
    out = writer.write.mode(mode).format(fmt)
    if partition_by:
        out = out.partitionBy(*partition_by)
    if path:
        out = out.option("path", path)
    out.saveAsTable(table)


def save_with_columns(df: DataFrame, table: str, path: str | None = None, **derived: str) -> None:
    """Replace a table by ``df`` plus derived columns, given as SQL expressions.

    The new table is written beside the old one and takes its name at the end, so ``df`` may read the
    old one and a failure leaves it as it was. With ``path`` each version has a folder of its own below it.
    """
    extra = [F.expr(text).alias(name) for name, text in derived.items()]
    mark = uuid.uuid4().hex[:12]
    fresh = f"{table}_{mark}"
    save_table(df.select("*", *extra), fresh, path=f"{path}/{mark}" if path else None)
    spark = df.sparkSession
    spark.sql(f"DROP TABLE IF EXISTS {table}")
    spark.sql(f"ALTER TABLE {fresh} RENAME TO {table}")


def replace_rows(df: DataFrame, table: str) -> None:
    """Replace the rows of an existing table; its schema stays."""
    df.select(*df.sparkSession.table(table).columns).write.insertInto(table, overwrite=True)


def load_file(spark: SparkSession, path: str, table: str, sep: str = "\t") -> None:
    """Read a delimited file by the table's own schema and replace the table's rows."""
    replace_rows(read_export(spark, path, spark.table(table).schema, sep), table)


def publish_view(df: DataFrame, name: str, across_sessions: bool = False) -> str:
    """Name a DataFrame for SQL; returns the name to use in queries."""
    if across_sessions:
        df.createOrReplaceGlobalTempView(name)
        return f"global_temp.{name}"
    df.createOrReplaceTempView(name)
    return name
