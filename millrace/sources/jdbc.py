"""JDBC tables and queries, both directions."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from millrace.sources.schema import flat_for_sink

BATCH_ROWS = 1_000_000


def table_options(
    url: str,
    table: str,
    driver: str | None = None,
    user: str | None = None,
    password: str | None = None,
    split_by: tuple[str, str, str, int] | None = None,
    fetch_rows: int = 10_000,
) -> dict[str, str]:
    """Options to read a table; ``split_by`` = (column, lower, upper, parts) reads it in parallel."""
    options = {"url": url, "dbtable": table, "driver": driver, "user": user, "password": password}
    options["fetchsize"] = str(fetch_rows)
    if split_by:
        column, lower, upper, parts = split_by
        options |= {
            "partitionColumn": column,
            "lowerBound": str(lower),
            "upperBound": str(upper),
            "numPartitions": str(parts),
        }
    return {key: value for key, value in options.items() if value is not None}


def query_options(url: str, query: str, **login: str | None) -> dict[str, str]:
    """Options to run a query on the other side and read its result, in parallel with ``split_by``."""
    if login.get("split_by"):  # only a table expression can be split
        return table_options(url, f"({query}) t", **login)
    options = table_options(url, "", **login)
    del options["dbtable"]
    return options | {"query": query}


def read(spark: SparkSession, options: dict[str, str]) -> DataFrame:
    """Filters, columns, limits and simple aggregates on the result are pushed to the database."""
    return spark.read.format("jdbc").options(**options).load()


def append(
    df: DataFrame,
    options: dict[str, str],
    writers: int | None = None,
    batch_rows: int = 1_000,
    fmt: str = "jdbc",
) -> int:
    """Append rows in batches over ``writers`` connections; returns the number of rows.

    Rows are counted while they are written, not by a second pass. ``fmt`` is for stores
    with a connector of their own.
    """
    seen = Observation()
    rows = df.repartition(writers) if writers else df
    counted = rows.observe(seen, F.count(F.lit(1)).alias("rows"))
    counted.write.format(fmt).options(**options, batchsize=str(batch_rows)).mode("append").save()
    return int(seen.get["rows"])


def append_olap(df: DataFrame, options: dict[str, str], writers: int | None = None) -> int:
    """Append to an OLAP table, nested columns as strings, in very large batches.

    Create the table first with ``schema.olap_ddl``; a table Spark creates itself gets the
    same engine and order, but Spark's own column types.
    """
    create = {"createTableOptions": f"ENGINE=MergeTree() ORDER BY ({df.columns[0]})"}
    return append(flat_for_sink(df), create | options, writers, BATCH_ROWS)
