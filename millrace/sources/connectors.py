"""Connectors by format name: key-value, columnar, search, lake and message stores.

Their jars come with the deployment; here is only what to ask of Spark.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read(spark: SparkSession, fmt: str, path: str | None = None, **options: str) -> DataFrame:
    return spark.read.format(fmt).options(**options).load(path)


def write(df: DataFrame, fmt: str, path: str | None = None, mode: str = "append", **options: str) -> None:
    df.write.format(fmt).options(**options).mode(mode).save(path)


def search_options(hosts: str, collection: str, query: str = "*:*", fields: str = "", filters: str = "") -> dict:
    """Options of a search index scan."""
    options = {"zkhost": hosts, "collection": collection, "query": query}
    options |= {"fields": fields} if fields else {}
    return options | ({"filters": filters} if filters else {})


def kafka_options(
    servers: str, topics: Iterable[str], starts: dict[str, dict[int, int]] | None = None, earliest: bool = False
) -> dict[str, str]:
    """Options to read topics from given offsets per partition, else from the latest or earliest."""
    options = {"kafka.bootstrap.servers": servers, "subscribe": ",".join(topics)}
    if starts:
        options["startingOffsets"] = json.dumps({t: {str(p): o for p, o in s.items()} for t, s in starts.items()})
    else:
        options["startingOffsets"] = "earliest" if earliest else "latest"
    return options


def as_messages(df: DataFrame, key: str | None = None) -> DataFrame:
    """Rows as messages ``(key, value)``, the value as JSON."""
    value = F.to_json(F.struct(*(F.col(f"`{c}`") for c in df.columns))).alias("value")
    return df.select(F.col(key).cast("string").alias("key"), value) if key else df.select(value)


def documents(df: DataFrame, fields: dict[str, str] | None = None) -> DataFrame:
    """One JSON document per row, column ``doc``; ``fields`` maps columns to field names."""
    fields = fields or {c: c for c in df.columns}
    return df.select(F.to_json(F.struct(*(F.col(f"`{c}`").alias(n) for c, n in fields.items()))).alias("doc"))


def add_envelopes(df: DataFrame, overwrite: bool = True) -> DataFrame:
    """Every row as an add command of a search index, column ``doc``."""
    doc = F.struct(*(F.col(f"`{c}`") for c in df.columns)).alias("doc")
    command = F.struct(F.struct(F.lit(overwrite).alias("overwrite"), doc).alias("add"))
    return df.select(F.to_json(command).alias("doc"))


def write_batches(docs: DataFrame, path: str, batch_size: int, writers: int | None = None) -> None:
    """Documents as files of at most ``batch_size`` lines, for a loader that takes batches.

    ``writers`` bounds how many are written at a time, to go easy on the receiver.
    """
    few = docs.repartition(writers) if writers else docs
    few.write.mode("overwrite").option("maxRecordsPerFile", batch_size).text(path)


def push_batches(
    docs: DataFrame, send: Callable[[list[str]], None], batch_size: int, writers: int | None = None
) -> None:
    """Hand documents to ``send`` in batches, the last one short, from every task.

    A task that is run again sends again: documents need an id that the receiver overwrites by.
    """

    def drain(rows: Iterable) -> None:
        batch: list[str] = []
        for row in rows:
            batch.append(row[0])
            if len(batch) == batch_size:
                send(batch)
                batch = []
        if batch:
            send(batch)

    (docs.repartition(writers) if writers else docs).foreachPartition(drain)
