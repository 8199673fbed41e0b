"""Streaming sources, and outputs that a repeated batch cannot spoil."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from millrace.operators.upsert import latest
from millrace.session import delete_path, list_names, new_path


def file_stream(
    spark: SparkSession, path: str, schema: str | None = None, fmt: str = "parquet", files_per_batch: int = 1_000
) -> DataFrame:
    """New files below ``path`` as a stream; a path that is one file is a stream of that file."""
    batch = spark.read.format(fmt)
    sample = (batch.schema(schema) if schema else batch).load(path)
    first = sample.select("_metadata.file_path").head()
    reader = spark.readStream.format(fmt).schema(sample.schema).option("maxFilesPerTrigger", files_per_batch)
    folder, _, name = path.rstrip("/").rpartition("/")
    if first is not None and first[0].rstrip("/").endswith(f"/{name}"):
        return reader.option("pathGlobFilter", name).load(folder)
    return reader.load(path)


def socket_stream(spark: SparkSession, host: str, port: int) -> DataFrame:
    """Lines from a socket, column ``value``; for trying things out."""
    return spark.readStream.format("socket").option("host", host).option("port", port).load()


def kafka_stream(spark: SparkSession, options: dict[str, str]) -> DataFrame:
    """Messages as ``(key, value)`` text; options from ``connectors.kafka_options``."""
    raw = spark.readStream.format("kafka").options(**options).load()
    return raw.select(F.col("key").cast("string"), F.col("value").cast("string"))


class BatchLog:
    """A table of results by micro-batch, one folder each.

    A batch that runs again after a failure replaces its own folder, so nothing is counted
    twice. ``current`` reads a table of which every batch wrote only the rows that changed.
    """

    def __init__(self, spark: SparkSession, schema: str, path: str | None = None, label: str = "stream") -> None:
        self.spark, self.path = spark, path or new_path(spark, label)
        self.schema = schema
        self.put(spark.createDataFrame([], schema), -1)

    def put(self, rows: DataFrame, batch_id: int) -> None:
        rows.write.mode("overwrite").parquet(f"{self.path}/batch_id={batch_id}")

    def rows(self) -> DataFrame:
        """All rows with their ``batch_id``."""
        return self.spark.read.schema(f"{self.schema}, batch_id long").parquet(self.path)

    def current(self, keys: list[str]) -> DataFrame:
        """The last row of every key."""
        return latest(self.rows(), keys, ["batch_id"]).drop("batch_id")


class SnapshotLog(BatchLog):
    """A table by key of which every batch writes only the rows that changed, merged level by level.

    A batch is a run of its own. Whenever the last ``fan`` runs are of one level they become one run of the next,
    which keeps the last row per key. So after n batches there are at most ``fan - 1`` runs a level and log n levels,
    and a row is written again once a level. ``head/batch_id=<n>`` lists the runs that make up the table after batch n;
    it is written last. A batch that runs again starts from the head before it and replaces what it wrote. Runs that no
    head needs any more go when the batch after them begins: by then no batch before can run again.
    """

    HEADS = "level int, first long, last long"

    def __init__(self, spark: SparkSession, schema: str, keys: list[str], path: str | None = None, label: str = "stream", fan: int = 8) -> None:
        if fan < 2:
            raise ValueError("runs merge by two or more")
        self.spark, self.path = spark, path or new_path(spark, label)
        self.schema, self.keys, self.fan = schema, keys, fan

    def _head(self, before: int | None = None) -> tuple[int, list[tuple[int, int, int]]]:
        """(batch, runs as level, first and last batch) of the last head, or the last one before a batch."""
        names = list_names(self.spark, f"{self.path}/head")
        batches = [int(n.removeprefix("batch_id=")) for n in names if n.startswith("batch_id=")]
        batches = [b for b in sorted(batches, reverse=True) if before is None or b < before]
        for batch in batches:
            folder = f"{self.path}/head/batch_id={batch}"
            if "_SUCCESS" in list_names(self.spark, folder):
                rows = self.spark.read.schema(self.HEADS).parquet(folder).collect()
                return batch, sorted((r["level"], r["first"], r["last"]) for r in rows)
        return -1, []

    def _folder(self, run: tuple[int, int, int]) -> str:
        level, first, last = run
        return f"{self.path}/level={level}/run={first}-{last}"

    def _read(self, runs: list[tuple[int, int, int]]) -> DataFrame:
        schema = f"{self.schema}, batch_id long"
        if not runs:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(*(self._folder(r) for r in runs))

    def runs(self) -> list[tuple[int, int, int]]:
        """What a reader opens: (level, first batch, last batch)."""
        return self._head()[1]

    def put(self, rows: DataFrame, batch_id: int) -> None:
        # Readers fall back to the head before while the batch is written again.
        delete_path(self.spark, f"{self.path}/head/batch_id={batch_id}")
        before, runs = self._head(batch_id)
        self._expire(before, runs)
        runs = sorted(runs, key=lambda r: r[1])
        new = (0, batch_id, batch_id)
        rows.withColumn("batch_id", F.lit(batch_id).cast("long")).write.mode("overwrite").parquet(self._folder(new))
        runs.append(new)
        while len(runs) >= self.fan and len({r[0] for r in runs[-self.fan :]}) == 1:
            merging = runs[-self.fan :]
            bigger = (merging[0][0] + 1, merging[0][1], merging[-1][2])
            latest(self._read(merging), self.keys, ["batch_id"]).write.mode("overwrite").parquet(self._folder(bigger))
            runs[-self.fan :] = [bigger]
        head = self.spark.createDataFrame(runs, self.HEADS)
        head.coalesce(1).write.mode("overwrite").parquet(f"{self.path}/head/batch_id={batch_id}")

    def _expire(self, batch: int, runs: list[tuple[int, int, int]]) -> None:
        """Delete heads and runs from before ``batch`` that its head doesn't need."""
        for name in list_names(self.spark, f"{self.path}/head"):
            if name.startswith("batch_id=") and int(name.removeprefix("batch_id=")) < batch:
                delete_path(self.spark, f"{self.path}/head/{name}")
        for level in list_names(self.spark, self.path):
            if not level.startswith("level="):
                continue
            for name in list_names(self.spark, f"{self.path}/{level}"):
                first, last = (int(x) for x in name.removeprefix("run=").split("-"))
                if last <= batch and (int(level.removeprefix("level=")), first, last) not in runs:
                    delete_path(self.spark, f"{self.path}/{level}/{name}")

    def rows(self) -> DataFrame:
        """The rows of the runs in use, with their ``batch_id``: of a key that changed often not all are left."""
        return self._read(self.runs())

    def current(self, keys: list[str] | None = None) -> DataFrame:
        if keys is not None and keys != self.keys:
            raise ValueError(f"this table is kept by {self.keys}")
        return super().current(self.keys)


def run_available(
    stream: DataFrame,
    each: Callable[[DataFrame, int], None],
    mode: str = "append",
    checkpoint: str | None = None,
) -> StreamingQuery:
    """Process what there is, batch by batch, and stop after the last one."""
    query = (
        stream.writeStream.outputMode(mode)
        .foreachBatch(each)
        .option("checkpointLocation", checkpoint or new_path(stream.sparkSession, "checkpoint"))
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    return query


def start(
    stream: DataFrame, each: Callable[[DataFrame, int], None], checkpoint: str, every: str = "1 second", mode: str = "append"
) -> StreamingQuery:
    """Run without end, a batch every so often; starting again goes on from ``checkpoint``."""
    writer = stream.writeStream.outputMode(mode).foreachBatch(each)
    return writer.option("checkpointLocation", checkpoint).trigger(processingTime=every).start()


def to_console(table: DataFrame, mode: str = "complete") -> StreamingQuery:
    """Print the running table after every batch."""
    return table.writeStream.outputMode(mode).format("console").start()
