"""A multi-line query log to one row per query.

Every line that names a level (INFO, WARN, ERROR) starts a new group; lines without one
continue the group they follow. The number of a line's group is a running count of such
lines along the file. To count along a file of any size, lines come in blocks: each block
is numbered by itself, and the blocks of a file pass on a running total of a few numbers.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

# Texts that mark a line.
COMPILING = "Compiling command"
EXECUTING = "Executing command"
COMPLETED = "Completed compiling command"
TIME_WIDTH = 23
NOISE = ["executing", "info", "problem"]


def read_log(spark: SparkSession, path: str) -> DataFrame:
    """Lines of text files with their place: file, split of the file (the block), order in it."""
    return spark.read.text(path).select(
        F.col("_metadata.file_path").alias("source"),
        F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("seq"),
        F.col("value").alias("line"),
    )


def classify(lines: DataFrame) -> DataFrame:
    """Add what kind of line it is and the fields a compile line holds."""
    line = F.col("line")
    level = line.contains("INFO") | line.contains("WARN") | line.contains("ERROR")
    compiling = line.contains(COMPILING)
    kind = (
        F.when(compiling, "compiling")
        .when(line.contains(EXECUTING), "executing")
        .when(line.contains("INFO"), "info")
        .when(level, "problem")
        .otherwise("continued")
    )
    return (
        lines.withColumn("starts", level)
        .withColumn("kind", kind)
        .withColumn("query_id", F.when(compiling, F.regexp_extract("line", r"queryId=(.*)\):", 1)))
        .withColumn("start_time", F.when(compiling, F.substring("line", 1, TIME_WIDTH)))
        .withColumn("user", F.when(compiling, F.regexp_extract("line", "queryId=(.*)_20", 1)))
        .withColumn(
            "text",
            F.when(compiling, line.substr(F.locate("): ", line) + 3, F.length(line)))
            .when(F.col("kind") == "continued", line),
        )
    )


def with_groups(lines: DataFrame) -> DataFrame:
    """Number the groups along every source, and tell each line the kind of its group's first line."""
    along = Window.partitionBy("source", "block").orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)
    opener = F.when(F.col("starts"), F.col("kind"))
    inside = lines.withColumn("_starts", F.count_if("starts").over(along)).withColumn(
        "_opener", F.last(opener, ignorenulls=True).over(along)
    )

    before = Window.partitionBy("source").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    carried = (
        lines.groupBy("source", "block")
        .agg(F.count_if("starts").alias("_n"), F.max_by(opener, F.when(F.col("starts"), F.col("seq"))).alias("_last"))
        .select(
            "source",
            "block",
            F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_earlier"),
            F.last("_last", ignorenulls=True).over(before).alias("_from_before"),
        )
    )
    return inside.join(carried, ["source", "block"]).select(
        *lines.columns,
        (F.col("_starts") + F.col("_earlier")).alias("id"),
        F.coalesce("_opener", "_from_before").alias("opened_by"),
    )


def completions(lines: DataFrame) -> DataFrame:
    """Completion records: query id, end time and seconds taken."""
    done = lines.where(F.col("line").contains(COMPLETED))
    return done.select(
        F.regexp_extract("line", r"queryId=(.*)\);", 1).alias("query_id"),
        F.substring("line", 1, TIME_WIDTH).alias("end_time"),
        F.regexp_extract("line", "Time taken: (.*) seconds", 1).alias("duration"),
    )


def sessions(lines: DataFrame) -> DataFrame:
    """Rows ``(source, id, query_id, start_time, end_time, duration, user, query_str)``.

    ``lines`` has source, block, seq and line; block and seq order the lines of a source.
    Groups with any noise line are dropped. Most of them are recognised by their first line
    and leave before the shuffle; only the lines of real queries are brought together.
    """
    grouped = with_groups(classify(lines))
    noisy = F.col("kind").isin(NOISE)
    kept = grouped.where(F.col("opened_by").isNull() | ~F.col("opened_by").isin(NOISE))
    ordered = F.array_sort(
        F.collect_list(F.when(F.col("text").isNotNull(), F.struct("block", "seq", F.trim("text").alias("text"))))
    )
    queries = (
        kept.groupBy("source", "id")
        .agg(
            F.max("query_id").alias("query_id"),
            F.max("start_time").alias("start_time"),
            F.max("user").alias("user"),
            F.array_join(F.transform(ordered, lambda part: part["text"]), " ").alias("query_str"),
            F.bool_or(noisy).alias("_noisy"),
        )
        .where(~F.col("_noisy"))
    )
    return queries.join(completions(lines), "query_id", "left").select(
        "source", "id", "query_id", "start_time", "end_time", "duration", "user", "query_str"
    )
