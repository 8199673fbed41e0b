"""A multi-line query log to one row per query, numbered in scan order: no line is sorted, only real queries' text moves.

Two passes over the files. The first counts, per block (one split of a file), how many groups start in it and of what
kind the last one is; a running total over these few rows says where each block's numbering starts and which group its
first lines continue. The second goes through the lines as the scan hands them out, numbers the groups inside a block
and folds each into one row; groups that are noise go right there. What is shuffled is one row per query and block.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from millrace.operators.logs import NOISE, classify, completions

FOLDED = "source string, file string, start long, local long, query_id string, start_time string, user string, text string, noisy boolean"


def read_blocks(spark: SparkSession, path: str, line_sep: str = "\n") -> DataFrame:
    """Lines of text files as ``(source, file, start, line)``: a log, a file of it, where a split of that file starts.

    The source is the partition folder ``source=…`` where the files lie in such, its files in order of their names; else
    every file is a source. A block is read by one task, in order.
    """
    read = spark.read.option("lineSep", line_sep).text(path)
    file = F.col("_metadata.file_path")
    source = F.col("source").cast("string") if "source" in read.columns else file
    return read.select(source.alias("source"), file.alias("file"), F.col("_metadata.file_block_start").alias("start"), F.col("value").alias("line"))


def block_totals(lines: DataFrame) -> DataFrame:
    """``(source, file, start, earlier, opener)``: groups before a block, and the kind of the line that opened the last of them."""
    seen = classify(lines).select("source", "file", "start", "starts", "kind", F.monotonically_increasing_id().alias("seq"))
    opens = F.coalesce(F.col("starts"), F.lit(False))
    counted = seen.groupBy("source", "file", "start").agg(
        F.count_if(opens).alias("n"), F.max_by(F.when(opens, F.col("kind")), F.when(opens, F.col("seq"))).alias("last")
    )
    before = Window.partitionBy("source").orderBy("file", "start").rowsBetween(Window.unboundedPreceding, -1)
    return counted.select(
        "source", "file", "start",
        F.coalesce(F.sum("n").over(before), F.lit(0)).alias("earlier"),
        F.last("last", ignorenulls=True).over(before).alias("opener"),
    )


def folded(lines: DataFrame) -> DataFrame:
    """One row per block and group that isn't noise by its first line there; ``local`` is the group's number in the block,
    0 for lines that go on with a group of an earlier block."""
    narrow = classify(lines).select(
        "source", "file", "start", F.coalesce("starts", F.lit(False)).alias("starts"), "kind", "query_id", "start_time", "user",
        F.trim("text").alias("text"),
    )

    def work(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group = _Group(None, 0, False)
        for batch in stream:
            block = list(zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True))
            starts = batch.column(3).to_numpy(zero_copy_only=False)
            kinds, texts = batch.column(4).to_pylist(), batch.column(8).to_pylist()
            noisy = np.isin(np.array(kinds, dtype=object), NOISE)
            new_block = np.array([i == 0 or block[i] != block[i - 1] for i in range(len(block))], dtype=bool)
            heads = np.flatnonzero(starts | new_block)
            done = []
            for begin, end in zip([0, *heads], [*heads, len(block)], strict=True):
                if begin == end:
                    continue
                if block[begin] != group.block:
                    done.append(group)
                    group = _Group(block[begin], 0, False)
                if starts[begin]:
                    done.append(group)
                    group = _Group(block[begin], group.local + 1, bool(noisy[begin]))
                    group.facts = tuple(batch.column(i)[int(begin)].as_py() for i in (5, 6, 7))
                group.add(texts[begin:end], bool(noisy[begin:end].any()))
            yield _rows(done)
        yield _rows([group])

    return narrow.mapInArrow(work, FOLDED)


class _Group:
    """A group of lines inside a block. One that its first line shows to be noise keeps no text."""

    def __init__(self, block: tuple | None, local: int, dropped: bool) -> None:
        self.block, self.local, self.dropped = block, local, dropped
        self.facts: tuple = (None, None, None)
        self.texts: list[str] = []
        self.noisy = self.lines = False

    def add(self, texts: list[str | None], noisy: bool) -> None:
        self.lines = True
        self.noisy |= noisy
        if not self.dropped:
            self.texts += [t for t in texts if t is not None]


def _rows(groups: list[_Group]) -> pa.RecordBatch:
    kept = [g for g in groups if g.lines and not g.dropped]
    rows = [(*g.block, g.local, *g.facts, " ".join(g.texts) if g.texts else None, g.noisy) for g in kept]
    columns = zip(*rows, strict=True) if rows else [[]] * 9
    kinds = [pa.string(), pa.string(), pa.int64(), pa.int64(), *[pa.string()] * 4, pa.bool_()]
    names = ["source", "file", "start", "local", "query_id", "start_time", "user", "text", "noisy"]
    return pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(columns, kinds, strict=True)], names=names)


def sessions(lines: DataFrame) -> DataFrame:
    """Rows ``(source, id, query_id, start_time, end_time, duration, user, query_str)``, as ``logs.sessions`` has them.

    ``lines`` is what ``read_blocks`` returns, or a selection of its rows that keeps their order: nothing between the
    scan and this may shuffle. A group over several blocks is put together from one text per block.
    """
    placed = folded(lines).join(block_totals(lines), ["source", "file", "start"])
    # Lines that go on with a group of an earlier block are noise if that group is.
    placed = placed.where((F.col("local") > 0) | F.col("opener").isNull() | ~F.col("opener").isin(NOISE))
    ordered = F.array_sort(F.collect_list(F.when(F.col("text").isNotNull(), F.struct("file", "start", "text"))))
    queries = (
        placed.groupBy("source", (F.col("earlier") + F.col("local")).alias("id"))
        .agg(
            F.max("query_id").alias("query_id"),
            F.max("start_time").alias("start_time"),
            F.max("user").alias("user"),
            F.array_join(F.transform(ordered, lambda part: part["text"]), " ").alias("query_str"),
            F.bool_or("noisy").alias("_noisy"),
        )
        .where(~F.col("_noisy"))
    )
    return queries.join(completions(lines), "query_id", "left").select(
        "source", "id", "query_id", "start_time", "end_time", "duration", "user", "query_str"
    )
