"""What several of these operators need: reading tables, splits, words, Arrow mapping."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

import millrace

# Tasks carry the code they run, so executors need not have this package on their path.
cloudpickle.register_pickle_by_value(millrace)

# A word is a run of anything but the ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
BLANKS = "\t\n\x0b\x0c\r"


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def in_fold(identity: Column | str, folds: int, fold: int) -> Column:
    """True where ``crc32`` of the id as text falls into ``fold``; also where the id is null."""
    remainder = F.pmod(F.crc32(F.col(identity).cast("string") if isinstance(identity, str) else identity), F.lit(folds))
    return F.coalesce(remainder == fold, F.lit(True))


def map_arrow(df: DataFrame, work: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.Table]], schema: str) -> DataFrame:
    """``mapInArrow`` for a function that yields tables or record batches."""

    def batches(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for out in work(stream):
            if isinstance(out, pa.Table):
                yield from out.to_batches()
            else:
                yield out

    return df.mapInArrow(batches, schema)


def texts_of(column: pa.Array) -> list[str]:
    """Python strings, null as the empty one."""
    return ["" if text is None else text for text in column.to_pylist()]


def words_of(text: str) -> list[str]:
    """The words of ``WORD``: only the six ASCII blanks part them."""
    for blank in BLANKS:
        if blank in text:
            text = text.replace(blank, " ")
    return [word for word in text.split(" ") if word]
