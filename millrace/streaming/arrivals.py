"""Numbering every arrival of a key: x x x gives 1, 2, 3.

Each batch numbers its own rows and adds how many there were before. Rows of one key may
be a large part of a batch, so they are numbered range by range, never as one group. What
is kept between batches is one small table of counts per batch, folded into a total from
time to time.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.operators.ranking import row_numbers
from millrace.streaming.sources import BatchLog, run_available

FOLD_EVERY = 50


class Arrivals:
    """Numbers arrivals per key into ``out``; ``forget`` says from its total when a key starts anew."""

    def __init__(
        self,
        key: str,
        order: list[str],
        out: BatchLog,
        counts: BatchLog,
        totals: BatchLog,
        forget: Callable[[Column], Column] | None = None,
    ) -> None:
        self.key, self.order, self.forget = key, order, forget
        self.out, self.counts, self.totals = out, counts, totals

    def _total(self, folded: int, until: int) -> DataFrame:
        """Arrivals per key: the total folded at one batch and the counts after it, up to another."""
        base = self.totals.rows().where(F.col("batch_id") == folded)
        since = self.counts.rows().where((F.col("batch_id") > folded) & (F.col("batch_id") <= until))
        return base.unionByName(since).groupBy(self.key).agg(F.sum("n").alias("n")).where("n > 0")

    def each(self, batch: DataFrame, batch_id: int) -> None:
        earlier = self._total(batch_id // FOLD_EVERY * FOLD_EVERY - 1, batch_id - 1).select(self.key, F.col("n").alias("_earlier"))
        numbered = row_numbers(batch, [self.key], self.order, "_rn").join(earlier, self.key, "left")
        so_far = F.col("_rn") + F.coalesce("_earlier", F.lit(0))
        self.out.put(numbered.withColumn("n", so_far.cast("long")).drop("_rn", "_earlier"), batch_id)

        grown = batch.groupBy(self.key).agg(F.count("*").alias("n"))
        if self.forget is not None:
            joined = grown.join(earlier, self.key, "left").withColumn("_earlier", F.coalesce("_earlier", F.lit(0)))
            gone = self.forget(F.col("n") + F.col("_earlier"))
            grown = joined.select(self.key, F.when(gone, -F.col("_earlier")).otherwise(F.col("n")).alias("n"))
        self.counts.put(grown, batch_id)
        if batch_id % FOLD_EVERY == FOLD_EVERY - 1:
            self.totals.put(self._total(batch_id - FOLD_EVERY, batch_id), batch_id)

    def run(self, stream: DataFrame, checkpoint: str | None = None) -> DataFrame:
        run_available(stream, self.each, checkpoint=checkpoint)
        return self.out.rows()
