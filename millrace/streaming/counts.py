"""Counts over streams: per batch, running, per day and per sliding window."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from millrace.operators.ranking import top_per_group
from millrace.streaming.sources import BatchLog, run_available


def batch_counts(stream: DataFrame, key: str, log: BatchLog, checkpoint: str | None = None) -> DataFrame:
    """Counts inside every micro-batch: ``(key, count, batch_id)``; no state."""

    def each(batch: DataFrame, batch_id: int) -> None:
        log.put(batch.groupBy(key).agg(F.count("*").alias("count")), batch_id)

    run_available(stream, each, checkpoint=checkpoint)
    return log.rows()


def running_counts(stream: DataFrame, key: str, log: BatchLog, checkpoint: str | None = None) -> DataFrame:
    """Totals since the start of the stream: every batch writes the keys it changed."""
    totals = stream.groupBy(key).agg(F.count("*").alias("count"))
    run_available(totals, log.put, mode="update", checkpoint=checkpoint)
    return log.current([key])


def _event_time(stream: DataFrame, ts: str, lateness: str | None) -> DataFrame:
    timed = stream.withColumn(ts, F.col(ts).cast("timestamp"))
    return timed.withWatermark(ts, lateness) if lateness else timed


def daily_totals(
    stream: DataFrame, ts: str, key: str, log: BatchLog, lateness: str | None = None, checkpoint: str | None = None
) -> DataFrame:
    """Totals per day, which start from zero with every day: ``(dt, key, count)``.

    With ``lateness`` the state of a day is dropped once it is that far in the past, and so
    are rows that come later still; without it every row counts.
    """
    day = F.window(ts, "1 day")
    counted = _event_time(stream, ts, lateness).groupBy(day, key).agg(F.count("*").alias("count"))
    totals = counted.select(F.to_date("window.start").alias("dt"), key, "count")
    run_available(totals, log.put, mode="update", checkpoint=checkpoint)
    return log.current(["dt", key])


def window_counts(
    stream: DataFrame,
    ts: str,
    key: str,
    log: BatchLog,
    length: str = "60 seconds",
    slide: str = "10 seconds",
    lateness: str | None = None,
    checkpoint: str | None = None,
) -> DataFrame:
    """Counts per sliding window of event time: ``(start, key, count)``; ``lateness`` as above."""
    window = F.window(ts, length, slide)
    counted = _event_time(stream, ts, lateness).groupBy(window, key).agg(F.count("*").alias("count"))
    totals = counted.select(F.col("window.start").alias("start"), key, "count")
    run_available(totals, log.put, mode="update", checkpoint=checkpoint)
    return log.current(["start", key])


def pane_counts(
    stream: DataFrame, ts: str, key: str, log: BatchLog, lateness: str, slide: str = "10 seconds", checkpoint: str | None = None
) -> StreamingQuery:
    """Count every event once, in the pane of length ``slide`` it falls into: ``(start, key, count)`` in ``log``.

    State is one number per key and pane, dropped once a pane is ``lateness`` behind the newest event. Rows that come
    later still are left out of the counts and counted themselves: ``late_rows`` of the query this returns.
    """
    pane = F.window(ts, slide)
    counted = _event_time(stream, ts, lateness).groupBy(pane, key).agg(F.count("*").alias("count"))
    totals = counted.select(F.col("window.start").alias("start"), key, "count")
    return run_available(totals, log.put, mode="update", checkpoint=checkpoint)


def late_rows(query: StreamingQuery) -> int:
    """Groups of rows that came too late, added up over the batches the query remembers
    (``spark.sql.streaming.numRecentProgressUpdates``): a task's rows of one key and pane count once."""
    return sum(op["numRowsDroppedByWatermark"] for p in query.recentProgress for op in p["stateOperators"])


def windows_of_panes(panes: DataFrame, key: str, length: int = 60, slide: int = 10) -> DataFrame:
    """Sliding windows of ``length`` seconds from panes of ``slide`` seconds: ``(start, key, count)``.

    Each pane counts into the ``length / slide`` windows it lies in, so it is sums per pane that are copied and shuffled,
    never events. Windows without any event have no row.
    """
    if length % slide:
        raise ValueError("a window is a whole number of panes")
    seconds = F.unix_micros(F.col("start").cast("timestamp"))
    starts = F.transform(F.sequence(F.lit(0), F.lit(length // slide - 1)), lambda back: F.timestamp_micros(seconds - back * F.lit(slide * 1_000_000).cast("long")))
    each = panes.select(F.explode(starts).alias("start"), key, "count")
    return each.groupBy("start", key).agg(F.sum("count").alias("count"))


def top_per_window(counts: DataFrame, key: str, n: int = 5) -> DataFrame:
    """The ``n`` most frequent keys of every window, numbered ``rn``."""
    order: list[Column] = [F.desc("count"), F.col(key)]
    return top_per_group(counts, ["start"], order, n)
