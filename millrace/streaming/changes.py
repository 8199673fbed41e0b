"""Change records from a stream into a table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from millrace.operators.changes import change_rows, change_sql, typed_changes
from millrace.operators.keyed_store import KeyedStore
from millrace.operators.upsert import apply_changes
from millrace.session import written
from millrace.streaming.sources import BatchLog, run_available

PLACE = ["log_pos", "ordinal"]


def collect_changes(
    stream: DataFrame,
    target: str,
    columns: dict[str, str],
    log: BatchLog,
    column: str = "value",
    checkpoint: str | None = None,
) -> DataFrame:
    """Keep the changes of one table; ``log`` has the columns, action, log_pos, ordinal and present.

    Every change is kept, as an update may carry some columns only; ``merged`` folds them by key. The order of the records is in the records (log position, place in the record), so
    batches need not be processed row by row, nor even arrive in order.
    """

    def each(batch: DataFrame, batch_id: int) -> None:
        log.put(typed_changes(change_rows(batch, column), target, columns), batch_id)

    run_available(stream, each, checkpoint=checkpoint)
    return log.rows()


def merged(base: DataFrame, changes: DataFrame, keys: list[str]) -> DataFrame:
    """The table as it is after the collected changes; write it to fold them in."""
    return apply_changes(base, changes, keys, PLACE)


def apply_to_store(
    stream: DataFrame, store: KeyedStore, target: str, columns: dict[str, str], column: str = "value", checkpoint: str | None = None
) -> StreamingQuery:
    """Apply the changes of one table to a keyed table, batch by batch; only the buckets of a batch's keys are rewritten.

    A batch that runs again is known by its number and changes nothing. Inside a batch the order is that of the records;
    batches must come in the order of the log, as ``store`` keeps no log positions. Where they don't, use
    ``collect_changes`` and ``merged``. A store takes batches of one stream only, with one checkpoint.
    """

    def each(batch: DataFrame, batch_id: int) -> None:
        store.apply(written(typed_changes(change_rows(batch, column), target, columns), "changes"), PLACE, batch_id=batch_id)

    return run_available(stream, each, checkpoint=checkpoint)


def statements(
    stream: DataFrame, log: BatchLog, column: str = "value", checkpoint: str | None = None
) -> DataFrame:
    """The SQL text of every record: ``(log_pos, table, action, sql, batch_id)``."""

    def each(batch: DataFrame, batch_id: int) -> None:
        log.put(change_sql(batch, column), batch_id)

    run_available(stream, each, checkpoint=checkpoint)
    return log.rows()
