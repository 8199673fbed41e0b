"""Numbering arrivals with keyed state: a batch touches the state of its own keys only, and keys can be removed.

The state of a key is one number in the state store (RocksDB, see ``session.JOB_CONF``). Rows of a key are numbered as
they arrive, chunk by chunk, so a frequent key holds no memory; it is one task's work in a batch, which the size of a
batch bounds. Where one key may be most of a large batch, ``arrivals.Arrivals`` numbers it in many tasks instead.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle


class _Counter(StatefulProcessor):
    def __init__(self, limit: int | None, idle_ms: int | None) -> None:
        self.limit, self.idle_ms = limit, idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.total = handle.getValueState("total", "n long")

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        held = self.total.get()[0] if self.total.exists() else 0
        for chunk in rows:
            numbers = held + np.arange(1, len(chunk) + 1, dtype=np.int64)
            if self.limit:
                numbers = (numbers - 1) % self.limit + 1
            if len(numbers):
                held = int(numbers[-1])
            yield chunk.assign(n=numbers)
        if self.limit and held == self.limit:
            self.total.clear()
        else:
            self.total.update((held,))
        if self.idle_ms is not None:
            for timer in list(self.handle.listTimers()):
                self.handle.deleteTimer(timer)
            self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + self.idle_ms)

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        self.total.clear()
        return iter(())

    def close(self) -> None:
        pass


def numbered(stream: DataFrame, key: str, limit: int | None = None, idle_ms: int | None = None) -> DataFrame:
    """``stream`` with ``n``, how many rows of its key there were so far: x x x gives 1, 2, 3.

    A key's state is removed with the arrival that makes ``limit``, and after ``idle_ms`` milliseconds (processing time)
    without one; the key then starts anew. A null key is a key. A batch that runs again starts from the state before it.
    With ``idle_ms`` a query has timers to wait for, so run it with ``sources.start``: a run that ends when all is read would not.
    """
    if limit is not None and limit < 1 or idle_ms is not None and idle_ms < 1:
        raise ValueError("limit and idle_ms are positive")
    if "n" in stream.columns:
        raise ValueError("the column n is the result's")
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in stream.schema)
    return stream.groupBy(key).transformWithStateInPandas(
        statefulProcessor=_Counter(limit, idle_ms),
        outputStructType=f"{fields}, n long",
        outputMode="Update",
        timeMode="None" if idle_ms is None else "ProcessingTime",
    )
