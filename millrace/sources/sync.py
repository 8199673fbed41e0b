"""Any source to any sink, with column steps in between."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

Step = Callable[[DataFrame], DataFrame]


def sync(source: DataFrame, sink: Callable[[DataFrame], None], *steps: Step) -> int:
    """Run ``source`` through ``steps`` into ``sink``; returns the number of rows handed over."""
    for step in steps:
        source = source.transform(step)
    seen = Observation()
    sink(source.observe(seen, F.count(F.lit(1)).alias("rows")))
    return int(seen.get["rows"])
