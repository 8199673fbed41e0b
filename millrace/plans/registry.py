"""Names of queries, the functions that plan them and the SQL that says the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from millrace.session import new_path, tune


class Tables:
    """The given tables of one folder: ``t.orders`` is the scan of ``orders.parquet``."""

    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.spark, self.folder = tune(spark), folder

    def path(self, name: str) -> str:
        return f"{self.folder}/{name}.parquet"

    def scratch(self, label: str) -> str:
        return new_path(self.spark, label)

    def __getattr__(self, name: str) -> DataFrame:
        return self.spark.read.parquet(self.path(name))


Plan = Callable[[Tables], DataFrame]
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, oracle: str | None = None) -> Callable[[Plan], Plan]:
    """Register a plan under a name, with SQL for the same result where there is some."""

    def register(plan: Plan) -> Plan:
        QUERIES[name] = lambda spark, folder: plan(Tables(spark, folder))
        if oracle is not None:
            ORACLES[name] = oracle
        return plan

    return register
