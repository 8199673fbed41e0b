"""The registered queries: each operator on the given tables, with SQL for the same result."""

from millrace.plans import changes, functions, mining, relational, streams, tables
from millrace.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES", "changes", "functions", "mining", "relational", "streams", "tables"]
