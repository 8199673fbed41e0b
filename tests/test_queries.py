"""Every registered query against its SQL, and what its plan must not hold."""

import re

import pytest

import __spark_entry__ as spark_entry
from millrace.plans import ORACLES, QUERIES
from oracle import connect, differences

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def db():
    return connect(FOLDER)


@pytest.mark.parametrize("name", list(QUERIES))
def test_query(spark, db, name):
    assert differences(spark, db, name, FOLDER) is None


# Queries that plan no eager work of their own before they return.
LAZY = [
    "anti_join", "array_combos", "baskets", "broadcast_join", "cdc_apply", "cdc_sql", "cells_to_wide", "contain_join",
    "daily_agg", "kv_map_pivot", "left_join", "multi_key_having", "shuffle_join", "top_baskets", "upsert_latest",
]


@pytest.mark.parametrize("name", LAZY)
def test_no_pairing_of_everything_with_everything(spark, name):
    plan = spark_entry.queries()[name](spark, FOLDER)._jdf.queryExecution().toString()
    assert not re.search("CartesianProduct|BroadcastNestedLoopJoin|PythonUDF|SinglePartition", plan)


def test_pruning_and_pushdown(spark):
    plan = spark_entry.queries()["table_scan"](spark, FOLDER)._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"PushedFilters: \[.*EqualTo\(c_mktsegment,BUILDING\), GreaterThan\(c_acc", plan)
    plan = spark_entry.queries()["anti_join"](spark, FOLDER)._jdf.queryExecution().executedPlan().toString()
    schemas = re.findall(r"ReadSchema: struct<(.*?)>", plan)
    assert schemas and all(s.count(":") <= 3 for s in schemas)
    scan = spark_entry.queries()["daily_agg"](spark, FOLDER)._jdf.queryExecution().optimizedPlan().toString()
    assert "l_comment" not in scan and "l_orderkey" not in scan.split("Relation")[0]


def test_rank_filter_is_below_the_shuffle(spark):
    plan = spark_entry.queries()["topn_group"](spark, FOLDER)._jdf.queryExecution().executedPlan().toString()
    assert plan.rindex("WindowGroupLimit") > plan.index("Exchange")


def test_entry(spark):
    assert spark_entry.entry(spark).count() > 0


def test_oracles_belong_to_queries():
    assert set(spark_entry.oracle_sql()) <= set(spark_entry.queries())
    assert set(QUERIES) - set(ORACLES) == {"kmeans_fit"}
