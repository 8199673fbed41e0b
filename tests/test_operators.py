"""Aggregates, joins, ranking, reshaping, upserts, change records, logs, neighbours."""

import json
import random
from datetime import datetime

import numpy as np
import pytest
from pyspark.sql import functions as F

from millrace.operators import aggregates, changes, clusters, joins, log_scan, logs, neighbours, pivots, ranking, reshape, upsert, wordcount


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


@pytest.fixture(scope="module")
def detail(spark):
    d = datetime
    return spark.createDataFrame(
        [
            (1, 1, d(2020, 1, 1, 12, 36, 1), 1, "milk", 5.0),
            (2, 2, d(2020, 1, 2, 11, 55, 51), 1, "milk", 5.0),
            (3, 2, d(2020, 1, 2, 11, 55, 51), 2, "bread", 10.0),
            (4, 2, d(2020, 1, 2, 11, 55, 51), 3, "orange", 3.0),
            (5, 3, d(2020, 1, 3, 12, 13, 0), 2, "bread", 12.5),
            (6, 4, d(2020, 1, 1, 9, 39, 48), 3, "orange", 6.0),
            (7, 4, d(2020, 1, 1, 9, 39, 48), 3, "orange", 6.0),
            (8, 4, d(2020, 1, 6, 9, 39, 48), 3, "orange", None),
            (9, 4, None, 3, "orange", None),
            (10, 5, d(2020, 1, 2, 0, 0, 0), 3, "orange", None),
        ],
        "id long, order_id long, charge_time timestamp, item_id int, item_name string, amount double",
    )


def test_daily(detail):
    found = {str(r.dt): tuple(r)[1:] for r in aggregates.daily(detail, "charge_time", "item_id", "amount").collect()}
    assert found["2020-01-01"] == (2, 17.0, 17 / 3, 17 / 3, 6.0, 5.0)
    assert found["2020-01-02"] == (3, 18.0, 6.0, 4.5, 10.0, 3.0)
    assert found["2020-01-03"] == (1, 12.5, 12.5, 12.5, 12.5, 12.5)
    assert found["2020-01-06"][:2] == (1, None) and found["2020-01-06"][4:] == (None, None)
    assert found["None"][:2] == (1, None)


def test_sums_are_not_rounded(spark):
    rows = spark.createDataFrame([("2020-01-01", 1, 0.004), ("2020-01-01", 2, 0.004), ("2020-01-02", 1, 1e17)], "ts string, item int, amount double")
    found = {str(r.dt): r for r in aggregates.daily(rows, "ts", "item", "amount").collect()}
    assert (found["2020-01-01"].sum_amount, found["2020-01-01"].avg_amount) == (0.008, 0.004)
    assert found["2020-01-02"].sum_amount == 1e17
    exact = rows.withColumn("amount", aggregates.exact("amount", 3))
    assert str(aggregates.grouped_having(exact, ["ts"], "amount", 1).head().sum_amount) == "0.008"


def test_grouped_having(detail):
    keys = [F.to_date("charge_time").alias("dt"), "item_id", "item_name"]
    assert aggregates.grouped_having(detail, keys, "amount", 3).count() == 0
    found = aggregates.grouped_having(detail, keys, "amount", 1).collect()
    assert sorted((str(r.dt), r.item_name, r.sum_amount, r.cnt) for r in found) == [
        ("2020-01-01", "orange", 12.0, 2), ("2020-01-02", "orange", 3.0, 2),
    ]


def test_with_share(spark):
    counts = spark.createDataFrame([("a", 1), ("b", 3)], "k string, num long")
    assert rows_of(aggregates.with_share(counts, "num", spark.range(4))) == [("a", 1, 4, 0.25), ("b", 3, 4, 0.75)]


def test_word_counts(spark):
    lines = spark.createDataFrame(
        [("python java  C# shell",), ("java javascript shell",), ("ruby java",), ("scala python",), (" \tx\n",), (None,)], "s string"
    )
    want = {"C#": 1, "java": 3, "javascript": 1, "python": 2, "ruby": 1, "scala": 1, "shell": 2}
    assert dict(rows_of(wordcount.count_words(lines, "s"))) == want | {"x": 1}
    assert dict(rows_of(wordcount.count_words(lines, "s", how="pieces"))) == want | {"\tx\n": 1}
    assert dict(rows_of(wordcount.count_words(lines, "s", how="pieces", keep_blank=True)))[""] == 2
    docs = wordcount.word_documents(wordcount.count_words(lines, "s")).where("word = 'C#'")
    assert docs.head().doc == '{"word":"C#","count":1}'


def test_joins(spark):
    big = spark.range(100).withColumn("k", F.col("id") % 10)
    small = spark.range(5).select(F.col("id").alias("k"), F.lit("x").alias("v"))
    assert joins.fits_broadcast(small) and not joins.fits_broadcast(big, max_rows=99)
    assert not joins.fits_broadcast(small, max_bytes=10)
    plans = [
        joins.lookup_join(big, small, ["k"], max_rows=n)._jdf.queryExecution().sparkPlan().toString() for n in (10, 2)
    ]
    assert "BroadcastHashJoin" in plans[0]
    assert joins.lookup_join(big, small, ["k"], max_rows=2).count() == 50
    assert "SortMergeJoin" in joins.shuffled_join(big, small, ["k"])._jdf.queryExecution().sparkPlan().toString()
    assert joins.lookup_join(big, small, ["k"], "left").where("v IS NULL").count() == 50
    assert joins.without_groups(big, big.where("id = 13"), ["k"]).count() == 90


def test_top(spark):
    df = spark.createDataFrame([("a", 3), ("a", 1), ("b", 2), ("a", 2), ("b", 9)], "g string, v int")
    assert rows_of(ranking.top_per_group(df, ["g"], [F.desc("v")], 2)) == [
        ("a", 2, 2), ("a", 3, 1), ("b", 2, 2), ("b", 9, 1),
    ]
    assert [r.v for r in ranking.top(df, [F.desc("v")], 2).collect()] == [9, 3]


def skewed(spark, n=4000):
    """A third of all rows has one key, and a sixth is copies of one row but for the id."""
    hot = F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("k"), F.col("id") % 50))
    value = F.when(F.col("id") % 6 == 0, 7).otherwise(F.abs(F.hash("id")) % 1000)
    return spark.range(n).select(hot.alias("k"), value.alias("v"), "id").repartition(5)


def test_row_numbers_on_a_hot_key(spark):
    df = skewed(spark)
    found = ranking.row_numbers(df, ["k"], ["v", "id"], partitions=16)
    by_key = {}
    for r in sorted(found.collect(), key=lambda r: (r.k, r.rn)):
        by_key.setdefault(r.k, []).append(r)
    assert sum(map(len, by_key.values())) == 4000 and len(by_key["hot"]) > 1300
    for numbered in by_key.values():
        assert [r.rn for r in numbered] == list(range(1, len(numbered) + 1))
        assert [(r.v, r.id) for r in numbered] == sorted((r.v, r.id) for r in numbered)


def test_null_keys_are_numbered_too(spark):
    df = spark.createDataFrame([(None, 1), (None, 2), ("a", 5)], "k string, v int")
    assert rows_of(ranking.row_numbers(df, ["k"], ["v"])) == [("a", 5, 1), (None, 1, 1), (None, 2, 2)]


def test_secondary_sort_spreads_a_hot_key(spark):
    parts = ranking.secondary_sort(skewed(spark), ["k"], ["v", "id"], 12).rdd.glom().collect()
    flat = [tuple(r) for part in parts for r in part]
    assert flat == sorted(flat) and len(flat) == 4000
    assert sum(any(r.k == "hot" for r in part) for part in parts) >= 3
    assert max(map(len, parts)) < 4000 / 4


# Cells


def test_wide_to_cells_and_back(spark):
    rows = spark.createDataFrame(
        [(1, "a", 2.5, None, [1, 2]), (2, None, None, "z", None)], "id int, n string, d double, s string, arr array<int>"
    )
    cells = reshape.wide_to_cells(rows)
    assert rows_of(cells) == [
        ("1", "cf", "arr", "[1,2]"), ("1", "cf", "d", "2.5"), ("1", "cf", "n", "a"), ("2", "cf", "s", "z"),
    ]
    back = reshape.cells_to_wide(cells, "rowkey:id:int; cf:n:string; cf:d:double; cf:s:string; cf:arr:string")
    assert rows_of(back) == [(1, "a", 2.5, None, "[1,2]"), (2, None, None, "z", None)]
    keyed = reshape.wide_to_cells(rows.select("id", "n", "d"), ["n", "id"], sep="-").where("rowkey LIKE 'a%'")
    assert rows_of(keyed) == [("a-1", "cf", "d", "2.5")]


def test_composite_keys_stay_apart(spark):
    rows = spark.createDataFrame([("a", None, 1), (None, "a", 2)], "x string, y string, v int")
    assert {r.rowkey for r in reshape.wide_to_cells(rows, ["x", "y"], sep="|").collect()} == {"a|\\N", "\\N|a"}
    parts = ["1#2", "3", "1", "2#3", "\\N", None, "\\", "#", "\\#"]
    pairs = spark.createDataFrame([(a, b, 1) for a in parts for b in parts], "a string, b string, v int")
    assert reshape.wide_to_cells(pairs, ["a", "b"], sep="#").select("rowkey").distinct().count() == len(parts) ** 2
    with pytest.raises(ValueError, match="backslash"):
        reshape.wide_to_cells(pairs, ["a", "b"], sep="\\")
    with pytest.raises(ValueError, match="separator"):
        reshape.wide_to_cells(rows, ["x", "y"])


def test_cells_to_wide(spark):
    declared = "rowkey:id:string; f1:name:string; f2:math:double; f2:chinese:decimal(38,3); f2_x:a_b:int; f1:math:int"
    cells = spark.createDataFrame(
        [
            ("001", "f1", "name", "old", 1),
            ("001", "f1", "name", "new", 2),
            ("001", "f2", "math", "76", 1),
            ("001", "f1", "math", "x", 1),
            ("002", "f2_x", "a_b", "5", 1),
            ("003", "f9", "other", "5", 1),
        ],
        "rowkey string, family string, qualifier string, value string, ts long",
    )
    found = reshape.cells_to_wide(cells, declared)
    assert found.columns == ["rowkey_id", "f1_name", "f2_math", "f2_chinese", "f2_x_a_b", "f1_math"]
    assert rows_of(found) == [
        ("001", "new", 76.0, None, None, None), ("002", None, None, None, 5, None), ("003", None, None, None, None, None),
    ]
    assert ("f2_x", "a_b") in rows_of(reshape.cell_columns(cells))


def test_sorted_cells(spark):
    cells = reshape.wide_to_cells(spark.range(500).select(F.hex("id").alias("k"), "id", (F.col("id") * 2).alias("b")))
    found = [tuple(r)[:3] for r in reshape.sorted_cells(cells, 7).collect()]
    assert found == sorted(found) and len(set(found)) == 1000


# Upsert and change records


def test_upsert(spark):
    schema = "id int, name string, price int, update_date string"
    base = spark.createDataFrame([(1, "a", 1, "2021-01-02"), (2, "b", 2, "2021-01-02"), (3, "c", 3, "2021-01-02")], schema)
    batch = spark.createDataFrame(
        [(2, "b2", 20, "2021-01-03"), (2, "b1", 10, "2021-01-01"), (3, "c0", 30, "2021-01-01"), (4, "d", 4, "2021-01-01")], schema
    )
    once = upsert.upsert(base, batch, ["id"], ["update_date"])
    assert [r[1] for r in rows_of(once)] == ["a", "b2", "c0", "d"]
    assert rows_of(upsert.upsert(once, batch, ["id"], ["update_date"])) == rows_of(once)
    newer = upsert.upsert(base, batch, ["id"], ["update_date"], compare_with_base=True)
    assert [r[1] for r in rows_of(newer)] == ["a", "b2", "c", "d"]


def record(action, rows, pk="id", pos=1):
    key = "after_values" if action == "update" else "values"
    head = {"log_file": "f", "log_pos": pos, "log_time": "t", "log_timestamp": 1, "schema": "test", "table": "t4"}
    return (json.dumps(head | {"table_pk": pk, "action": action, "data": [{key: r} for r in rows]}),)


def test_change_sql(spark):
    records = [
        record("insert", [{"id": 25, "data": "it's", "data2": None}, {"id": 26, "data": "25", "data2": 5.0}], pos=1),
        record("update", [{"id": 1, "z": "x", "a": None}, {"id": None, "z": True, "a": 1e10}], pos=2),
        record("update", [{"id": 1, "b": "k", "a": 2}], pk=["id", "b"], pos=3),
        record("delete", [{"id": 1, "a": 2}, {"id": 2, "a": 2}, {"id": 1, "a": 2}], pos=4),
        record("delete", [{"id": 1, "b": "x", "a": 2}], pk=["id", "b"], pos=5),
    ]
    found = {r.log_pos: r.sql for r in changes.change_sql(spark.createDataFrame(records, "value string")).collect()}
    assert found == {
        1: "insert into test.t4 values (25, 'it''s', null), (26, '25', 5.0)",
        2: "update test.t4 set z='x', a=null where id=1;\nupdate test.t4 set z=true, a=1.0E10 where id is null",
        3: "update test.t4 set a=2 where id=1 and b='k'",
        4: "delete from test.t4 where (id=1) or (id=2)",
        5: "delete from test.t4 where (id=1 and b='x')",
    }


def test_change_rows_and_apply(spark):
    records = spark.createDataFrame(
        [
            record("insert", [{"id": 1, "v": "a"}, {"id": 2, "v": None}], pos=1),
            record("update", [{"id": 1, "v": "b"}], pos=5),
            record("delete", [{"id": 9, "v": "z"}], pos=2),
            record("insert", [{"id": 8, "v": "back"}], pos=4),
            record("delete", [{"id": 8, "v": "z"}], pos=3),
        ],
        "value string",
    )
    rows = changes.change_rows(records)
    assert rows.where("action = 'insert' AND log_pos = 1").count() == 2
    assert ["2", "null"] in [r.value_list for r in changes.value_lists(records).collect()]
    base = spark.createDataFrame([(8, "x"), (9, "x"), (10, "x")], "id long, v string")
    typed = changes.typed_changes(rows, "test.t4", {"id": "long", "v": "string"})
    assert rows_of(upsert.apply_changes(base, typed, ["id"], ["log_pos", "ordinal"])) == [
        (1, "b"), (10, "x"), (2, None), (8, "back"),
    ]
    assert changes.typed_changes(rows, "test.other", {"id": "long"}).count() == 0


def test_changes_without_loss(spark):
    big = 18446744073709551615
    records = [
        record("insert", [{"id": big, "a": 12345678901234567890123, "b": 0.5}], pos=1),
        record("insert", [{"id": 2, "a": "x", "b": "y"}], pos=2),
        record("update", [{"id": 2, "a": "z"}], pos=3),
        record("update", [{"id": 3, "b": None}], pos=4),
        record("delete", [{"id": 4}], pos=5),
        record("update", [{"id": 4, "b": "again"}], pos=6),
        record("DELETE", [{"id": 2}], pos=7),
        ("{not json",),
        (None,),
        ("{}",),
    ]
    df = spark.createDataFrame(records, "value string")
    told = {r.log_pos: r.sql for r in changes.change_sql(df).collect()}
    assert told[1] == f"insert into test.t4 values ({big}, 12345678901234567890123, 0.5)"
    assert sorted(told) == [1, 2, 3, 4, 5, 6]
    assert sorted((str(r.value)[:9], r.reason) for r in changes.rejects(df).collect()) == [
        ("None", "unreadable"), (records[6][0][:9], "unknown action"), ("{not json", "unreadable"), ("{}", "unreadable"),
    ]
    typed = changes.typed_changes(changes.change_rows(df), "test.t4", {"id": "string", "a": "string", "b": "string"})
    base = spark.createDataFrame([("3", "keep", "lose"), ("4", "dead", "dead"), (None, "odd", None)], "id string, a string, b string")
    assert rows_of(upsert.apply_changes(base, typed, ["id"], ["log_pos", "ordinal"])) == [
        ("18446744073709551615", "12345678901234567890123", "0.5"), ("2", "z", "y"), ("3", "keep", None), ("4", None, "again"),
        (None, "odd", None),
    ]
    wrong = typed.withColumn("action", F.lit("DELETE"))
    with pytest.raises(Exception, match="unknown action: DELETE"):
        upsert.apply_changes(base, wrong, ["id"], ["log_pos", "ordinal"]).collect()
    plan = upsert.apply_changes(base, typed, ["id"], ["log_pos", "ordinal"])._jdf.queryExecution().executedPlan().toString()
    assert plan.count("from_json(") <= 2 and "Join" not in plan


def test_entries_that_cannot_be_acted_on_are_rejects(spark):
    def raw(action, data, pos, pk="id"):
        return (json.dumps({"log_pos": pos, "schema": "s", "table": "t", "table_pk": pk, "action": action, "data": data}),)

    good = {"after_values": {"id": 1, "a": 2}}
    records = [
        raw("update", [{"values": {"id": 1}}, good], 1),
        raw("insert", [], 2),
        raw("update", [{"after_values": {"id": 5}}], 3),
        raw("delete", [{"values": {"a": 5}}], 4),
        raw("delete", [{"values": {"id": 5}}], 5, pk=None),
        raw("insert", [{"values": {}}, None, {"values": {"a": 1}}], 6, pk=None),
        raw("update", [good], 7, pk=["id", "other"]),
        raw("delete", [{"values": {"id": 5, "a": 1}}], 8, pk=[]),
    ]
    df = spark.createDataFrame(records, "value string")
    found = changes.rejects(df).collect()
    assert sorted((json.loads(r.value)["log_pos"], -1 if r.ordinal is None else r.ordinal, r.reason) for r in found) == [
        (1, 0, "no values"), (2, -1, "no entries"), (3, 0, "nothing to set"), (4, 0, "key without a value"), (5, 0, "no key named"),
        (6, 0, "no values"), (6, 1, "no values"), (7, 0, "key without a value"), (8, 0, "no key named"),
    ]
    told = {r.log_pos: r.sql for r in changes.change_sql(df).collect()}
    assert told == {1: "update s.t set a=2 where id=1", 6: "insert into s.t values (1)"}
    assert sorted((r.log_pos, r.ordinal) for r in changes.change_rows(df).collect()) == [(1, 1), (6, 2)]


# Logs

LOG = """\
left over from the file before
2022-01-05T10:00:00,001 INFO  start
2022-01-05T10:00:01,001 INFO  [x] ql.Driver: Compiling command(queryId=hive_20220105_1): select a,
  b
   from t
2022-01-05T10:00:02,001 INFO  Completed compiling command(queryId=hive_20220105_1); Time taken: 1.5 seconds
2022-01-05T10:00:03,001 INFO  Executing command(queryId=hive_20220105_1): select a,
  b
   from t
2022-01-05T10:00:04,001 WARN  trouble
at x.y
2022-01-05T10:00:05,001 INFO  Compiling command(queryId=bob_20220105_2): drop table (x): y
Executing command without a level
2022-01-05T10:00:06,001 INFO  Compiling command(queryId=bob_20220105_3): select 1
"""


def test_log_sessions(spark, tmp_path):
    for name in ("a.log", "b.log"):
        (tmp_path / name).write_text(LOG.replace("_2022", f"_2022{name[0]}"))
    found = logs.sessions(logs.read_log(spark, str(tmp_path))).collect()
    by_source = sorted((r.source[-5:], r.id, r.query_id, r.start_time, r.end_time, r.duration, r.user, r.query_str) for r in found)
    assert by_source[:3] == [
        ("a.log", 0, None, None, None, None, None, "left over from the file before"),
        ("a.log", 2, "hive_2022a0105_1", "2022-01-05T10:00:01,001", "2022-01-05T10:00:02,001", "1.5", "hive", "select a, b from t"),
        ("a.log", 7, "bob_2022a0105_3", "2022-01-05T10:00:06,001", None, None, "bob", "select 1"),
    ]
    assert len(found) == 6


def test_log_groups_cross_blocks(spark):
    lines = [(("s", i // 2, i, line)) for i, line in enumerate(LOG.splitlines())]
    whole = [("s", 0, i, line) for i, line in enumerate(LOG.splitlines())]
    schema = "source string, block long, seq long, line string"
    split = logs.sessions(spark.createDataFrame(lines, schema))
    assert rows_of(split) == rows_of(logs.sessions(spark.createDataFrame(whole, schema)))
    assert split.count() == 3


# Neighbours


def test_nearest_leaves_out_vectors_that_are_not_finite(spark):
    rows = [(i, [float(i), 1.0], 0) for i in range(50)] + [(90, [float("nan"), 1.0], 0), (91, [float("inf"), 1.0], 0)]
    df = spark.createDataFrame(rows, "id long, v array<double>, label int").coalesce(1)
    asked = spark.createDataFrame([(1, [7.2, 1.0]), (2, [float("nan"), 0.0])], "query_id long, v array<double>")
    found = neighbours.nearest(df, asked, 3, "v", "id", "label")
    assert sorted((r.query_id, r.rn, r.id) for r in found.collect()) == [(1, 1, 7), (1, 2, 8), (1, 3, 6)]


def test_nearest_equals_brute_force(spark, monkeypatch):
    rng = random.Random(5)
    points = [(i, [rng.random() for _ in range(6)], i % 3) for i in range(300)] + [(1000 + i, [0.5] * 6, 1) for i in range(100)]
    queries = [(q, [rng.random() for _ in range(6)]) for q in range(23)] + [(99, [0.5] * 6)]
    df = spark.createDataFrame(points, "id long, v array<double>, label int").repartition(3)
    asked = spark.createDataFrame(queries, "query_id int, v array<double>")

    def want(k):
        found = set()
        for q, v in queries:
            ranked = sorted((sum((a - b) ** 2 for a, b in zip(v, w, strict=True)) ** 0.5, i) for i, w, _ in points)
            found |= {(q, i, n + 1) for n, (_, i) in enumerate(ranked[:k])}
        return found

    for block in (1000, 7):
        monkeypatch.setattr(neighbours, "QUERY_BLOCK", block)
        monkeypatch.setattr(neighbours, "POINT_BLOCK", 3 * block)
        found = neighbours.nearest(df, asked, 5, "v", "id", "label")
        assert {(r.query_id, r.id, r.rn) for r in found.collect()} == want(5)
    votes = neighbours.vote(spark.createDataFrame([(1, 2), (1, 2), (1, 0), (2, 5), (2, 3)], "query_id int, label int"), "label")
    assert rows_of(votes) == [(1, 2, 2), (2, 3, 1)]


def test_kmeans_separates_two_clouds(spark):
    rows = [(i, [float(i % 2) * 100 + i % 3, 1.0]) for i in range(60)]
    found = neighbours.kmeans(spark.createDataFrame(rows, "id long, v array<double>"), "v", 2)
    assert found.groupBy("cluster").agg(F.countDistinct(F.col("id") % 2).alias("n")).where("n > 1").count() == 0


def test_reduced_join_loses_nothing_and_shuffles_less(spark):
    draw = random.Random(12)
    big = [(draw.randint(0, 50_000), draw.choice((0.0, -0.0, 1.5, float("nan"), None)), i) for i in range(20_000)] + [(None, 1.5, -1)]
    small = [(draw.randint(0, 50_000), draw.choice((0.0, -0.0, 1.5, float("nan"), None)), "x") for _ in range(300)] + [(None, 1.5, "x")]
    left = spark.createDataFrame(big, "k long, d double, i long")
    right = spark.createDataFrame(small, "k long, d double, name string")
    for on in (["k"], ["k", "d"]):
        few = right.select(*on, "name")
        for how in ("inner", "left_semi"):
            want = left.join(few, on, how)
            assert repr(rows_of(joins.reduced_join(left, few, on, how).select(*want.columns))) == repr(rows_of(want))
    kept = joins.possible_matches(left, right, ["k"])
    assert kept.join(right, "k", "left_anti").count() < 20 and left.join(right, "k", "left_semi").count() < kept.count() + 1 < 300
    assert joins.possible_matches(left, right, ["k"], bits=64).count() == 20_000  # a full bitmap lets all through
    assert joins.possible_matches(left, right.limit(0), ["k"]).count() == 0
    with pytest.raises(ValueError, match="same type"):
        joins.reduced_join(left, right.withColumn("k", F.col("k").cast("int")), ["k"])
    with pytest.raises(ValueError, match="left_semi"):
        joins.reduced_join(left, right, ["k"], "left")


def test_logs_in_scan_order_equal_logs_by_sorting(spark, tmp_path, monkeypatch):
    draw = random.Random(5)
    for source in range(3):
        folder = tmp_path / f"source={source}"
        folder.mkdir()
        for part in range(3):
            text = LOG.replace("_20220105_", f"_{draw.randint(0, 9)}_20220105_{source}{part}")
            lines = text.splitlines() + [f" more {n}" for n in range(draw.randint(0, 9))]
            (folder / f"part-{part}.txt").write_text("\n".join(lines[draw.randint(0, 4) :]) + "\n")
    held = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "200")  # many blocks a file
    try:
        read = log_scan.read_blocks(spark, str(tmp_path))
        found = rows_of(log_scan.sessions(read))
        assert read.select("file", "start").distinct().count() > 20
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", held)
    numbered = read.withColumn("seq", F.monotonically_increasing_id())
    want = logs.sessions(numbered.select("source", F.struct("file", "start").alias("block"), "seq", "line"))
    assert found == rows_of(want) and len(found) > 10
    assert log_scan.sessions(log_scan.read_blocks(spark, str(tmp_path)).where("false")).count() == 0


def test_kmeans_settles_where_plain_lloyd_does(spark):
    draw = np.random.default_rng(4)
    middle = np.array([[0.0, 0.0], [9.0, 0.0], [0.0, 9.0]])
    values = np.concatenate([draw.normal(m, 1, (80, 2)) for m in middle])
    rows = [(i, [float(x) for x in v]) for i, v in enumerate(values)] + [(900, None), (901, [float("nan"), 0.0]), (902, [1.0]), (None, [0.5, 0.5])]
    df = spark.createDataFrame(rows, "id long, v array<double>").repartition(5)
    taken = np.array([r[1] for r in rows if r[1] is not None and len(r[1]) == 2 and not np.isnan(r[1]).any()])
    start = values[[0, 1, 2]]
    found = clusters.fit(df, "v", start)
    centres = start
    for _ in range(found.steps):
        near = ((taken[:, None] - centres[None]) ** 2).sum(axis=2).argmin(axis=1)
        centres = np.array([taken[near == c].mean(axis=0) if (near == c).any() else centres[c] for c in range(3)])
    assert found.settled and np.allclose(found.centres, centres)
    given = clusters.assign(df, "v", "id", found.centres).collect()
    assert len(given) == 241 and max(r.distance for r in given) < 25
    drawn = clusters.seeds(df, "v", "id", 3)
    assert len(drawn) == 3 and np.array_equal(drawn, clusters.seeds(df.repartition(2), "v", "id", 3))
    assert sorted(((clusters.fit(df, "v", drawn).centres[:, None] - middle[None]) ** 2).sum(axis=2).argmin(axis=1).tolist()) == [0, 1, 2]
    assert clusters.seeds(df.where("false"), "v", "id", 3).size == 0
    assert clusters.fit(df, "v", np.zeros((0, 0))).settled
    assert len(clusters.seeds(df.where("id = 5").union(df.where("id = 5")), "v", "id", 3)) == 1
    assert clusters.fit(df.where("false"), "v", start).centres.tolist() == start.tolist()


def test_pivots_find_the_same_neighbours_and_skip_blocks(spark):
    draw = np.random.default_rng(9)
    middle = draw.normal(0, 50, (12, 4))
    values = np.concatenate([draw.normal(m, 1, (150, 4)) for m in middle] + [np.repeat(middle[:1], 300, axis=0)])  # ties, too
    rows = [(i, [float(x) for x in v], i % 3) for i, v in enumerate(values)] + [(9000, None, 0), (9001, [float("nan")] * 4, 0)]
    df = spark.createDataFrame(rows, "id long, v array<double>, label int").repartition(4)
    asked = [(i, [float(x) for x in v]) for i, v in enumerate(np.concatenate([values[::97] + 0.1, draw.normal(0, 80, (20, 4)), middle[:1]]))]
    queries = spark.createDataFrame([*asked, (7000, None), (7001, [1.0])], "query_id long, v array<double>")
    found = pivots.nearest(df, queries, 5, "v", "id", "label", pivots=12, block=50).collect()
    want = []
    for number, query in asked:
        apart = np.sqrt(((values - np.array(query)) ** 2).sum(axis=1))
        best = sorted(range(len(values)), key=lambda i: (apart[i], i))[:5]
        want += [(number, i, i % 3, float(apart[i]), rn + 1) for rn, i in enumerate(best)]
    assert sorted(tuple(r) for r in found) == sorted(want)
    met = pivots.meetings(df, queries, 5, "v", "id", "label", 12, 50)
    pairs = met.select(F.sum(F.size("asked") * F.size("held"))).head()[0]
    assert pairs < len(asked) * len(values) / 2
    assert pivots.nearest(df, queries, 5000, "v", "id", "label", pivots=3, block=700).count() == len(asked) * len(values)
    assert pivots.nearest(df.where("id < 0"), queries, 5, "v", "id", "label").count() == 0
    assert pivots.nearest(df, queries.where("query_id < 0"), 5, "v", "id", "label").count() == 0
    with pytest.raises(ValueError, match="one length"):
        pivots.nearest(df.unionByName(df.limit(1).withColumn("v", F.array(F.lit(1.0)))), queries, 5, "v", "id", "label")
