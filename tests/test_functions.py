import base64
import hashlib
import json
import re
from datetime import date, datetime
from types import SimpleNamespace

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

from millrace import functions as fn
from millrace.functions.sql_aggregates import SLICES, register_aggregates, slices
from millrace.plans import relational

TEXTS = st.lists(st.text(st.characters(codec="utf-8", exclude_characters="\x00"), max_size=40), min_size=1, max_size=30)
FEW = settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])


def values(df):
    return [tuple(r) for r in df.collect()]


def one(spark, schema, row, *columns):
    return tuple(spark.createDataFrame([row], schema).select(*columns).head())


@pytest.mark.parametrize(
    ("coded", "plain"),
    [
        ("SGVsbG8gV29ybGQh", "Hello World!"),
        ("SGVsbG8", "Hello"),
        ("SGVsbG8=", "Hello"),
        ("gICA", "���"),
        ("@@@", "Base64解密失败"),
        ("a", "Base64解密失败"),
        ("ab=", "Base64解密失败"),
        ("SGVs bG8=", "Base64解密失败"),
        ("SGVsbG8gV29ybGQh\n", "Base64解密失败"),
        ("====", "Base64解密失败"),
        ("", None),
        (" \t\n", None),
        (None, None),
    ],
)
def test_decode_base64(spark, coded, plain):
    assert one(spark, "s string", (coded,), fn.decode_base64("s")) == (plain,)


def test_encoders(spark):
    row = one(spark, "s string", ("Hello World",), fn.encode_md5("s"), fn.encode_base64("s"))
    assert row == ("b10a8db164e0754105b7a99be72e3fe5", "SGVsbG8gV29ybGQ=")
    long = one(spark, "s string", ("a" * 100,), fn.encode_base64("s"))[0]
    assert len(long) == 136 and "\n" not in long and "\r" not in long
    for blank in ("", "  ", "\t\n", None):
        assert one(spark, "s string", (blank,), fn.encode_md5("s"), fn.encode_base64("s")) == (None, None)


@FEW
@given(TEXTS)
def test_encoding_round_trip(spark, texts):
    rows = spark.createDataFrame([(t,) for t in texts], "s string").select(
        "s", fn.encode_base64("s").alias("b"), fn.encode_md5("s").alias("m")
    )
    for text, coded, digest, back in values(rows.withColumn("d", fn.decode_base64("b"))):
        if all(ord(c) <= 32 for c in text):
            assert (coded, digest, back) == (None, None, None)
        else:
            assert coded == base64.b64encode(text.encode()).decode() and back == text
            assert digest == hashlib.md5(text.encode()).hexdigest()


@pytest.mark.parametrize(
    ("text", "find", "places"),
    [
        ("abcabcd", "a", [0, 3]),
        ("abcabcd", "ab", [0, 3]),
        ("abcabcd", "abcd", [3]),
        ("aaaa", "aa", [0, 2]),
        ("xyz", "q", []),
        ("", "q", []),
        ("a😀b", "b", [3]),
        ("a.b.", ".", [1, 3]),
        ("x\\Ey\\E", "\\E", [1, 4]),
        (None, "a", None),
        ("a", None, None),
        ("a", "", None),
        ("ab" * 3000, "b", list(range(1, 6000, 2))),
    ],
)
def test_all_in_str(spark, text, find, places):
    assert one(spark, "s string, f string", (text, find), fn.all_in_str("s", "f"))[0] == places


def brute_places(text, find):
    text, find, found, at = text.encode("utf-16-be"), find.encode("utf-16-be"), [], 0
    while (at := text.find(find, at)) >= 0:
        if at % 2 == 0:
            found.append(at // 2)
            at += len(find)
        else:
            at += 1
    return found


@FEW
@given(st.lists(st.tuples(st.text("ab.$\\QE", max_size=700), st.text("ab.$\\QE", min_size=1, max_size=3)), min_size=1, max_size=20))
def test_all_in_str_equals_scan(spark, pairs):
    rows = spark.createDataFrame(pairs, "s string, f string").select("s", "f", fn.all_in_str("s", "f"))
    assert all(found == brute_places(text, find) for text, find, found in values(rows))


@pytest.mark.parametrize(
    ("card", "result"),
    [
        (None, None),
        ("1101081999", -1),
        ("11010819990231011234", -1),
        ("123456", -1),
        ("11010519491231002X", 0),
        ("11010519491231002x", -4),
        ("1101051949123100２X", -4),
        ("990105194912310021", -3),
        ("110105194913310021", -2),
        ("110105000012310021", -2),
        ("1101051949123A0021", -2),
        ("110105491231002", 0),
        ("110105490231002", 0),
    ],
)
def test_check_id_card(spark, card, result):
    assert one(spark, "s string", (card,), fn.check_id_card("s")) == (result,)


def test_check_id_card_accepts_exactly_one_check_character(spark):
    cards = [(f"1101051949123100{i:02}"[:17] + c,) for i in (10, 27, 35) for c in "0123456789X"]
    rows = spark.createDataFrame(cards, "s string")
    good = values(rows.where(fn.check_id_card("s") == 0))
    assert len(good) == 3


def test_count_distinct_array(spark):
    schema = "a array<string>"
    for array, n in [(["abc", "ab", "ab", "ab"], 2), (["a", None, None], 2), ([], 0), (None, None)]:
        assert one(spark, schema, (array,), fn.count_distinct_array("a")) == (n,)
    assert one(spark, "s string", ("a,ab,ab,c,ab",), fn.count_distinct_array(F.split("s", ","))) == (3,)


def test_sort_array_desc(spark):
    assert one(spark, "a array<int>", ([3, None, 1, 2],), fn.sort_array_desc("a")) == ([3, 2, 1, None],)


@pytest.mark.parametrize(
    ("text", "sep", "pieces"),
    [
        ("a,b,,", ",", ["a", "b"]),
        ("", ",", [""]),
        (",,", ",", []),
        (",a,", ",", ["", "a"]),
        ("a1b22c", "[0-9]+", ["a", "b", "c"]),
        (None, ",", []),
        ("a", None, []),
    ],
)
def test_explode_str(spark, text, sep, pieces):
    fn.register(spark)
    rows = spark.createDataFrame([(text, sep)], "s string, sep string")
    assert [r.col for r in spark.sql("SELECT e.col FROM {t} t, LATERAL explode_str(t.s, t.sep) e", t=rows).collect()] == pieces


def test_sql_names_and_argument_checks(spark):
    fn.register(spark)
    row = spark.sql("SELECT encode_md5('Hello World') m, check_id_card('1') c, all_in_str('aaaa', 'aa') p").head()
    assert tuple(row) == ("b10a8db164e0754105b7a99be72e3fe5", -1, [0, 2])
    for wrong in ("count_distinct_array('a', 'b')", "count_distinct_array(1)", "check_id_card()"):
        with pytest.raises(AnalysisException):
            spark.sql(f"SELECT {wrong}")
    with pytest.raises(AnalysisException):
        spark.sql("SELECT * FROM explode_str('a')")


def test_functions_are_inlined(spark):
    plan = spark.createDataFrame([("a",)], "s string").where(fn.encode_md5("s") == "x")
    text = plan._jdf.queryExecution().executedPlan().toString()
    assert "md5" in text and "Python" not in text


def test_kv_to_json(spark):
    schema = "name string, age int, score double, big long, none string"
    row = ("香茗", 21, 88.8, 2**40, None)
    assert one(spark, schema, row, fn.kv_to_json("name", "name", "age", "age", "score", "score")) == (
        '{"name":"香茗","age":21,"score":88.8}',
    )
    assert one(spark, schema, row, fn.kv_to_json("a", "age", "b", "none", "a", "big")) == ('{"a":1099511627776,"b":null}',)
    assert one(spark, "s string", ("<a&b='c'>",), fn.kv_to_json("s", "s")) == (
        '{"s":"\\u003ca\\u0026b\\u003d\\u0027c\\u0027\\u003e"}',
    )
    assert one(spark, "s string", ("<a>",), fn.kv_to_json("s", "s", html_safe=False)) == ('{"s":"<a>"}',)
    with pytest.raises(ValueError, match="even number"):
        fn.kv_to_json("a")


def test_row_to_json(spark):
    rows = spark.createDataFrame(
        [(1, None, datetime(2020, 1, 2, 3, 4, 5, 678000), date(2020, 1, 2))], "id int, x string, ts timestamp, d date"
    )
    assert rows.select(fn.row_to_json(rows)).head()[0] == '{"id":1,"ts":"2020-01-02 03:04:05 678","d":"2020-01-02"}'


def test_value_kinds(spark):
    docs = [('{"a":1,"b":"x","c":[1],"d":{"e":1},"f":null,"g":1.5,"h":true}',), ('{"a":"1"}',)]
    found = fn.value_kinds(spark.createDataFrame(docs, "j string"), "j")
    assert sorted(values(found)) == [
        ("a", "integer", 1), ("a", "string", 1), ("b", "string", 1), ("c", "array", 1), ("d", "object", 1),
        ("f", "null", 1), ("g", "decimal", 1), ("h", "boolean", 1),
    ]


def test_uuid32(spark):
    ids = [r[0] for r in spark.range(200).select(fn.uuid32()).collect()]
    assert len(set(ids)) == 200 and all(re.fullmatch("[0-9a-f]{32}", i) for i in ids)


def test_sum_value(spark):
    schema = "b byte, l long, f float, s string, d decimal(10,2), t timestamp, ok boolean, day date, a array<int>"
    from decimal import Decimal

    rows = spark.createDataFrame(
        [
            (1, 2**40, 0.5, "1.5", Decimal("1.10"), datetime(1970, 1, 1, 0, 0, 2), True, date(2020, 1, 1), [1]),
            (2, 1, 0.25, "x", None, None, None, None, None),
        ],
        schema,
    )
    found = rows.agg(*(fn.sum_value(rows, c) for c in "blfsdt")).head()
    assert tuple(found) == (3, 2**40 + 1, 0.75, 1.5, Decimal("1.10"), 2.0)
    for refused in ("ok", "day", "a"):
        with pytest.raises(TypeError):
            fn.sum_value(rows, refused)


def test_max_length_value(spark):
    rows = spark.createDataFrame([("bb",), ("a",), ("aa",), (None,)], "s string")
    assert rows.agg(fn.max_length_value("s")).head()[0] == "aa"
    assert rows.where("s IS NULL").agg(fn.max_length_value("s")).head()[0] is None


def test_map_of(spark):
    rows = spark.createDataFrame(
        [(1, "a", 10, 1), (1, "a", 11, 2), (1, "b", None, 1), (1, None, 5, 1), (2, "a", 7, 1)], "g int, k string, v int, ts int"
    )
    found = fn.map_of(rows, ["g"], "k", "v", ["ts"])
    assert {r.g: r.kv for r in found.collect()} == {1: {"a": 11, "b": None}, 2: {"a": 7}}


def test_combinations_and_subsets(spark):
    from itertools import combinations
    from math import comb

    for items in (list("abcd"), list("abcde"), ["x"], []):
        for n in (1, 2, 3, 4):
            got = one(spark, "a array<string>", (items,), fn.combinations("a", n))[0]
            assert got == [list(c) for c in combinations(items, n)] and len(got) == comb(len(items), n)
        every = one(spark, "a array<string>", (items,), fn.subsets("a"))[0]
        assert len(every) == 2 ** len(items) - 1 and len({tuple(s) for s in every}) == len(every)
    assert [] in one(spark, "a array<string>", (["x"],), fn.subsets("a", with_empty=True))[0]
    with pytest.raises(Exception, match="too many items"):
        one(spark, "a array<string>", ([str(i) for i in range(40)],), F.size(fn.subsets("a")))


def test_typed_array_functions_in_sql(spark):
    fn.register(spark)
    row = spark.sql(
        "SELECT sort_array_desc_long(array(2, 10, 9)), sort_array_desc_double(array(2.5D, 10D)), count_distinct_array_long(array(1, 1, 2)),"
        " count_distinct_array_double(array(1D, 1.5D)), sort_array_desc(array('b', 'a'))"
    ).first()
    assert tuple(row) == ([10, 9, 2], [10.0, 2.5], 2, 2, ["b", "a"])
    ids = [r[0] for r in spark.sql("SELECT uuid32() FROM range(3)").collect()]
    assert len(set(ids)) == 3 and all(len(i) == 32 and "-" not in i for i in ids)


def test_subset_rows(spark):
    rows = [(1, [str(i) for i in range(14)]), (2, []), (3, None), (4, ["x", "y"])]
    df = spark.createDataFrame(rows, "id int, a array<string>")
    found = fn.subset_rows(df, "a", with_empty=True)
    counts = {r["id"]: (r["n"], r["d"]) for r in found.groupBy("id").agg(F.count("*").alias("n"), F.countDistinct("subset").alias("d")).collect()}
    assert counts == {1: (2**14, 2**14), 2: (1, 1), 4: (4, 4)}
    assert sorted(r["subset"] for r in fn.subset_rows(df.where("id = 4"), "a").collect()) == [["x"], ["x", "y"], ["y"]]


def test_aggregates_in_sql(spark):
    register_aggregates(spark)
    rows = [(1, "12", 2**62 + 1, "bb", "k", 1), (1, " 1.5 ", 5, "aaa", "k", 2), (1, "x", None, None, None, 3), (1, "1_0", 1, "aab", "j", 4), (2, None, None, None, None, 1)]
    spark.createDataFrame(rows, "g int, t string, n long, s string, k string, place int").createOrReplaceTempView("agg_rows")
    found = spark.sql("SELECT g, sum_value(t) a, sum_value_long(n) b, max_length_value(s) c, map_of(k, s, place) d FROM agg_rows GROUP BY g ORDER BY g")
    nulls = [tuple(r) for r in spark.sql("SELECT g, sum_value(t) a, max_length_value(s) c, map_of(k, s, place) d FROM agg_rows WHERE g = 2 GROUP BY g").collect()]
    assert nulls == [(2, None, None, {})]
    whole = spark.sql("SELECT sum_value_long(n) FROM agg_rows WHERE n IS NOT NULL").head()[0]
    assert whole == 2**62 + 7
    first = found.drop("b").head()
    assert tuple(first) == (1, 13.5, "aaa", {"j": "aab", "k": "aaa"})
    times = spark.sql("SELECT sum_value(x) FROM VALUES (TIMESTAMP '1970-01-01 00:00:02.5'), (TIMESTAMP '1970-01-02 00:00:00') AS v(x)").head()[0]
    assert times == 86402.5
    with pytest.raises(Exception, match="numbers, strings or timestamps"):
        spark.sql("SELECT sum_value(x) FROM VALUES (true), (false) AS v(x)").collect()


def test_slices_part_a_large_group(spark):
    rows = spark.range(0, 20_000, 1, 2).selectExpr("id", "CASE WHEN id % 7 > 0 THEN CAST(id AS STRING) END AS t")
    parts = slices(rows, "id").groupBy("slice").count().collect()
    assert len(parts) == 2 * SLICES and max(r["count"] for r in parts) < 1000
    register_aggregates(spark)
    sums = spark.sql("SELECT sum_value(t) a, sum_value_long(id) b, sum_value(CAST(NULL AS STRING)) c FROM {rows} GROUP BY slice", rows=slices(rows, "id"))
    whole = spark.sql("SELECT sum_value(CAST(a AS STRING)) a, sum_value_long(b) b, sum_value(c) c FROM {sums}", sums=sums).head()
    assert tuple(whole) == (sum(i for i in range(20_000) if i % 7), 199990000, None)


def test_sql_typed_sum_sums_slices_first(spark):
    lines = spark.range(0, 8000, 1, 4).selectExpr("id AS l_orderkey", "1 AS l_linenumber", "'N' AS l_returnflag", "0.5D AS l_tax", "0.25D AS l_discount")
    found = relational.sql_typed_sum(SimpleNamespace(spark=spark, lineitem=lines))
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("sum_value_long(") >= 2 and "slice" in plan
    assert tuple(found.head()) == ("N", 8000, 4000.0, 2000.0)


def test_row_to_json_for_reading(spark):
    df = spark.createDataFrame([(1, None, "x")], "a int, b int, c string")
    text = df.select(fn.row_to_json(df, pretty=True)).head()[0]
    assert json.loads(text) == {"a": 1, "c": "x"} and text.count("\n") == 3


def test_sort_array_desc_in_sql_goes_by_the_kind_of_the_elements(spark):
    fn.register(spark)
    sql = lambda text: spark.sql(f"SELECT sort_array_desc({text})").head()[0]
    assert sql("array(2, 10, 9, NULL)") == ["10", "9", "2", None]
    assert sql("array(2.5D, 10D, -1D)") == ["10.0", "2.5", "-1.0"]
    assert sql("array(2.5, 10.25)") == ["10.25", "2.5"]
    assert sql(f"array({2**62}, {2**62 + 1})") == [str(2**62 + 1), str(2**62)]
    assert sql("array('2', '10', 'b')") == ["b", "2", "10"]
    assert sql("array(DATE '2024-01-02', DATE '2024-01-10')") == ["2024-01-10", "2024-01-02"]
    assert sql("CAST(array() AS ARRAY<INT>)") == [] and sql("CAST(NULL AS ARRAY<INT>)") is None
    with pytest.raises(Exception, match="has an order"):
        sql("array(array(1), array(2))")
