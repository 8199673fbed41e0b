from fractions import Fraction
from collections import Counter
from itertools import combinations

import math

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from millrace.mining import baskets as B
from millrace.mining import itemsets as I
from millrace.mining import rules as R

FEW = settings(max_examples=2, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
BASKETS = st.lists(st.sets(st.sampled_from("abcdefgh"), max_size=7), min_size=3, max_size=40)
SAMPLE = [list("ACD"), list("BCE"), list("ABCE"), list("BE")]


def frame(spark, rows):
    return spark.createDataFrame([(sorted(r),) for r in rows], "items array<string>")


def as_dict(found):
    return {tuple(r["items"]): r["num"] for r in found.collect()}


def brute(rows, enough, max_size=10):
    counts = Counter(c for row in rows for k in range(1, max_size + 1) for c in combinations(sorted(row), k))
    return {c: n for c, n in counts.items() if n >= enough}


def test_sample_baskets(spark):
    found = I.frequent_itemsets(frame(spark, SAMPLE), 0.5, min_size=1)
    want = {"A": 2, "B": 3, "C": 3, "E": 3, "AC": 2, "BC": 2, "BE": 3, "CE": 2, "BCE": 2}
    assert as_dict(found) == {tuple(k): n for k, n in want.items()}
    assert {(r.k, r.row_num) for r in found.collect()} == {(1, 4), (2, 4), (3, 4)}
    assert {tuple(r["items"]) for r in I.maximal(found).collect()} == {("A", "C"), ("B", "C", "E")}
    told = R.association_rules(found, 0.6).collect()
    rules = {("".join(r.antecedent), r.consequent): round(r.confidence, 4) for r in told}
    assert rules == {
        ("C", "A"): 0.6667, ("A", "C"): 1.0, ("C", "B"): 0.6667, ("B", "C"): 0.6667, ("E", "B"): 1.0, ("B", "E"): 1.0,
        ("E", "C"): 0.6667, ("C", "E"): 0.6667, ("CE", "B"): 1.0, ("BE", "C"): 0.6667, ("BC", "E"): 1.0,
    }


def test_rules_of_given_itemsets(spark):
    given_sets = spark.createDataFrame([(["a"], 15), (["b"], 35), (["a", "b"], 12)], "items array<string>, freq long")
    rules = R.association_rules(given_sets, 0.8, num="freq").collect()
    assert [(r.antecedent, r.consequent, r.confidence) for r in rules] == [(["a"], "b", 0.8)]


@FEW
@given(BASKETS, st.sampled_from([0.1, 0.25, 0.5]))
def test_equals_brute_force_and_fp_growth(spark, rows, support):
    df = frame(spark, rows)
    want = brute(rows, I.needed(support, len(rows)))
    assert as_dict(I.frequent_itemsets(df, support, min_size=1)) == want
    assert as_dict(I.fp_growth(df, support, min_size=1)[0]) == want


@FEW
@given(BASKETS)
def test_wide_baskets_are_dealt_out(spark, rows):
    wide, I.WIDE = I.WIDE, 2
    try:
        found = as_dict(I.frequent_itemsets(frame(spark, rows), 0.1, min_size=1))
    finally:
        I.WIDE = wide
    assert found == brute(rows, I.needed(0.1, len(rows)))


def test_copies_of_a_basket_and_limits(spark):
    rows = [list("abc")] * 500 + [list("ab")] * 3 + [[]] * 7
    df = frame(spark, rows)
    assert as_dict(I.frequent_itemsets(df, 0.5)) == {("a", "b"): 503, ("a", "c"): 500, ("b", "c"): 500, ("a", "b", "c"): 500}
    assert as_dict(I.frequent_itemsets(df, 0.5, max_size=2)) == {("a", "b"): 503, ("a", "c"): 500, ("b", "c"): 500}
    assert as_dict(I.frequent_itemsets(df, 0.999)) == {}


def test_strict_support(spark):
    df = frame(spark, [["a"], ["a"], ["b"], ["c"]])
    assert as_dict(I.frequent_itemsets(df, 0.5, min_size=1)) == {("a",): 2}
    assert as_dict(I.frequent_itemsets(df, 0.5, min_size=1, strict=True)) == {}
    assert I.needed(0.1, 30) == 3 and I.needed(0.1, 30, strict=True) == 4 and I.needed(0.0, 5) == 1


def test_report(spark):
    row = I.as_report(I.frequent_itemsets(frame(spark, SAMPLE), 0.75)).head()
    assert (row.frequent_set, row.k, row.num, row.row_num, row.support) == ("B,E", 2, 3, 4, 0.75)


@pytest.mark.parametrize(
    ("text", "items"),
    [
        ("x,y,x", ["x", "y"]),
        ("x,,null,NULL, ,Null,z", ["x", "z"]),
        ("", []),
        ("y", ["y"]),
        (None, None),
        (" null ,\t", [" null "]),
    ],
)
def test_cleaning(spark, text, items):
    assert spark.createDataFrame([(text,)], "s string").select(B.split_items("s")).head()[0] == items


def test_baskets_of_and_longest(spark):
    rows = [(1, "b"), (1, "a"), (1, "a"), (2, "c"), (3, None)]
    built = B.baskets_of(spark.createDataFrame(rows, "t int, i string"), "t", "i")
    assert {r.t: r["items"] for r in built.collect()} == {1: ["a", "b"], 2: ["c"]}
    assert [(r["items"], r.n_items) for r in B.longest(built, 1).collect()] == [(["a", "b"], 2)]


@FEW
@given(BASKETS)
def test_predictions_equal_brute_force(spark, rows):
    df = frame(spark, rows)
    found = I.frequent_itemsets(df, 0.1, min_size=1)
    told = R.association_rules(found, 0.5)
    rules = [(set(r.antecedent), r.consequent) for r in told.collect()]
    for r in R.predict(df, told).collect():
        held = set(r["items"])
        assert r.prediction == sorted({c for a, c in rules if a <= held and c not in held})


@FEW
@given(BASKETS)
def test_containing_equals_brute_force(spark, rows):
    candidates = [["a"], ["a", "b"], ["b", "c", "d"], ["h"]]
    found = B.containing(frame(spark, rows), spark.createDataFrame([(c,) for c in candidates], "candidate array<string>"))
    want = {tuple(c): sum(set(c) <= r for r in rows) for c in candidates}
    assert {tuple(r.candidate): r.n for r in found.collect()} == {c: n for c, n in want.items() if n}


def test_trace_of_candidates(spark, tmp_path):
    I.frequent_itemsets(frame(spark, SAMPLE), 0.5, trace=str(tmp_path / "ck"))
    found = {(r.k, r.ck): r.num for r in spark.read.parquet(str(tmp_path / "ck")).collect()}
    # D is not frequent, so no candidate holds it; A,B and A,E are counted but do not pass.
    assert found == {
        (2, "A,B"): 1, (2, "A,C"): 2, (2, "A,E"): 1, (2, "B,C"): 2, (2, "B,E"): 3, (2, "C,E"): 2, (3, "B,C,E"): 2,
    }


@pytest.mark.parametrize("support", [0.07, 0.29, 0.1, 0.0042857])
@pytest.mark.parametrize("rows", [10**8, 3 * 10**9, 10**10, 10**11, 7])
def test_needed_is_exact(support, rows):
    exact = Fraction(str(support)) * rows
    least = I.needed(support, rows)
    assert least >= exact > least - 1
    assert I.needed(support, rows, strict=True) - 1 <= exact < I.needed(support, rows, strict=True)


def test_wide_sets_are_not_capped(spark):
    df = frame(spark, [[chr(97 + i) for i in range(12)]] * 3)
    found = I.frequent_itemsets(df, 0.5, min_size=1)
    assert found.count() == 4095
    assert [(r["items"], r.num) for r in I.maximal(found).collect()] == [([chr(97 + i) for i in range(12)], 3)]


def test_rules_need_single_items(spark):
    found = I.frequent_itemsets(frame(spark, SAMPLE), 0.5)
    with pytest.raises(ValueError, match="min_size=1"):
        R.association_rules(found, 0.5)
    with pytest.raises(ValueError, match="min_size=1"):
        R.with_lift(spark.createDataFrame([], "antecedent array<string>, consequent string, confidence double, num long"), found)


def test_an_item_of_every_basket_brings_no_fan_out(spark):
    rows = [["a", f"x{i}"] for i in range(200)]
    sets = spark.createDataFrame([(["a", f"x{i}"],) for i in range(0, 400, 2)], "candidate array<string>")
    met = B.with_met(B.numbered(frame(spark, rows)), sets, "candidate")
    assert met.count() == 100
    plan = met._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan


def test_fp_growth_asks_for_the_same_count():
    for support, rows in [(0.07, 3_000_000_000), (0.1, 30), (0.3, 10), (0.004, 1_000), (1.0, 7), (0.0, 5), (0.0042857, 10**12)]:
        assert math.ceil(I.share_for(support, rows) * rows) == I.needed(support, rows)
    assert I.share_for(0.5, 0) == 0.0
