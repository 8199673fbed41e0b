import random
import re

import numpy as np
from pyspark.sql import functions as F

from millrace.llm import mixing

SIZE = re.compile(r"[^\x20\x09-\x0D]+")


def targets(sizes: dict) -> dict:
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: i % 3 + 1 for i, s in enumerate(order)}
    total, capped = sum(sizes.values()), set()
    while True:
        free = [s for s in order if s not in capped]
        left = total - sum(3 * sizes[s] for s in capped)
        level = left / sum(weight[s] for s in free) if free else 0
        over = {s for s in free if weight[s] * level > 3 * sizes[s]}
        if not over:
            return {s: 3 * sizes[s] if s in capped else weight[s] * level for s in order}
        capped |= over


def test_targets_sizes_and_bounds(spark):
    draw = random.Random(5)
    rows = []
    for source, count in ((None, 900), ("b", 300), ("a", 30), ("é", 500), ("Z", 1), ("tiny", 3)):
        rows += [(len(rows) + i, " w" * draw.randint(0, 60), source, "clash") for i in range(count)]
    rows += [(9000, None, "a", "clash"), (9001, "", "b", "clash"), (None, "one two", "b", "clash"), (None, "one two", "b", "clash")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, copies string").repartition(3)
    got = mixing.decide(docs).collect()
    assert sum(r["repeats"] for r in got) == len(rows)
    sizes: dict = {}
    for _, text, source, _ in rows:
        sizes[source] = sizes.get(source, 0) + len(SIZE.findall(text or ""))
    want = targets(sizes)
    taken = dict.fromkeys(sizes, 0)
    for r in got:
        assert r["source_size"] == sizes[r["source"]]
        assert abs(r["target"] - want[r["source"]]) < 1e-6
        assert 0 <= r["copies"] <= 3
        assert 0 <= r["more"] < r["repeats"]
        taken[r["source"]] += r["size"] * (r["copies"] * r["repeats"] + r["more"])
    for source in sizes:
        assert abs(taken[source] - want[source]) <= 60, source
    again = mixing.decide(docs.repartition(7)).collect()
    assert sorted(map(str, got)) == sorted(map(str, again))
    mixed = mixing.mixed(docs)
    assert mixed.columns == docs.columns
    assert mixed.agg(F.sum(F.coalesce(F.regexp_count("text", F.lit(mixing.WORD)), F.lit(0)))).first()[0] == sum(taken.values())


def test_flight_keeps_both_sums():
    draw = np.random.default_rng(1)
    sizes = list(map(float, draw.integers(1, 500, 400)))
    chances = [0.37] * 400
    moved = mixing.flight(sizes, chances, draw)
    assert sum(0 < p < 1 for p in moved) <= 2
    assert abs(sum(moved) - 0.37 * 400) < 1e-6
    assert abs(np.dot(sizes, moved) - 0.37 * sum(sizes)) < 1e-4


def test_chances_are_kept_on_average():
    sizes, total = [3.0, 8.0, 1.0, 8.0, 20.0, 7.0], np.zeros(6)
    for seed in range(2000):
        total += mixing.flight(sizes, [0.3] * 6, np.random.default_rng(seed))
    assert np.abs(total / 2000 - 0.3).max() < 0.04


def test_blocks_meet(spark, monkeypatch):
    monkeypatch.setattr(mixing, "BLOCK", 50)
    docs = spark.range(3000).selectExpr("id doc_id", "repeat('w ', cast(1 + id * 7919 % 40 as int)) text", "cast(id % 2 as string) source")
    sums = mixing.decide(docs).groupBy("source").agg(F.sum(F.col("size") * F.col("copies")).alias("t"), F.first("target").alias("w"))
    assert all(abs(r["t"] - r["w"]) <= 40 for r in sums.collect())


def test_empty_table_and_no_words(spark, nothing):
    assert mixing.decide(nothing).count() == 0
    blank = spark.createDataFrame([(1, "", "a"), (2, None, None)], "doc_id long, text string, source string")
    assert [r["target"] for r in mixing.decide(blank).collect()] == [0.0, 0.0]


def test_repeated_rows_are_balanced_as_rows(spark):
    draw = random.Random(3)
    rows = [(i, " w" * draw.randint(10, 60), "a", "x", i) for i in range(200)] + [(500, " w" * 40, "a", "y", 7)] * 200
    rows += [(1000 + i, " w" * 30, "b", None, i) for i in range(100)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, _copies string, row long").repartition(4)
    got = mixing.decide(docs).collect()
    sizes = {s: sum(len(t.split()) for _, t, q, _, _ in rows if q == s) for s in "ab"}
    want = targets(sizes)
    for source in "ab":
        own = [r for r in got if r["source"] == source]
        assert abs(sum(r["size"] * (r["copies"] * r["repeats"] + r["more"]) for r in own) - want[source]) <= 120, source
        share = want[source] / sizes[source]
        documents = sum(1 for r in rows if r[2] == source) * share
        assert abs(sum(r["copies"] * r["repeats"] + r["more"] for r in own) - documents) <= 3
    again = next(r for r in got if r["doc_id"] == 500)
    assert abs((again["copies"] * 200 + again["more"]) - 200 * want["a"] / sizes["a"]) <= 1
    mixed = mixing.mixed(docs)
    assert mixed.columns == docs.columns
    assert mixed.where("doc_id = 500").count() == again["copies"] * 200 + again["more"]
    assert mixed.count() == sum(r["copies"] * r["repeats"] + r["more"] for r in got)
