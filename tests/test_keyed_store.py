"""A keyed table of buckets: what a batch touches, and what happens when a write fails."""

import random
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from millrace.operators.keyed_store import KeyedStore
from millrace.operators.upsert import apply_changes, upsert

SCHEMA = "id long, name string, amount double, day int"


def table(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


def files(store):
    return {str(p): p.stat().st_mtime_ns for p in Path(store.path, "data").rglob("*.parquet")}


@pytest.fixture
def store(spark, tmp_path):
    base = [(i, f"n{i}", float(i), 0) for i in range(200)] + [(None, "no key", 1.0, 0), (None, "no key", 1.0, 0)]
    return KeyedStore.create(table(spark, base), str(tmp_path / "t"), ["id"], buckets=16)


def test_batches_equal_upserts_of_the_whole(spark, store):
    draw, want = random.Random(1), store.read().collect()
    for n in range(4):
        batch = table(spark, [(draw.randint(0, 260), f"b{n}", draw.random(), draw.randint(0, 5)) for _ in range(40)])
        want = upsert(table(spark, want), batch, ["id"], ["day", "amount"]).collect()
        store.upsert(batch, ["day", "amount"])
    key = lambda r: tuple(str(x) for x in r)
    assert sorted(map(tuple, store.read().collect()), key=key) == sorted(map(tuple, want), key=key)
    assert store.versions() == [0, 1, 2, 3, 4]
    assert store.read(0).count() == 202


def test_other_buckets_stay_as_they_are(spark, store):
    before, old = files(store), store.manifest()
    touched = store.upsert(table(spark, [(7, "new", 1.0, 1), (1007, "new", 1.0, 1)]), ["day"])
    assert 1 <= len(touched) <= 2
    after, new = files(store), store.manifest()
    assert before.items() <= after.items()
    assert {b for b in new if b >= 0 and new[b]["folder"] != old.get(b, {}).get("folder")} == touched
    plan = store.lookup(table(spark, [(7, "", 0.0, 0)])).inputFiles()
    assert {p.rsplit("/", 2)[1] for p in plan} <= {f"store_bucket={b}" for b in touched}
    assert [r["name"] for r in store.lookup(table(spark, [(7, "", 0.0, 0), (-5, "", 0.0, 0)])).collect()] == ["new"]


def test_changes_with_deletes_and_emptied_buckets(spark, store):
    rows = [(i, None, None, None, "delete", i, 0) for i in range(200) if i % 3]
    rows += [(3, "set", None, None, "update", 500, 0), (900, "new", 2.0, 1, "insert", 501, 0), (4, "again", 4.0, 2, "insert", 502, 0)]
    changes = spark.createDataFrame(rows, f"{SCHEMA}, action string, pos long, ordinal int")
    want = apply_changes(store.read(), changes, ["id"], ["pos", "ordinal"]).collect()
    store.apply(changes, ["pos", "ordinal"])
    key = lambda r: tuple(str(x) for x in r)
    assert sorted(map(tuple, store.read().collect()), key=key) == sorted(map(tuple, want), key=key)
    everything = spark.createDataFrame([(r["id"], None, None, None, "delete", 9000, 0) for r in want if r["id"] is not None], changes.schema)
    store.apply(everything, ["pos", "ordinal"])
    assert [tuple(r) for r in store.read().collect()] == [(None, "no key", 1.0, 0)] * 2


def test_a_batch_counts_once(spark, store):
    add = table(spark, [(1, "first", 1.0, 1)])
    assert store.upsert(add, ["day"], batch_id=0)
    assert store.upsert(table(spark, [(1, "second", 1.0, 1)]), ["day"], batch_id=0) == set()
    assert store.lookup(add).head()["name"] == "first"
    assert store.upsert(add.limit(0), ["day"], batch_id=1) == set() and store.manifest()[-1]["batch"] == 1


def test_a_failed_write_leaves_the_version_before(spark, store):
    bad = table(spark, [(1, "x", 1.0, 1), (2, "y", 1.0, 1)]).withColumn("name", F.when(F.col("id") < 2, F.col("name")).otherwise(F.raise_error(F.lit("lost"))))
    before = store.manifest()
    with pytest.raises(Exception, match="lost"):
        store.upsert(bad, ["day"])
    assert store.manifest() == before and store.read().count() == 202
    store.upsert(table(spark, [(1, "x", 1.0, 1)]), ["day"])
    assert store.lookup(table(spark, [(1, "", 0.0, 0)])).head()["name"] == "x"


def test_old_versions_go_with_their_files(spark, store):
    for n in range(4):
        store.upsert(table(spark, [(i, f"v{n}", 0.0, n) for i in range(200)]), ["day"])
    want = sorted(map(str, store.read().collect()))
    assert len(store.expire(keep=1)) == 4
    assert store.versions() == [4] and sorted(map(str, store.read().collect())) == want


def test_what_create_refuses_and_an_empty_table(spark, store, tmp_path):
    with pytest.raises(ValueError, match="share a key"):
        KeyedStore.create(table(spark, [(1, "a", 0.0, 0), (1, "b", 0.0, 0)]), str(tmp_path / "u"), ["id"])
    with pytest.raises(ValueError, match="there is a table"):
        KeyedStore.create(table(spark, []), store.path, ["id"])
    empty = KeyedStore.create(table(spark, []), str(tmp_path / "e"), ["id", "name"], buckets=3)
    assert empty.read().count() == 0
    empty.upsert(table(spark, [(1, "a", 0.0, 0), (1, "b", 0.0, 0), (1, "a", 1.0, 5)]), ["day"])
    assert sorted(map(tuple, empty.read().collect())) == [(1, "a", 1.0, 5), (1, "b", 0.0, 0)]
