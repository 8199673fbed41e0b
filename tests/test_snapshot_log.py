"""A table kept as levels of runs: how many there are, and batches that run again."""

import random
from pathlib import Path

import pytest

from millrace.streaming.sources import SnapshotLog

SCHEMA = "word string, count long"


def put(spark, log, rows, batch_id):
    log.put(spark.createDataFrame(rows, SCHEMA), batch_id)


def table(log):
    return {r["word"]: r["count"] for r in log.current(["word"]).collect()}


def test_many_batches_in_a_bounded_number_of_folders(spark, tmp_path):
    log, draw, want, most = SnapshotLog(spark, SCHEMA, ["word"], str(tmp_path), fan=4), random.Random(1), {}, 0
    for n in range(90):
        rows = [(f"w{draw.randint(0, 40)}", n * 100 + i) for i in range(3)]
        rows = list({w: (w, c) for w, c in rows}.values())
        want |= dict(rows)
        put(spark, log, rows, n)
        most = max(most, len(log.runs()))
        if n % 40 == 7:
            assert table(log) == want
    assert table(log) == want
    assert most <= 3 * 4  # three runs a level, log4(90) levels
    assert len(list(Path(tmp_path).glob("level=*/run=*"))) <= most + 5  # and what the last merge left
    assert len(list(Path(tmp_path).glob("head/batch_id=*"))) <= 2
    assert sum(last - first + 1 for _, first, last in log.runs()) == 90


def test_a_batch_that_runs_again_replaces_what_it_wrote(spark, tmp_path):
    log = SnapshotLog(spark, SCHEMA, ["word"], str(tmp_path), fan=2)
    for n in range(3):
        put(spark, log, [("a", n), (f"k{n}", n)], n)
    put(spark, log, [("a", 30), ("x", 30)], 3)  # merges runs of two levels
    assert len(log.runs()) == 1
    put(spark, log, [("a", 3), ("y", 3)], 3)  # the same batch, other rows
    assert table(log) == {"a": 3, "y": 3, "k0": 0, "k1": 1, "k2": 2}
    put(spark, log, [("a", 4)], 4)
    assert table(log)["a"] == 4


def test_a_failure_between_run_and_head_changes_nothing(spark, tmp_path, monkeypatch):
    log = SnapshotLog(spark, SCHEMA, ["word"], str(tmp_path), fan=2)
    put(spark, log, [("a", 0)], 0)
    held = SnapshotLog._folder
    monkeypatch.setattr(SnapshotLog, "_folder", lambda self, run: 1 / 0 if run[0] == 1 else held(self, run))
    with pytest.raises(ZeroDivisionError):
        put(spark, log, [("a", 1)], 1)
    monkeypatch.undo()
    assert table(log) == {"a": 0}
    put(spark, log, [("a", 1)], 1)
    assert table(log) == {"a": 1}


def test_no_batches_empty_batches_and_wrong_keys(spark, tmp_path):
    log = SnapshotLog(spark, SCHEMA, ["word"], str(tmp_path), fan=3)
    assert table(log) == {}
    for n in range(4):
        put(spark, log, [], n)
    put(spark, log, [(None, 1)], 4)
    assert table(log) == {None: 1}
    with pytest.raises(ValueError, match="kept by"):
        log.current(["count"])
    with pytest.raises(ValueError, match="two or more"):
        SnapshotLog(spark, SCHEMA, ["word"], fan=1)
