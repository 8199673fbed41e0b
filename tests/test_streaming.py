"""Streams over several files, also stopped and started again."""

import json
import os
import random
import time
from collections import Counter
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from millrace.operators.wordcount import words
from millrace.streaming import arrivals, changes, counts, keyed_state
from millrace.streaming.sources import BatchLog, SnapshotLog, file_stream, run_available, start


@pytest.fixture
def lines(tmp_path):
    """Write a text file per call, each newer than the one before."""
    folder = tmp_path / "in"
    folder.mkdir()

    def put(*texts):
        n = len(list(folder.iterdir()))
        path = folder / f"{n:03}.txt"
        path.write_text("".join(t + "\n" for t in texts))
        # Files are read by age; written within one millisecond they would have the same.
        os.utime(path, (1_700_000_000 + n, 1_700_000_000 + n))

    put.folder = str(folder)
    return put


def stream_of(spark, lines, per_batch=1):
    return file_stream(spark, lines.folder, "value string", fmt="text", files_per_batch=per_batch)


def test_batch_counts(spark, lines, tmp_path):
    lines("a b a")
    lines("a", "b c")
    log = BatchLog(spark, "word string, count long")
    found = counts.batch_counts(words(stream_of(spark, lines), "value"), "word", log)
    assert {(r.batch_id, r.word, r["count"]) for r in found.collect()} == {
        (0, "a", 2), (0, "b", 1), (1, "a", 1), (1, "b", 1), (1, "c", 1),
    }


def test_running_counts_go_on_after_a_restart(spark, lines, tmp_path):
    schema, checkpoint = "word string, count long", str(tmp_path / "checkpoint")
    log = BatchLog(spark, schema, str(tmp_path / "log"))
    lines("a b a", "a b a")
    lines("a b a", "a  x")
    stream = words(stream_of(spark, lines), "value", how="pieces", keep_blank=True)
    found = counts.running_counts(stream, "word", log, checkpoint)
    assert {r.word: r["count"] for r in found.collect()} == {"a": 7, "b": 3, "": 1, "x": 1}
    lines("x y")
    stream = words(stream_of(spark, lines), "value", how="pieces", keep_blank=True)
    found = counts.running_counts(stream, "word", BatchLog(spark, schema, str(tmp_path / "log")), checkpoint)
    assert {r.word: r["count"] for r in found.collect()} == {"a": 7, "b": 3, "": 1, "x": 2, "y": 1}
    again = counts.running_counts(stream, "word", log, checkpoint)
    assert {r.word: r["count"] for r in again.collect()} == {"a": 7, "b": 3, "": 1, "x": 2, "y": 1}


def test_a_repeated_batch_replaces_itself(spark):
    log = BatchLog(spark, "word string, count long")
    for n in (1, 2):
        log.put(spark.createDataFrame([("a", n)], "word string, count long"), 4)
    assert [tuple(r) for r in log.rows().collect()] == [("a", 2, 4)]


def test_no_files_no_rows(spark, tmp_path):
    (tmp_path / "none").mkdir()
    log = BatchLog(spark, "word string, count long")
    stream = spark.readStream.schema("value string").text(str(tmp_path / "none"))
    assert counts.batch_counts(words(stream, "value"), "word", log).count() == 0


def arrival_job(spark, forget=None):
    schemas = ["word string, seq long, n long", "word string, n long", "word string, n long"]
    return arrivals.Arrivals("word", ["seq"], *(BatchLog(spark, s) for s in schemas), forget=forget)


def arrival_stream(spark, lines):
    parts = F.split("value", ":")
    return stream_of(spark, lines).select(F.get(parts, F.lit(1)).alias("word"), F.get(parts, F.lit(0)).cast("long").alias("seq"))


def test_arrivals_are_numbered_across_batches(spark, lines, monkeypatch):
    monkeypatch.setattr(arrivals, "FOLD_EVERY", 2)
    rng, seq, want, seen = random.Random(1), 0, set(), Counter()
    for _ in range(5):
        texts = []
        for _ in range(40):
            word = rng.choice(["hot", "hot", "a", "b", f"rare{seq}"])
            seen[word] += 1
            want.add((word, seq, seen[word]))
            texts.append(f"{seq}:{word}")
            seq += 1
        rng.shuffle(texts)
        lines(*texts)
    found = arrival_job(spark).run(arrival_stream(spark, lines))
    assert {(r.word, r.seq, r.n) for r in found.collect()} == want


def test_arrivals_can_forget_a_key(spark, lines):
    lines("1:x", "2:x", "3:y")
    lines("4:x", "5:y")
    lines("6:x")
    found = arrival_job(spark, forget=lambda total: total >= 3).run(arrival_stream(spark, lines))
    assert {(r.seq, r.n) for r in found.collect()} == {(1, 1), (2, 2), (3, 1), (4, 3), (5, 2), (6, 1)}


def timed(spark, lines):
    parts = F.split("value", ";")
    ts = F.get(parts, F.lit(0)).cast("timestamp")
    return stream_of(spark, lines).select(ts.alias("ts"), F.get(parts, F.lit(1)).alias("word"))


def test_windows_and_days(spark, lines):
    rng, start = random.Random(2), datetime(2024, 1, 1, 23, 58)
    rows = [(start + timedelta(seconds=rng.randrange(240)), rng.choice("aaabcdefg")) for _ in range(150)]
    for i in range(3):
        lines(*(f"{ts:%Y-%m-%d %H:%M:%S};{word}" for ts, word in rows[i::3]))
    log = BatchLog(spark, "start timestamp, word string, count long")
    found = counts.window_counts(timed(spark, lines), "ts", "word", log)
    want = Counter()
    for ts, word in rows:
        last = ts - timedelta(seconds=ts.second % 10)
        for back in range(6):
            want[last - timedelta(seconds=10 * back), word] += 1
    text = found.select(F.date_format("start", "yyyy-MM-dd HH:mm:ss"), "word", "count").collect()
    assert {(r[0], r[1]): r[2] for r in text} == {(f"{s:%Y-%m-%d %H:%M:%S}", w): n for (s, w), n in want.items()}

    top = counts.top_per_window(found, "word").collect()
    per_window = Counter(r.start for r in top)
    assert max(per_window.values()) == 5
    for r in top:
        start_text = f"{r.start:%Y-%m-%d %H:%M:%S}"
        ranked = sorted(((-n, w) for (s, w), n in want.items() if f"{s:%Y-%m-%d %H:%M:%S}" == start_text))
        assert ranked[r.rn - 1] == (-r["count"], r.word)

    log = BatchLog(spark, "dt date, word string, count long")
    days = counts.daily_totals(timed(spark, lines), "ts", "word", log, lateness="2 days")
    assert {(r.dt, r.word): r["count"] for r in days.collect()} == Counter((ts.date(), w) for ts, w in rows)


def change(pos, action, row):
    key = "after_values" if action == "update" else "values"
    head = {"log_pos": pos, "schema": "s", "table": "t", "table_pk": "id", "action": action}
    return json.dumps(head | {"data": [{key: row}]})


def test_changes_apply_in_log_order_whatever_the_batches(spark, lines):
    lines(change(3, "update", {"id": 1, "v": "later"}), change(1, "insert", {"id": 1, "v": "first"}))
    lines(change(2, "update", {"id": 1, "v": "between"}), change(5, "delete", {"id": 7, "v": "x"}))
    lines(change(4, "insert", {"id": 7, "v": "x"}), change(6, "insert", {"id": 8, "v": "new"}))
    log = BatchLog(spark, "id long, v string, action string, log_pos long, ordinal int, present array<string>")
    collected = changes.collect_changes(stream_of(spark, lines), "s.t", {"id": "long", "v": "string"}, log)
    base = spark.createDataFrame([(1, "old"), (9, "kept")], "id long, v string")
    assert sorted(map(tuple, changes.merged(base, collected, ["id"]).collect())) == [(1, "later"), (8, "new"), (9, "kept")]

    texts = BatchLog(spark, "log_pos long, `table` string, action string, sql string")
    told = {r.log_pos: r.sql for r in changes.statements(stream_of(spark, lines), texts).collect()}
    assert told[6] == "insert into s.t values (8, 'new')" and len(told) == 6


def test_one_file_as_a_stream(spark, tmp_path):
    spark.range(7).coalesce(1).write.parquet(str(tmp_path / "t"))
    part = next((tmp_path / "t").glob("part-*"))
    part.rename(tmp_path / "one.parquet")
    spark.range(5).write.parquet(str(tmp_path / "other.parquet"))
    log = BatchLog(spark, "id long")
    run_available(file_stream(spark, str(tmp_path / "one.parquet")), log.put)
    assert log.rows().count() == 7
    log = BatchLog(spark, "id long")
    run_available(file_stream(spark, str(tmp_path / "other.parquet")), log.put)
    assert log.rows().count() == 5


def keyed_rows(spark, lines, log, checkpoint, **how):
    parts = F.split("value", ":")
    stream = stream_of(spark, lines).select(F.get(parts, F.lit(1)).alias("word"), F.get(parts, F.lit(0)).cast("long").alias("seq"))
    run_available(keyed_state.numbered(stream, "word", **how), log.put, mode="update", checkpoint=checkpoint)
    return sorted((r.word, r.batch_id, r.n) for r in log.rows().collect())


def test_keyed_state_goes_on_after_a_restart_and_can_be_removed(spark, lines, tmp_path):
    lines("1:x", "2:x", "3:y", "4:x")
    lines("5:x", "6:y")
    log = BatchLog(spark, "word string, seq long, n long", str(tmp_path / "log"))
    keyed_rows(spark, lines, log, str(tmp_path / "c"), limit=4)
    lines("7:x", "8:y", "9:z")
    log = BatchLog(spark, "word string, seq long, n long", str(tmp_path / "log"))
    assert keyed_rows(spark, lines, log, str(tmp_path / "c"), limit=4) == [
        ("x", 0, 1), ("x", 0, 2), ("x", 0, 3), ("x", 1, 4), ("x", 2, 1), ("y", 0, 1), ("y", 1, 2), ("y", 2, 3), ("z", 2, 1),
    ]
    with pytest.raises(ValueError, match="positive"):
        keyed_state.numbered(stream_of(spark, lines), "value", limit=0)


def test_idle_keys_are_removed(spark, lines, tmp_path):
    log = BatchLog(spark, "word string, n long", str(tmp_path / "log"))

    def seen(count):
        until = time.time() + 40
        while len(found := sorted((r.batch_id, r.word, r.n) for r in log.rows().collect())) < count and time.time() < until:
            time.sleep(0.3)
        return [r[1:] for r in found]

    lines("x", "x")
    words_ = stream_of(spark, lines).select(F.col("value").alias("word"))
    query = start(keyed_state.numbered(words_, "word", idle_ms=1), log.put, str(tmp_path / "c"), every="100 milliseconds", mode="update")
    try:
        assert seen(2) == [("x", 1), ("x", 2)]
        lines("y")  # the timer of x fires in this batch, if not before
        assert len(seen(3)) == 3
        lines("x")
        assert seen(4)[-1] == ("x", 1)
    finally:
        query.stop()


def test_panes_make_the_same_windows_and_count_late_rows(spark, lines):
    rng, start, want = random.Random(7), datetime(2024, 1, 1), Counter()
    for part in range(4):
        texts = []
        for _ in range(60):
            at = start + timedelta(seconds=part * 100 + rng.random() * 100)
            word = rng.choice("aab")
            texts.append(f"{at.isoformat(sep=' ')};{word}")
            pane = int((at - start).total_seconds()) // 10 * 10
            for back in range(6):
                want[start + timedelta(seconds=pane - 10 * back), word] += 1
        lines(*texts)
    log = SnapshotLog(spark, "start timestamp, word string, count long", ["start", "word"], fan=2)
    query = counts.pane_counts(timed(spark, lines), "ts", "word", log, lateness="30 seconds")
    panes = log.current()
    found = counts.windows_of_panes(panes, "word").collect()
    assert {(r.start, r.word): r["count"] for r in found} == dict(want)
    assert panes.agg(F.sum("count")).head()[0] == 240 and counts.late_rows(query) == 0
    with pytest.raises(ValueError, match="whole number"):
        counts.windows_of_panes(panes, "word", 60, 7)


def test_rows_beyond_the_lateness_are_counted_as_late(spark, lines):
    lines("2024-01-01 00:00:01;a", "2024-01-01 00:10:00;a")
    lines("2024-01-01 00:20:00;a")
    lines("2024-01-01 00:00:02;a", "2024-01-01 00:19:59;b")
    log = SnapshotLog(spark, "start timestamp, word string, count long", ["start", "word"])
    query = counts.pane_counts(timed(spark, lines), "ts", "word", log, lateness="1 minute")
    assert counts.late_rows(query) == 1
    assert sorted((r.start.minute, r.word, r["count"]) for r in log.current().collect()) == [(0, "a", 1), (10, "a", 1), (19, "b", 1), (20, "a", 1)]
