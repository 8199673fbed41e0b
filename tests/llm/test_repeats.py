import random

import numpy as np
import pytest

from millrace.llm import repeats


def brute(rows, length):
    first: dict = {}
    key = lambda i: repeats.LAST if i is None else i
    for ident, text in rows:
        raw = (text or "").encode()
        for i in range(len(raw) - length + 1):
            first[raw[i : i + length]] = min(first.get(raw[i : i + length], key(ident)), key(ident))
    out = []
    for ident, text in rows:
        raw = (text or "").encode()
        gone = np.zeros(len(raw), bool)
        for i in range(len(raw) - length + 1):
            if first[raw[i : i + length]] < key(ident):
                gone[i : i + length] = True
        runs = int(np.diff(np.concatenate(([0], gone.astype(int)))).clip(0).sum()) if len(raw) else 0
        out.append((str(ident), len(raw), int(gone.sum()), runs, np.frombuffer(raw, np.uint8)[~gone].tobytes()))
    return sorted(out)


def got(df):
    columns = ("doc_id", "n_bytes", "n_removed", "n_spans", "kept")
    return sorted((str(r[0]), *r[1:4], bytes(r[4])) for r in df.select(*columns).collect())


def test_equals_brute_force(documents, corpus):
    assert got(repeats.remove_repeats(documents.withColumnRenamed("lang", "tag"))) == brute([r[:2] for r in corpus], 50)


@pytest.mark.parametrize("flush", [repeats.FLUSH, 200])
def test_passages_edges_and_repeated_ids(spark, monkeypatch, flush):
    monkeypatch.setattr(repeats, "FLUSH", flush)
    draw = random.Random(12)
    letters = lambda n: "".join(draw.choices("abcé ", k=n))
    passage = letters(130)
    rows = []
    for i in range(60):
        cut = sorted(draw.sample(range(130), 2))
        rows.append((i // 2 if i % 7 == 0 else i, letters(draw.randint(0, 90)) + passage[cut[0] : cut[1]] + letters(draw.randint(0, 90))))
    rows += [(None, passage), (None, passage), (3, passage), (200, "a" * 500), (201, "a" * 300), (202, "ab" * 200), (203, None), (204, ""), (205, passage)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(6)
    assert got(repeats.remove_repeats(docs)) == brute(rows, 50)
    assert got(repeats.remove_repeats(docs, length=20)) == brute(rows, 20)


def test_short_and_empty(spark, nothing):
    rows = [(1, "short"), (2, "short"), (3, None), (4, "x" * 49), (5, "x" * 49)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert got(repeats.remove_repeats(docs)) == brute(rows, 50)
    assert repeats.remove_repeats(nothing).count() == 0


def test_pieces_shorter_than_a_string_leave_before_places_are_dealt(spark, monkeypatch):
    draw = random.Random(5)
    letters = lambda n: "".join(draw.choices("abcdefgh ", k=n))
    pieces = [letters(36) for _ in range(20)]
    rows = [(i, "".join(letters(45) + draw.choice(pieces) for _ in range(10))) for i in range(100)]
    rows.append((500, letters(20) + rows[7][1][100:300] + letters(20)))
    dealt, met = [], repeats._met

    def seen(places, *more):
        dealt.append(sum(len(row["ranks"] or b"") for row in places.select("ranks").collect()))
        return met(places, *more)

    monkeypatch.setattr(repeats, "_met", seen)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    assert got(repeats.remove_repeats(docs)) == brute(rows, 50)
    assert len(dealt) == 2 and sum(dealt) < 2000


def test_ranks_of_halves_spread_over_all_ranges():
    draw = random.Random(6)
    ranks = repeats.Ranks(50)
    ranks.read(bytes(draw.choices(range(97, 123), k=20000)))
    share = (ranks.halves(ranks.stretches()) >> np.uint64(62)).astype(int)
    assert np.bincount(share, minlength=4).min() > 0.2 * len(share)
