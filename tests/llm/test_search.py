import random

import numpy as np
import pytest

from millrace.llm import search


def brute(rows, queries, k):
    out = []
    for q, v in queries:
        scored = sorted((-sum(a * b for a, b in zip(v, w, strict=True)), i) for i, w in rows if i != q and len(w) == len(v))
        out += [(q, n + 1, i, -s) for n, (s, i) in enumerate(scored[:k])]
    return sorted(out)


def whole(v, scale=1024):
    return [int(np.floor(scale * float(x))) for x in v]


@pytest.fixture(scope="module")
def vectors():
    draw = random.Random(1)
    rows = [(i, [draw.gauss(0, 0.2) for _ in range(12)]) for i in range(300)]
    rows += [(1000 + i, rows[5][1]) for i in range(20)]  # ties
    rows += [(2000 + i, [0.5, -2.0]) for i in range(3)]  # another length
    return rows


def test_equals_brute_force(spark, vectors):
    bad = [(5000, None), (5001, [0.1, None]), (5002, [float("nan")]), (5003, [float("inf")] * 12), (None, [0.1] * 12)]
    df = spark.createDataFrame(vectors + bad, "vec_id long, embedding array<float>").repartition(4)
    kept = [(i, whole(np.array(v, np.float32))) for i, v in vectors]
    points = search.quantised(df, "vec_id", "embedding", 1024)
    got = sorted(map(tuple, search.top_k(points, points.where("vec_id % 50 = 0"), 10, blocks=3).collect()))
    assert got == brute(kept, [r for r in kept if r[0] % 50 == 0], 10)


def test_fewer_candidates_than_k_and_empty_tables(spark):
    df = spark.createDataFrame([(1, [1.0]), (2, [2.0])], "vec_id long, embedding array<float>")
    points = search.quantised(df, "vec_id", "embedding", 4)
    assert sorted(map(tuple, search.top_k(points, points, 10).collect())) == [(1, 1, 2, 32), (2, 1, 1, 32)]
    assert search.top_k(points.limit(0), points.limit(0), 10).count() == 0


@pytest.mark.parametrize("seed", range(4))
def test_one_block(seed):
    draw = np.random.default_rng(seed)
    values = draw.integers(-(2**20) if seed else -3, 2**20 if seed else 3, (130, 5))
    ids = np.arange(130)
    low = values.min(axis=0)
    above = (values - low).astype(np.uint64)
    bits = int(above.max()).bit_length()
    slices = np.stack([search._packed(((above >> np.uint64(b)) & np.uint64(1)).T.astype(bool)) for b in range(bits)], axis=1)
    query = values[7]
    found, scores = search.search_block(query, 7, ids, low, slices, 10)
    exact = sorted((-int(v @ query), i) for i, v in enumerate(values) if i != 7)[:10]
    assert sorted(zip([-s for s in scores], found.tolist(), strict=True)) == exact
