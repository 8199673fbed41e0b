import random
from fractions import Fraction

import numpy as np
import pytest

from millrace.llm import whitening
from millrace.llm.queries import op11

SCHEMA = "vec_id long, embedding array<float>, label int"


def brute(rows, k):
    """From Python's fractions: vec_id -> (n, deviation), the covariance, the centred rows."""
    kept = [(i, [int(np.floor(64 * float(np.float32(x)))) + 1_000_000 for x in v]) for i, v in rows]
    n, d = len(kept), len(kept[0][1])
    sums = [sum(v[j] for _, v in kept) for j in range(d)]
    deviations = sorted((i, sum((n * v[j] - sums[j]) ** 2 for j in range(d))) for i, v in kept)
    centred = np.array([[float(Fraction(n * v[j] - sums[j], n)) for j in range(d)] for _, v in kept])
    matrix = np.array([[float(Fraction(sum((n * v[a] - sums[a]) * (n * v[b] - sums[b]) for _, v in kept), n**3)) for b in range(d)] for a in range(d)])
    return n, deviations, matrix, {i: c for (i, _), c in zip(kept, centred, strict=True)}


@pytest.fixture(scope="module")
def vectors():
    draw = random.Random(5)
    rows = [(i, [draw.gauss(0.1 * j, 0.1 + 0.05 * j) for j in range(9)]) for i in range(300)]
    return rows + [(1000 + i, rows[3][1]) for i in range(150)]


def whitened(spark, rows, more=(), parts=5):
    data = [(i, v, 1) for i, v in rows] + [(i, v, None) for i, v in more]
    df = spark.createDataFrame(data, SCHEMA).repartition(parts).withColumnRenamed("label", "width").withColumnRenamed("width", "n")
    models = whitening.fit(df, "embedding")
    return models, whitening.whiten(df, "vec_id", "embedding", models).collect()


def test_equals_brute_force(spark, vectors):
    bad = [(5000, None), (5001, [0.1, None] * 4), (5002, [float("nan")] * 9), (5003, [float("inf")] * 9)]
    models, got = whitened(spark, vectors, bad)
    n, deviations, matrix, centred = brute(vectors, 32)
    assert sorted((r["vec_id"], int(r["deviation"])) for r in got) == deviations
    assert {r["n"] for r in got} == {n} and {r["identity_error"] < 1e-11 for r in got} == {True}
    values, basis = np.linalg.eigh(matrix)
    values, basis = values[::-1], basis[:, ::-1]
    for row in got:
        assert np.allclose(row["explained"], values / values.sum(), rtol=1e-12)
        wanted = centred[row["vec_id"]] @ basis / np.sqrt(values)
        assert np.allclose(np.abs(row["whitened"]), np.abs(wanted), atol=1e-10)
    assert np.allclose(models[9].vectors @ matrix @ models[9].vectors.T, np.diag(values), atol=1e-10 * values[0])


def test_refinement_goes_past_double_precision_and_solves_clusters():
    draw = np.random.default_rng(1)
    basis = np.linalg.qr(draw.normal(size=(40, 40)))[0].astype(np.longdouble)
    for _ in range(3):  # orthogonal to the last extended bit
        basis = basis @ (1.5 * np.eye(40, dtype=np.longdouble) - 0.5 * basis.T @ basis)
    values = np.sort(draw.uniform(1, 100, 40))[::-1].astype(np.longdouble)
    values[5:10] = values[5] * (1 - np.arange(5) * np.longdouble(1e-9))  # far below what float32 tells apart
    values[20:23] = values[20]  # really equal
    values = np.sort(values)[::-1]
    matrix = (basis * values) @ basis.T
    found, vectors = whitening.eigenpairs((matrix + matrix.T) / 2)
    assert np.allclose(found, values.astype(float), rtol=1e-15)
    single = [i for i in range(40) if np.abs(np.delete(values, i) - values[i]).min() > 0]
    off = np.abs(np.abs((vectors @ basis.astype(float))[single, single]) - 1)
    assert off.max() < 1e-12
    rough = np.linalg.eigh(matrix.astype(np.float32))[1][:, ::-1]
    assert np.abs(np.abs((rough.T @ basis.astype(float))[single, single]) - 1).max() > 1e-3
    # What is left over is no more than of eigenvectors found in doubles at once.
    plain = np.linalg.eigh(matrix.astype(np.float64))[1][:, ::-1]
    error = lambda v: np.abs(matrix @ v - v * ((v * (matrix @ v)).sum(axis=0))).max()
    assert error(vectors.T.astype(np.longdouble)) <= error(plain.astype(np.longdouble))
    assert np.allclose(vectors @ vectors.T, np.eye(40), atol=4e-15)


def test_fewer_rows_than_dimensions_equal_rows_and_lengths(spark):
    rows = [(1, [0.5, 1.0, 2.0, 9.0]), (2, [0.25, 1.0, -2.0, 9.0]), (2, [0.25, 1.0, -2.0, 9.0]), (None, [3.0, 1.0, 0.0, 9.0]), (7, [1.0]), (8, []), (9, [])]
    models, got = whitened(spark, rows)
    assert len(got) == 7 and set(models) == {0, 1, 4}
    four = [r for r in got if len(r["whitened"]) == 4]
    assert {tuple(x is not None for x in r["whitened"]) for r in four} == {(True, True, False, False)}
    assert four[0]["identity_error"] < 1e-12 and abs(sum(four[0]["explained"]) - 1) < 1e-12
    alone = next(r for r in got if r["vec_id"] == 7)
    assert alone["whitened"] == [None] and alone["explained"] == [None] and alone["deviation"] == 0
    assert alone["n"] == 1 and alone["identity_error"] is None


def test_far_and_large_numbers_stay_exact(spark):
    draw = random.Random(2)
    rows = [(i, [1e9 + draw.random() * 1e9, -3e8 * draw.random(), draw.random()]) for i in range(50)] + [(99, [1e30, 0.0, 0.0])]
    _, got = whitened(spark, rows[:50])
    assert sorted((r["vec_id"], int(r["deviation"])) for r in got) == brute(rows[:50], 3)[1]
    assert len(whitened(spark, rows)[1]) == 51


def test_empty_table_and_query(spark, tmp_path):
    assert whitened(spark, [], [(1, None)])[1] == []
    spark.createDataFrame([(1, None, 1)], SCHEMA).write.parquet(f"{tmp_path}/none/embeddings.parquet")
    assert op11(spark, f"{tmp_path}/none").collect() == []
    draw = random.Random(8)
    data = [(i, [draw.gauss(0, 1) for _ in range(40)], 1) for i in range(120)]
    spark.createDataFrame(data, SCHEMA).write.parquet(f"{tmp_path}/some/embeddings.parquet")
    got = op11(spark, f"{tmp_path}/some").collect()
    assert len(got) == 120 * 32 and {r["component"] for r in got} == set(range(1, 33))
    assert got[0].asDict().keys() == {"vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"}
