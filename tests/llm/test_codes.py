import hashlib
import math
import random

import numpy as np
import pytest

from millrace.llm import codes
from millrace.llm.queries import op13

SCHEMA = "vec_id long, embedding array<float>, label int"


def brute(rows, parts=8, entries=16, rounds=6):
    """Plain Python: sorted (vec_id, code, error, label_error), and the digest of the codebooks."""
    kept = [(i, [math.floor(4096 * float(np.float32(x))) for x in v], label) for i, v, label in rows]
    width = len(kept[0][1]) // parts
    cut = lambda v: [v[p * width : (p + 1) * width] for p in range(parts)]
    start = sorted((i, v) for i, v, _ in kept)[:entries]
    books = [[list(cut(v)[p]) for _, v in start] for p in range(parts)]
    far = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b, strict=True))
    nearest = lambda part, book: min(range(len(book)), key=lambda e: (far(part, book[e]), e))
    for _ in range(rounds):
        for p in range(parts):
            held: dict = {}
            for _, v, _ in kept:
                held.setdefault(nearest(cut(v)[p], books[p]), []).append(cut(v)[p])
            for e, own in held.items():
                books[p][e] = [sum(x) // len(own) for x in zip(*own, strict=True)]
    out, labels = [], {}
    for i, v, label in kept:
        chosen = [nearest(part, book) for part, book in zip(cut(v), books, strict=True)]
        error = sum(far(part, books[p][e]) for p, (part, e) in enumerate(zip(cut(v), chosen, strict=True)))
        labels[label] = labels.get(label, 0) + error
        out.append((i, "".join(f"{e:02x}" for e in chosen), error, label))
    text = ",".join(str(x) for book in books for entry in book for x in entry)
    return sorted((i, c, e, labels[label]) for i, c, e, label in out), hashlib.sha256(text.encode()).hexdigest()


@pytest.fixture(scope="module")
def rows():
    draw = random.Random(11)
    centres = [[draw.gauss(0, 0.3) for _ in range(16)] for _ in range(6)]
    found = [(i * 3 % 1009, [x + draw.gauss(0, 0.05) for x in draw.choice(centres)], draw.choice((0, 1, None))) for i in range(500)]
    found += [(2000 + i, found[7][1], 5) for i in range(300)]  # copies
    found += [(3000 + i, [draw.choice((-0.25, 0.25)) for _ in range(16)], 1) for i in range(60)]  # ties
    return found


def run(spark, tmp_path, rows, parts=4):
    path = f"{tmp_path}/t{len(rows)}"
    df = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "1 AS code", "2 AS width", "'x' AS c0")
    df.repartition(parts).write.parquet(f"{path}/embeddings.parquet")
    return op13(spark, path).collect()


def test_query_equals_brute_force(spark, tmp_path, rows):
    bad = [(5000, None, 1), (5001, [0.1, None] * 8, 1), (-5002, [float("nan")] * 16, 1), (-5003, [float("-inf")] * 16, None)]
    got = run(spark, tmp_path, rows + bad)
    wanted, digest = brute(rows)
    assert sorted((r["vec_id"], r["code"], r["error"], r["label_error"]) for r in got) == wanted
    assert {r["codebooks_sha256"] for r in got} == {digest}


def test_few_rows_and_large_numbers(spark, tmp_path):
    draw = random.Random(3)
    few = [(i, [draw.gauss(0, 1) for _ in range(8)], 1) for i in range(5)] + [(2, [0.5] * 8, 1)]
    wanted, digest = brute(few)
    got = run(spark, tmp_path, few)
    assert sorted((r["vec_id"], r["code"], r["error"], r["label_error"]) for r in got) == wanted
    large = [(i, [draw.gauss(0, 3e5) for _ in range(8)], 1) for i in range(50)]
    wanted, digest = brute(large)
    got = run(spark, tmp_path, large)
    assert sorted((r["vec_id"], r["code"], r["error"], r["label_error"]) for r in got) == wanted
    assert {r["codebooks_sha256"] for r in got} == {digest}


def test_null_ids_lengths_and_empty_table(spark, tmp_path):
    odd = [(None, [1.0] * 8, 1), (4, [2.0] * 8, 1), (5, [], None), (6, [1.0, 2.0, 3.0], 1), (7, [1e30] * 3, 1)]
    got = {(r["vec_id"], r["code"], r["error"]) for r in run(spark, tmp_path, odd)}
    assert {(None, "00" * 8, 8 * 2048**2), (4, "00" * 8, 8 * 2048**2), (5, "00" * 8, 0), (6, "00" * 8, 0), (7, "010101" + "00" * 5, 0)} == got
    assert run(spark, tmp_path, [(1, None, 1)]) == []


def test_trees_cover_and_spare_comparisons():
    draw = np.random.default_rng(2)
    points = np.concatenate([draw.normal(c, 20, (500, 4)) for c in (0, 2000, 5000, -3000)]).astype(np.int64)
    tree = codes.cover_tree(points)
    held = points[tree.order]
    assert sorted(tree.order.tolist()) == list(range(2000))
    for k in range(len(tree.first)):
        inside = held[tree.first[k] : tree.last[k]]
        assert np.sqrt(((inside - inside[0]) ** 2).sum(axis=1)).max() <= tree.radius[k]
        spans = [(tree.first[c], tree.last[c]) for c in range(tree.child[k], tree.child[k] + tree.children[k])]
        if spans:
            assert [s[0] for s in spans] == [tree.first[k], *[s[1] for s in spans[:-1]]] and spans[-1][1] == tree.last[k]
            heads = held[[s[0] for s in spans]]
            gaps = np.sqrt(((heads[:, None] - heads[None]) ** 2).sum(axis=2)) + np.eye(len(heads)) * 1e9
            assert gaps.min() > tree.radius[k] / 2
    book = np.array([[0] * 4, [2000] * 4, [5000] * 4, [-3000] * 4, [2100] * 4])
    first, last, entry, compared = codes.assign(tree, held, book)
    got = np.zeros(2000, np.int64)
    for a, b, e in zip(first, last, entry, strict=True):
        got[a:b] = e
    assert (got == ((held[:, None] - book[None]) ** 2).sum(axis=2).argmin(axis=1)).all()
    assert (last - first).sum() == 2000 and compared < 1000
