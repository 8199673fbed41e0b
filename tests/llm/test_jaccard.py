import random
from collections import defaultdict

import numpy as np
import pytest

from millrace.llm import components as components_
from millrace.llm import jaccard
from millrace.llm.components import components
from millrace.session import written


def sets_of(rows):
    out = []
    for ident, text in rows:
        words = (text or "").encode().lower().split()
        if not words:
            out.append((ident, set()))
        elif len(words) < 5:
            out.append((ident, {tuple(words)}))
        else:
            out.append((ident, {tuple(words[i : i + 5]) for i in range(len(words) - 4)}))
    return out


def brute(rows, percent=80):
    sets = sets_of(rows)
    parent = list(range(len(sets)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    by = defaultdict(list)
    for place, (_, found) in enumerate(sets):
        common = defaultdict(int)
        for shingle in found:
            for other in by[shingle]:
                common[other] += 1
            by[shingle].append(place)
        for other, shared in common.items():
            if 100 * shared >= percent * (len(found) + len(sets[other][1]) - shared):
                parent[find(place)] = find(other)
    least: dict = {}
    for place, (ident, _) in enumerate(sets):
        root = find(place)
        if ident is not None:
            least[root] = min(least.get(root, ident), ident)
    return sorted((str(i), len(s), str(least.get(find(p), None) if s else i)) for p, (i, s) in enumerate(sets))


def got(df):
    return sorted((str(r[0]), r[1], str(r[2])) for r in df.select("doc_id", "n_shingles", "component_id").collect())


def test_equals_brute_force(spark, documents, corpus):
    clash = documents.withColumnRenamed("lang", "node").withColumnRenamed("source", "component")
    assert got(jaccard.similar_classes(clash)) == brute([r[:2] for r in corpus])


def test_groups_near_the_bound(spark):
    """A large group of copies with random edits, many pairs on either side of the bound, in chains."""
    draw = random.Random(6)
    base = [f"w{draw.randint(0, 300)}" for _ in range(150)]
    rows = [(500, " ".join(base)), (501, " ".join(base)), (None, " ".join(base)), (7, None), (8, ""), (7, "a b"), (9, "A B")]
    for i in range(150):
        words = list(base)
        for _ in range(draw.randint(0, 4)):
            words[draw.randrange(len(words))] = f"edit{draw.randint(0, 30)}"
        rows.append((1000 + i, " ".join(words)))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    assert got(jaccard.similar_classes(docs)) == brute(rows)


def test_leaves_of_a_tree(spark, monkeypatch):
    monkeypatch.setattr(jaccard, "LEAF", 4)
    monkeypatch.setattr(jaccard, "HUBS", 1)
    draw = random.Random(8)
    base = [f"w{i}" for i in range(60)]
    rows = []
    for i in range(40):
        words = list(base)
        for _ in range(draw.randint(0, 3)):
            words[draw.randrange(60)] = f"e{draw.randint(0, 5)}"
        rows.append((i, " ".join(words[: draw.randint(40, 60)])))
    assert got(jaccard.similar_classes(spark.createDataFrame(rows, "doc_id long, text string"))) == brute(rows)


@pytest.mark.parametrize("size", [10, 500, 40_000])
def test_bound_is_never_below_the_overlap(size):
    draw = np.random.default_rng(size)
    one = np.unique(draw.integers(0, 2**63, size).astype(np.uint64))
    other = np.unique(np.concatenate((one[: size // 2], draw.integers(0, 2**63, size // 3 + 1).astype(np.uint64))))
    a, b = (jaccard.counts_in(jaccard.counts_of(x)) for x in (one, other))
    assert jaccard.bound(a, b) >= len(np.intersect1d(one, other))


def test_components(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(50)] + [(100, 90), (90, 100), (5, 5)], "a long, b long")
    assert dict(map(tuple, components(links).collect())) == {i: 0 for i in range(51)} | {90: 90, 100: 90}


def test_links_that_have_done_their_work_are_not_read_again(spark, monkeypatch):
    """A group of 200 copies around four hubs: its links are written once, and few of them later."""
    draw, rows = random.Random(5), []

    def counted(df, label):
        out = written(df, label)
        rows.append(out.count() if {"a", "b"} <= set(out.columns) else 0)
        return out

    monkeypatch.setattr(components_, "written", counted)
    pairs = {(hub, node) for node in range(10, 210) for hub in draw.sample(range(4), 2)} | {(0, 1), (1, 2), (2, 3)}
    found = components(spark.createDataFrame(sorted(pairs), "a long, b long"))
    assert dict(map(tuple, found.collect())) == {node: 0 for pair in pairs for node in pair}
    assert sum(rows) < 1.2 * len(pairs)


def test_components_of_random_links(spark):
    draw = random.Random(9)
    pairs = [tuple(draw.sample(range(300), 2)) for _ in range(170)] + [(i, i - 1) for i in range(900, 800, -1)]
    least = {node: node for pair in pairs for node in pair}
    for _ in least:
        for a, b in pairs:
            least[a] = least[b] = min(least[a], least[b])
    assert dict(map(tuple, components(spark.createDataFrame(pairs, "a long, b long")).collect())) == least


def test_members_are_ranked_without_their_counts(spark, monkeypatch):
    """The counts of a meeting's members are dealt out once, and once more only where it has several leaves."""
    ranked, leaves, number = [], [], jaccard.row_numbers

    def numbered(df, *args):
        ranked.append(df.columns)
        return number(df, *args)

    def kept(df, label):
        out = written(df, label)
        leaves.extend(r["last"] for r in out.collect()) if label == "leaves" else None
        return out

    monkeypatch.setattr(jaccard, "row_numbers", numbered)
    monkeypatch.setattr(jaccard, "written", kept)
    draw, base = random.Random(4), [f"w{i}" for i in range(60)]
    rows = [(i, " ".join([*base[:30], *(f"x{draw.randint(0, 40)}" for _ in range(8)), *base[30:]])) for i in range(30)]
    assert got(jaccard.similar_classes(spark.createDataFrame(rows, "doc_id long, text string"))) == brute(rows)
    assert ranked and all("counts" not in columns for columns in ranked) and set(leaves) == {0}


def test_empty_table(nothing):
    assert jaccard.similar_classes(nothing).count() == 0
