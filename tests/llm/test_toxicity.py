import random
from itertools import combinations

import numpy as np
import pytest

from millrace.llm import toxicity


def brute(s, t):
    """The kernel by all places of all subsequences."""
    total = 0.0
    for a in combinations(range(len(s)), toxicity.ORDER):
        for b in combinations(range(len(t)), toxicity.ORDER):
            if all(s[i] == t[j] for i, j in zip(a, b, strict=True)):
                total += toxicity.DECAY ** (a[-1] - a[0] + 1 + b[-1] - b[0] + 1)
    return total


WORDS = ["idiot", "idxiot", "i", "aaaa", "banana", "bandana", "straße", "zzzzz"]


def test_kernel_equals_all_subsequences():
    exact = np.array([[brute(a, b) for b in WORDS] for a in WORDS])
    assert np.allclose(toxicity.kernel(WORDS, WORDS), exact, atol=1e-5)
    assert np.allclose(toxicity.own_norm(WORDS), np.sqrt(np.diag(exact)), atol=1e-5)


def test_table_equals_kernel():
    marks = [w for w in WORDS if len(w) >= 3]
    norm = np.outer(toxicity.own_norm(WORDS), toxicity.own_norm(marks))
    exact = toxicity.kernel(WORDS, marks) / np.where(norm > 0, norm, 1)
    assert np.allclose(toxicity.Table(marks).similar(WORDS), exact, atol=1e-5)
    weights = np.linspace(-1, 2, len(marks))
    assert np.allclose(toxicity.Table(marks, weights).similar(WORDS)[:, 0], exact @ weights, atol=1e-4)


def test_tokens():
    assert "idiot" in toxicity.tokens("An i d i o t, here")
    assert toxicity.tokens("the i\td word") == {"the", "i", "d", "word"}
    assert toxicity.shaped("i.d.i-o_t") == ["idiot"]
    long = "q" * 70
    assert all(len(p) == toxicity.LONGEST for p in toxicity.shaped(long)[:-1])


@pytest.fixture(scope="module")
def labelled():
    draw = random.Random(9)
    plain = ["".join(draw.choices(["ka", "lo", "mi", "ten", "dra", "vo", "shu"], k=draw.randint(2, 4))) for _ in range(300)]
    insults = ["grobnix", "flurpwit", "zankerbug"]
    rows = []
    for i in range(900):
        words = draw.choices(plain, k=draw.randint(5, 60))
        toxic = i % 6 == 0
        if toxic:
            words[draw.randrange(len(words))] = draw.choice(insults)
        rows.append((" ".join(words), int(toxic), "clash"))
    return rows


def test_held_out_accuracy_and_gapped_words(spark, labelled):
    schema = "text string, toxic int, score string"
    model = toxicity.train(spark.createDataFrame(labelled[:600] + [(None, 1, ""), ("null label", None, "")], schema))
    rows = [(i, t, y) for i, (t, y, _) in enumerate(labelled[600:])]
    got = toxicity.score(spark.createDataFrame(rows, "doc_id int, text string, toxic int"), model, ["doc_id", "toxic"]).collect()
    assert np.mean([(r["score"] >= 0.7) == r["toxic"] for r in got]) > 0.98
    odd = [(1, None), (2, ""), (3, "kalo grob.nix mi"), (4, "kalo flurxpwit mi"), (5, "lo z a n k e r b u g mi"), (6, "kalomi " * 5000), (7, "x" * 50_000)]
    odd.append((3, "kalo grob.nix mi"))
    out = {r["doc_id"]: r["score"] for r in toxicity.score(spark.createDataFrame(odd, "doc_id int, text string"), model, ["doc_id"]).collect()}
    assert len(out) == 7 and all(0 <= s <= 1 for s in out.values())
    assert min(out[3], out[4], out[5]) >= 0.7 > max(out[1], out[2], out[6], out[7])


def test_sample_holds_different_texts(spark):
    rows = [(f"text {i % 3} of few", 1) for i in range(30_000)] + [(f"clean text {i}", 0) for i in range(50)] + [("clean text 1", 0)] * 9_000
    labelled = spark.createDataFrame(rows, "text string, toxic int").distinct()
    got = toxicity._sample(labelled, 40).collect()
    assert sum(r["toxic"] for r in got) == 3 and len(got) == len(set(got)) == 43


def test_copies_do_not_change_the_model(spark, labelled):
    rows = [(t, y) for t, y, _ in labelled[:600]]
    schema = "text string, toxic int"
    once = toxicity.train(spark.createDataFrame(rows, schema))
    copied = [r for r in rows if not r[1]][:3] * 2000 + [r for r in rows if r[1]][:3] * 2000
    many = toxicity.train(spark.createDataFrame(rows + copied, schema).repartition(8))
    assert once["landmarks"] == many["landmarks"] and np.allclose(once["weights"], many["weights"])


def test_words_of_the_kernel(spark):
    long = "".join(chr(97 + i % 26) for i in range(61))
    got = spark.createDataFrame([(f"An {long} i.d.iot IDIOT {'q' * 24} {'z' * 25} ab", 1)], "text string, toxic int")
    want = {p for w in (long, "idiot", "q" * 24, "z" * 25) for p in toxicity.shaped(w)}
    assert {r["word"] for r in toxicity._listed(got).collect()} == {w for w in want if len(w) >= toxicity.ORDER}


@pytest.mark.parametrize("first", [0x430, 0x3B1, 0x4E00], ids=["cyrillic", "greek", "cjk"])
def test_other_scripts(spark, first):
    letters = [chr(first + i) for i in range(24 if first < 0x4E00 else 400)]
    draw = random.Random(first)
    plain = ["".join(draw.choices(letters, k=draw.randint(4, 9))) for _ in range(200)]
    bad, rows = ["".join(draw.choices(letters, k=7)) for _ in range(2)], []
    for i in range(600):
        words = draw.choices(plain, k=20)
        if i % 5 == 0:
            words[draw.randrange(20)] = draw.choice(bad)
        rows.append((i, " ".join(words), int(i % 5 == 0)))
    df = spark.createDataFrame(rows, "doc_id int, text string, toxic int")
    model = toxicity.train(df.where("doc_id < 400"))
    table = toxicity.Table(model["landmarks"])
    assert table.cell.nbytes < 64 << 20
    got = toxicity.score(df.where("doc_id >= 400"), model, ["toxic"]).collect()
    assert np.mean([(r["score"] >= 0.7) == r["toxic"] for r in got]) > 0.97


def test_score_is_the_worst_word_by_the_plain_kernel(spark):
    draw = np.random.default_rng(4)
    marks = ["grobnix", "flurpwit", "kalomi", "tendra"]
    model = {"landmarks": marks, "weights": draw.normal(size=4), "bias": -0.3, "slope": 2.0, "level": 0.4}
    texts = ["kalo grobxnix mi", "g r o b n i x", "", None, "ab", "tendra, kalomi flurp.wit " + "flurpwit" * 6]
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")
    got = {r["doc_id"]: r["score"] for r in toxicity.score(rows, model, ["doc_id"]).collect()}
    for place, text in enumerate(texts):
        margin = [model["bias"]]
        words = [p for w in toxicity.tokens(text or "") for p in toxicity.shaped(w)]
        if words:
            margin = []
            for word in words:
                own = brute(word, word)
                alike = [brute(word, m) / np.sqrt(own * brute(m, m)) if own else 0.0 for m in marks]
                margin.append(float(np.dot(alike, model["weights"])) + model["bias"])
        assert abs(got[place] - 1 / (1 + np.exp(-(2.0 * max(margin) + 0.4)))) < 1e-4


def test_nothing_to_learn(spark, documents, nothing):
    empty = toxicity.train(nothing.selectExpr("text", "1 toxic"))
    assert {r["score"] < 0.01 for r in toxicity.score(documents, empty, ["doc_id"]).collect()} == {True}
    assert toxicity.score(nothing, empty, ["doc_id"]).count() == 0
    one = toxicity.train(documents.selectExpr("text", "1 toxic"))
    assert {r["score"] > 0.99 for r in toxicity.score(documents, one, ["doc_id"]).collect()} == {True}
