import random
from collections import Counter

import pytest

import __spark_entry__ as spark_entry
import corpus_pipeline
from millrace.llm import queries
from oracle import connect, differences

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """A small corpus with insults, copies, secrets and two sources."""
    draw = random.Random(21)
    plain = ["".join(draw.choices(["ka", "lo", "mi", "ten", "dra", "vo", "shu"], k=draw.randint(2, 4))) for _ in range(300)]
    rows, labels = [], []
    for i in range(700):
        words = draw.choices(plain, k=draw.randint(20, 60))
        toxic = i % 7 == 0
        if toxic:
            words[5] = draw.choice(["grobnix", "flurpwit", "zankerbug"])
        if i % 50 == 3:
            words[7] = "password=hunter2hunter2"
        rows.append((i, " ".join(words), "en", "ab"[i % 2], 0))
        labels.append((i, 1, int(toxic)))
    clean = [r for r in rows if r[0] % 7]
    rows += [(1000 + k, clean[k][1], "en", "a", 0) for k in range(40)]
    rows += [(2000 + k, clean[k][1] + " end", "en", "b", 0) for k in range(40)]
    rows += [(3000, None, None, None, None), (3001, "", None, "a", 0), (None, "no id here at all", None, "b", 0)]
    path = str(tmp_path_factory.mktemp("tables"))
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    return path


def test_stages_take_effect(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    columns, kept = docs.columns, {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before, docs = docs.collect(), stage(spark, docs, folder).cache()
        assert docs.columns == columns
        kept[name] = (before, docs.collect())
    before, after = kept["toxicity"]
    gone = {r["doc_id"] for r in before} - {r["doc_id"] for r in after}
    assert gone == {i for i in range(0, 700, 7)}
    before, after = kept["near_duplicates"]
    assert Counter(r["doc_id"] for r in before) - Counter(r["doc_id"] for r in after) == Counter([*range(1000, 1040), *range(2000, 2040)])
    before, after = kept["secrets"]
    assert sorted(str(r["doc_id"]) for r in before) == sorted(str(r["doc_id"]) for r in after)
    was = {r["doc_id"]: r["text"] for r in before}
    for r in after:
        secret = r["doc_id"] is not None and r["doc_id"] < 700 and r["doc_id"] % 50 == 3
        assert r["text"] == (was[r["doc_id"]].replace("password=hunter2hunter2", "[SECRET]") if secret else was[r["doc_id"]])
    before, after = kept["mixing"]
    assert {r["doc_id"] for r in after} <= {r["doc_id"] for r in before}
    words = Counter()
    for r in after:
        words[r["source"]] += len((r["text"] or "").split())
    total = sum(len((r["text"] or "").split()) for r in before)
    assert abs(words["b"] - 2 * words["a"]) < 0.05 * total
    pieces = corpus_pipeline.STAGES[-1][1](spark, docs, folder).collect()
    assert Counter(r["doc_id"] for r in pieces if r["start"] == 0) == Counter(r["doc_id"] for r in after)


def test_one_row_of_each_group_of_similar_texts(spark):
    """Unrelated texts of one id all stay; copies go, with an id or without."""
    one, two, three, four = (" ".join(f"{name}{k}" for k in range(30)) for name in ("ka", "lo", "mi", "vo"))
    rows = [(1, one), (1, two), (5, two), (6, one), (6, three), (None, one), (None, four), (None, four), (None, four + " end")]
    rows += [(7, " "), (7, None), (None, ""), (1, two)]
    docs = spark.createDataFrame([(*r, "a") for r in rows], "doc_id long, text string, source string").repartition(3)
    got = [(r["doc_id"], r["text"]) for r in corpus_pipeline.keep_one_of_similar(spark, docs, FOLDER).collect()]
    last = [t for i, t in got if i is None and t]
    assert len(last) == 1 and last[0].startswith(four)
    wanted = Counter([(1, one), (1, two), (6, three), (7, " "), (7, None), (None, ""), (None, last[0])])
    assert Counter(got) == wanted


def test_run_and_registration(spark, folder):
    assert [name for name, _ in corpus_pipeline.STAGES] == ["toxicity", "near_duplicates", "secrets", "mixing", "packing"]
    assert corpus_pipeline.run(spark, folder).count() > 0
    names = [n for n in spark_entry.queries() if n.startswith("op")]
    assert sorted(int(n[2:].split("_")[0]) for n in names) == list(range(1, 14))
    assert spark_entry.queries()["pipeline"] is corpus_pipeline.run


@pytest.mark.parametrize("name", list(queries.ORACLES))
def test_oracles(spark, name):
    assert differences(spark, connect(FOLDER), name, FOLDER) is None


def test_no_python_in_the_secret_scan(spark):
    plan = queries.QUERIES["op3_secret_scan"](spark, FOLDER)._jdf.queryExecution().toString()
    assert not any(word in plan for word in ("Python", "Arrow", "Pandas", "CartesianProduct", "BroadcastNestedLoopJoin"))
