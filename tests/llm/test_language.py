import random

from millrace.llm import language

WORDS = {"aa": "tika lomi senda parul", "bb": "grunt schlack dorft mutz", "cc": "éloui aiment sœurs çavan"}


def made(count=60):
    draw = random.Random(4)
    rows = []
    for i in range(count):
        for lang, words in WORDS.items():
            rows.append((len(rows), " ".join(draw.choices(words.split(), k=draw.randint(3, 40))), lang, "clash"))
    return rows


def test_held_out_accuracy_and_edge_cases(spark):
    rows = made()
    schema = "doc_id long, text string, lang string, score string"
    docs = spark.createDataFrame(rows, schema).repartition(4)
    model = language.train(docs.where("doc_id % 4 <> 0"), clusters=3, per_language=30)
    assert set(model["langs"]) == set(WORDS)
    got = {r["doc_id"]: r for r in language.predict(docs, model, ["doc_id"]).collect()}
    held = [r for r in rows if r[0] % 4 == 0]
    assert sum(got[r[0]]["nearest"] == r[2] for r in held) == len(held)
    odd = [(1, None, "aa", ""), (2, "", None, ""), (3, "123 !? \n", "bb", ""), (4, "zzqx wwkk jjyy", None, ""), (5, "TIKA LOMI", None, ""), (5, "TIKA LOMI", None, "")]
    out = sorted(map(tuple, language.predict(spark.createDataFrame(odd, schema), model, ["doc_id"]).collect()), key=str)
    assert [r[1:3] for r in out[:3]] == [("und", 0.0)] * 3
    assert out[3][3] == "und" and out[3][1] in WORDS
    assert out[4] == out[5] and out[4][1] == "aa"
    assert all(0 <= r[2] <= 1 for r in out)


def test_nothing_learned(spark, documents, nothing):
    model = language.train(nothing)
    rows = language.predict(documents, model, ["doc_id"]).collect()
    assert {(r["nearest"], r["score"]) for r in rows} == {("und", 0.0)}
    assert language.predict(nothing, model, ["doc_id"]).count() == 0


def test_document_counts_cover_all_rows(spark):
    docs = spark.createDataFrame([(t,) for t in ["ab", "ab cd", "", None, "zz"]], "text string")
    counts = {r["bin"]: r["df"] for r in language.document_counts(docs, "text").collect()}
    assert counts[-1] == 3
    assert max(v for k, v in counts.items() if k >= 0) <= 3


def test_copies_do_not_empty_or_fill_the_sample(spark):
    """Languages of many rows and few texts: every text is learned, whatever its hash, and once."""
    rows, held = [], []
    for number in range(12):
        word = "".join(chr(97 + (number * 7 + k * k) % 26) for k in range(6))
        texts = [f"{word} {word[::-1]} {number * 31 + k} {chr(97 + k) * 3}" for k in range(3)]
        rows += [(texts[i % 3] if i % 50 else texts[0], f"l{number:02d}") for i in range(400)]
        held += [(t, f"l{number:02d}") for t in texts]
    docs = spark.createDataFrame(rows, "text string, lang string").repartition(4)
    model = language.train(docs, clusters=3, per_language=20)
    assert sorted(model["langs"]) == sorted(f"l{n:02d}" for n in range(12) for _ in range(3))
    got = language.predict(spark.createDataFrame(held, "text string, lang string"), model, ["text", "lang"]).collect()
    assert all(r["nearest"] == r["lang"] and not r["lang_found"] == "und" for r in got)


def test_sample_holds_the_texts_of_smallest_hash(spark):
    from pyspark.sql import functions as F

    docs = spark.range(3000).select(F.concat(F.lit("x"), F.col("id") % 900).alias("text"), F.lit("aa").alias("lang"))
    hashes = docs.select("lang", F.xxhash64("text", F.lit(5)).alias("hash"))
    for wanted in (1, 50, 899, 900, 5000):
        limit = language._reach(hashes, wanted)["aa"]
        through = hashes.distinct().where(language._step(F.col("hash")) <= limit).count()
        assert min(wanted, 900) <= through <= min(900, max(1.5 * wanted, wanted + 40))
