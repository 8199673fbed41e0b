import hashlib

from pyspark.sql import functions as F

from millrace.llm import fingerprint


def test_edit_trial_equals_plain_python(spark, documents, corpus):
    more = [(3, "again the same id", None, None, 0), (None, None, None, None, None), (None, "no id", None, None, 0)]
    docs = spark.createDataFrame([*corpus, *more], documents.schema).withColumn("fingerprint", F.lit("clash"))
    band = fingerprint.lexicon(docs, least=0.02, most=0.5)
    prints = fingerprint.Prints(band)
    rows = [(r[0], r[1] or "") for r in docs.select("doc_id", "text", F.xxhash64(F.coalesce("text", F.lit("")))).orderBy(F.asc_nulls_first("doc_id"), F.xxhash64(F.coalesce("text", F.lit("")))).collect()]
    want = []
    for (ident, text), (_, after) in zip(rows, rows[1:] + rows[:1], strict=True):
        quarter = len(text) // 4
        changed = text[: len(text) - quarter] + after[:quarter]
        own, other = prints.of(text), prints.of(changed)
        digest = hashlib.sha256(changed.encode()).hexdigest()
        near = (fingerprint.likeness(own, other), fingerprint.likeness(own, prints.of(after)))
        want.append((str(ident), len(text), digest, own, other, *near))
    for partitions in ("1", "8"):
        spark.conf.set("spark.sql.shuffle.partitions", partitions)
        got = [(str(r[0]), *r[1:]) for r in map(tuple, fingerprint.edit_trial(docs.repartition(6), band).collect())]
        assert sorted(got) == sorted(want)


def test_depths_are_bytes_and_prints_stay_as_they_were():
    """A text's terms are looked up as one array of bytes; prints are those of a loop over subsets."""
    prints = fingerprint.Prints([f"t{i}" for i in range(60)])
    for m in (1, 2, 3, 17, 60):
        chosen = sorted(f"t{i}" for i in range(m))
        depths = [prints.depths(t) for t in chosen]
        assert all(isinstance(d, bytes) and len(d) == fingerprint.SUBSETS for d in depths)
        want = []
        for s in range(m.bit_length() - 1, m.bit_length() - 1 + fingerprint.SCALES):
            kept = [[t for t, d in zip(chosen, depths, strict=True) if d[i] >= s] for i in range(fingerprint.SUBSETS)]
            want.append(f"{s}:" + "".join(fingerprint._short("\n".join(k)) if k else fingerprint.EMPTY for k in kept))
        assert prints.of(" ".join(chosen)) == ";".join(want)


def test_fingerprints(spark, documents, corpus):
    band = fingerprint.lexicon(documents, least=0.02, most=0.5)
    got = fingerprint.fingerprints(documents, band, ["doc_id", "text"]).collect()
    by_text: dict = {}
    for r in got:
        by_text.setdefault(r["text"] or "", set()).add(r["fingerprint"])
    assert all(len(p) == 1 for p in by_text.values())
    prints = fingerprint.Prints(band)
    long = max((r[1] or "" for r in corpus), key=lambda t: len(set(t.split())))
    near = long.replace(long.split()[3], "other", 1)
    far = next(r[1] for r in corpus if r[1] and len(r[1].split()) > 100 and r[1] != long)
    assert fingerprint.likeness(prints.of(long), prints.of(near)) > 0.6
    assert fingerprint.likeness(prints.of(long), prints.of(far)) < 0.3
    assert fingerprint.likeness(prints.of(""), prints.of("")) == 1.0
    assert fingerprint.likeness(prints.of(""), prints.of(long)) == 0.0


def test_lexicon_is_the_band(spark):
    texts = ["a b c", "a b", "a B! b", "a", None, "", "d"]
    docs = spark.createDataFrame([(t,) for t in texts], "text string")
    assert sorted(fingerprint.lexicon(docs, least=0.3, most=0.5)) == ["b"]
    assert sorted(fingerprint.lexicon(docs, least=0.0, most=1.0)) == ["a", "b"]


def test_empty_table_and_one_row(spark, nothing):
    assert fingerprint.lexicon(nothing) == []
    assert fingerprint.edit_trial(nothing, []).count() == 0
    row = fingerprint.edit_trial(spark.createDataFrame([(1, "abcdefgh")], "doc_id long, text string"), []).first()
    assert (row["edited_sha256"], row["near_next"]) == (hashlib.sha256(b"abcdefab").hexdigest(), 1.0)
