import base64
import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F

from millrace.llm import bpe
from millrace.llm.queries import op12


@pytest.fixture(scope="module")
def library():
    with open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


@pytest.fixture(scope="module")
def words():
    return bpe.vocabulary()


def encoded(words, texts):
    return [ids.tolist() for group in bpe.Encoder(words).encode(texts) for ids in group]


def test_ids_are_those_of_the_library(words, library):
    draw = random.Random(4)
    letters = "abcdefghijklmnopqrstuvwxyz"
    texts = ["", "a", "aaaaaaa" * 50, "ab" * 3000, " " * 4000, "\n" * 2000 + "a", "don't 'll  x\t\n y", "<|endoftext|>", "日本語 😀!! 12345"]
    texts += ["".join(draw.choices(letters[: draw.randint(1, 26)], k=n)) for n in (1, 2, 30, 900, 1023, 1024, 1025, 2500, 20_000)]
    texts += ["".join(map(chr, draw.choices([*range(1, 0xD800), *range(0xE000, 0x11000)], k=300))) for _ in range(20)]
    texts += ["".join(draw.choices(letters, k=12)) for _ in range(3000)]
    assert encoded(words, texts) == library.encode_ordinary_batch(texts)


def test_every_kind_of_character_is_cut_alike(words, library):
    points = [c for c in range(1, 0x20000) if not 0xD800 <= c < 0xE000]
    texts = [f"a{chr(c)}1 {chr(c)}{chr(c)} " for c in points]
    assert encoded(words, texts) == library.encode_ordinary_batch(texts)


def test_long_and_short_rows_merge_alike(library):
    draw = random.Random(6)
    for seed in range(30):
        # A vocabulary of random strings, where later pairs may well have lower ranks.
        tokens = {bytes([b]) for b in range(256)}
        while len(tokens) < 300:
            tokens.add(bytes(draw.choices(b"abc", k=draw.randint(2, 6))))
        order = list(tokens)
        draw.shuffle(order)
        small = bpe.Vocabulary({t: r for r, t in enumerate(order)}, r"[a-c]+")
        own = tiktoken.Encoding("small", pat_str=r"[a-c]+", mergeable_ranks=small.ranks, special_tokens={})
        text = "".join(draw.choices("abc", k=400)) + "abcabc" * seed
        wanted = own.encode_ordinary(text)
        assert small.merge([text.encode()])[0].tolist() == wanted
        assert small._merge_long(small.single[np.frombuffer(text.encode(), np.uint8)]).tolist() == wanted


def test_texts_beyond_one_cut_and_forgotten_pieces(words, library, monkeypatch):
    draw = random.Random(9)
    text = " ".join("".join(draw.choices("aeioubcd", k=draw.randint(1, 9))) for _ in range(3000)) + "  \n"
    monkeypatch.setattr(bpe, "CHARS", 1000)
    monkeypatch.setattr(bpe, "SEEN", 100)
    texts = [text, "short", text[:999], text[:1001], "", text]
    assert encoded(words, texts) == library.encode_ordinary_batch(texts)


def test_round_trip_of_the_query(spark, documents, corpus, library, tmp_path):
    again = documents.unionByName(documents.where("doc_id < 20")).unionByName(documents.limit(1).withColumn("doc_id", F.lit(None).cast("long")))
    again.withColumn("ids", F.lit("clash")).withColumn("decoded", F.lit(1)).write.parquet(f"{tmp_path}/t/documents.parquet")
    wanted = []
    for row in again.collect():
        text = row["text"] or ""
        ids = np.array(library.encode_ordinary(text), dtype="<u4")
        digests = (hashlib.sha256(ids.tobytes()).hexdigest(), hashlib.sha256(text.encode()).hexdigest())
        wanted.append((row["doc_id"] if row["doc_id"] is not None else -1, len(ids), *digests))
    got = op12(spark, f"{tmp_path}/t").select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256").collect()
    assert sorted((r[0] if r[0] is not None else -1, *r[1:]) for r in got) == sorted(wanted)


def test_empty_table_and_unknown_ids(spark, nothing, words):
    assert bpe.decode(bpe.encode(nothing, words), words).collect() == []
    rows = spark.createDataFrame([(1, None), (2, bytearray())], "doc_id long, ids binary")
    assert [bytes(r["decoded"]) for r in bpe.decode(rows, words).collect()] == [b"", b""]
    with pytest.raises(ValueError, match="vocabulary"):
        words.decode(np.array([50256], np.uint32))
