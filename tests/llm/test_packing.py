import random
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from millrace.llm import packing


def test_ids_are_those_of_the_tokenizer_file(corpus):
    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    code = packing.encoding()
    for text in [r[1] or "" for r in corpus] + ["a  b\n\n\tc ", "日本語 😀!! 12345 don't", "'S 'll x"]:
        assert code.encode_ordinary(text) == tokenizer.encode(text, add_special_tokens=False).ids


def test_added_tokens_are_those_of_the_tokenizer_file(spark):
    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    end = "<|endoftext|>"
    texts = [end, end * 2, f"a{end}b", f"one {end} two", f"  {end}\n\n{end}  x", f"<|{end}|>", "<|endoftext|", f"don{end}'t 日本{end}語"]
    wanted = {t: tokenizer.encode(t, add_special_tokens=False).ids for t in texts}
    assert wanted[f"a{end}b"] == [64, 50256, 65]
    cut = packing.pieces(spark.createDataFrame([(t, t) for t in texts], "doc_id string, text string"), ids=True)
    assert {r["doc_id"]: r["ids"] for r in cut.collect()} == {t: [*ids, 0] for t, ids in wanted.items()}


def test_pieces_and_places(spark, documents, corpus):
    more = documents.withColumn("start", F.lit("clash")).unionByName(documents.where("doc_id < 12").withColumn("start", F.lit("again")))
    cut = packing.pieces(more, ids=True)
    got = packing.pack(cut).collect()
    code = packing.encoding()
    wanted: Counter = Counter()
    for r in more.collect():
        ids = np.append(code.encode_to_numpy(r["text"] or ""), 0).astype("<u4")
        for start in range(0, len(ids), 1024):
            part = ids[start : start + 1024]
            wanted[(r["doc_id"], start, len(part), zlib.crc32(part.tobytes()), len(ids))] += 1
    assert Counter((r["doc_id"], r["start"], r["length"], r["ids_crc32"], r["doc_tokens"]) for r in got) == wanted
    sequences: dict = {}
    for r in sorted(got, key=lambda r: (r["sequence_id"], r["offset"])):
        assert r["offset"] == sequences.get(r["sequence_id"], 0)
        sequences[r["sequence_id"]] = r["offset"] + r["length"]
    assert sorted(sequences) == list(range(len(sequences)))
    assert max(sequences.values()) <= 1024
    built = {r["sequence_id"]: len(r["ids"]) for r in packing.sequences(packing.pack(cut)).collect()}
    assert built == sequences


def test_patterns_hold_the_histogram_with_little_padding():
    draw = random.Random(2)
    histogram = {n: draw.randint(0, 2000) for n in range(1, 1025)}
    histogram = {n: c for n, c in histogram.items() if c}
    packs = packing.patterns(histogram)
    held: Counter = Counter()
    for count, pack in packs:
        assert count > 0 and sum(pack) <= 1024
        for length in pack:
            held[length] += count
    assert held == histogram
    assert len(packs) < 5000
    tokens = sum(n * c for n, c in histogram.items())
    assert sum(c for c, _ in packs) * 1024 < 1.03 * tokens


def test_empty_table(nothing):
    assert packing.pack(packing.pieces(nothing)).count() == 0
