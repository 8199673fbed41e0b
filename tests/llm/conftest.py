import random

import pytest

SYLLABLES = "ka lo mi ten dra vo shu pel an ri os ut gen ba fi".split()


def prose(draw: random.Random, words: int) -> str:
    return " ".join("".join(draw.choices(SYLLABLES, k=draw.randint(1, 4))) for _ in range(words))


@pytest.fixture(scope="session")
def corpus() -> list[tuple]:
    """(doc_id, text, lang, source, n_chars): originals, exact and near copies, shared passages, nulls, empty texts."""
    draw = random.Random(3)
    passage = prose(draw, 40)
    texts = [prose(draw, draw.choice((1, 3, 5, 30, 120, 300))) for _ in range(40)]
    for base in texts[:10]:
        texts.append(base)
        words = base.split()
        words[len(words) // 2] = "changed"
        texts.append(" ".join(words))
    for _ in range(8):
        texts.append(f"{prose(draw, 20)}\n{passage} {prose(draw, 10)}")
    texts += [None, "", "  \n\t ", None, "é" * 60, "ÀÉ ßtraße  naïve " + passage, "x" * 30_000]
    rows = [(i * 3 % 101, t, ("en", "fr", None)[i % 3], (None, "a", "b", "é")[i % 4], None if t is None else len(t)) for i, t in enumerate(texts)]
    return rows


SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def documents(spark, corpus):
    return spark.createDataFrame(corpus, SCHEMA).repartition(5)


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)
