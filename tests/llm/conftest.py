import random

import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def sentence(draw: random.Random, n: int) -> str:
    return " ".join("".join(draw.choice("abcdefghijklmnop") for _ in range(draw.randint(2, 7))) for _ in range(n))


@pytest.fixture(scope="session")
def corpus():
    """Rows of documents with copies, near copies, shared passages, odd texts and nulls."""
    draw = random.Random(7)
    base = [sentence(draw, draw.randint(60, 200)) for _ in range(30)]
    texts: list = list(base)
    texts += [base[0], base[0], base[1]]
    for i in range(8):
        words = base[i].split()
        for _ in range(1 + i):
            words[draw.randrange(len(words))] = sentence(draw, 1)
        texts.append(" ".join(words))
    for i in range(6):  # a passage of one text inside another
        own = base[20 + i].split()
        texts.append(f"{sentence(draw, 40)} {' '.join(own[3:58])} {sentence(draw, 40)}")
    texts += [None, "", "   ", "?!?", "one", "two words", "one", "É Ü ß", "x " * 3000]
    return [(i, t, ("en", "de", None)[i % 3], f"s{i % 4}" if i % 5 else None, None if t is None else len(t)) for i, t in enumerate(texts)]


@pytest.fixture()
def docs(spark, corpus):
    return spark.createDataFrame(corpus, DOCS).repartition(3)


@pytest.fixture()
def empty(spark):
    return spark.createDataFrame([], DOCS)


@pytest.fixture()
def clashing(docs):
    """Extra columns whose names operators might use themselves."""
    from pyspark.sql import functions as F

    return docs.withColumns({c: F.lit(None).cast("string") for c in ("row", "key", "copy", "size", "bands", "score", "start", "end", "ref", "n_hit", "digest", "length", "component", "piece", "bits", "label")})
