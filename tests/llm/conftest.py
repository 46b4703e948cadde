"""Small tables of awkward documents for the training-data operators."""

import random

import pytest
from pyspark.sql import types as T

SCHEMA = T.StructType([
    T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()), T.StructField("source", T.StringType()),
    T.StructField("n_chars", T.LongType()), T.StructField("score", T.DoubleType()), T.StructField("fp", T.LongType()), T.StructField("key", T.StringType()),
])


def make_texts(seed: int = 7, n: int = 60) -> list[str]:
    r = random.Random(seed)
    words = ["The", "river", "ran", "past", "old", "mills", "and", "nobody", "counted", "stones", "über", "日本", "naïve", "x", "stone", "light", "of", "morning"]
    sentence = lambda k: " ".join(r.choice(words) for _ in range(k)).capitalize() + "."
    passage = " ".join(sentence(9) for _ in range(8))
    out = []
    for i in range(n):
        t = "\n".join(" ".join(sentence(r.randrange(3, 12)) for _ in range(r.randrange(1, 5))) for _ in range(r.randrange(1, 6)))
        out.append(t + (passage if i % 7 == 3 else ""))
    out += [out[5], out[5], out[6] + " end", out[6].replace("river", "rivers", 1), "word " * 4000, "ab" * 9000, " \t\n", "...", "12 34"]
    return out


def make_rows(seed: int = 7, n: int = 60) -> list[tuple]:
    texts = make_texts(seed, n)
    rows = [(i, t, ["en", "de", None][i % 3], ["a", "b", None, "ö", "hot", "hot", "hot"][i % 7], len(t), 0.5, 9, "k") for i, t in enumerate(texts)]
    k = len(rows)
    rows += [(k, None, "en", "a", None, None, None, None), (k + 1, "", "en", None, 0, 0.0, 0, ""), (k + 2, "", None, "b", 0, 0.0, 0, "")]
    return rows


@pytest.fixture(scope="session")
def rows():
    return make_rows()


@pytest.fixture(scope="session")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def odd(spark, rows):
    """The same with null ids, repeated rows, and one id with two texts."""
    more = [rows[0], rows[0], (None, rows[5][1], "en", "a", 1, None, None, None), (None, None, None, None, None, None, None, None), (3, "Another text of the same id, long enough to stay.", "en", "b", 1, 0.1, 1, "z")]
    return spark.createDataFrame(rows + more, SCHEMA).repartition(4)


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def model():
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")
