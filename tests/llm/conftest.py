import random

import pytest
from pyspark.sql import types as T

SCHEMA = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()),
                       T.StructField("lang", T.StringType()), T.StructField("source", T.StringType()),
                       T.StructField("n_chars", T.LongType()), T.StructField("score", T.StringType()),
                       T.StructField("component_id", T.StringType()), T.StructField("kept", T.StringType()),
                       T.StructField("n_lines", T.StringType()), T.StructField("contaminated", T.StringType())])


def invented(count: int, seed: int) -> list[str]:
    pick = random.Random(seed)
    return ["".join(pick.choice("abcdefghijklmnop") for _ in range(pick.randint(2, 7))) for _ in range(count)]


@pytest.fixture(scope="session")
def words():
    return invented(400, 1)


@pytest.fixture(scope="session")
def frame(spark):
    """Documents from (doc_id, text) pairs, with further columns that clash with results."""

    def make(pairs):
        rows = [(i, t, "en", "s", len(t or ""), "x", "y", "z", "w", "v") for i, t in pairs]
        return spark.createDataFrame(rows, SCHEMA).repartition(3)

    return make


@pytest.fixture(scope="session")
def corner_texts(words):
    """Null, empty, blank, very long, repeated and tied texts, a repeated row, a null id."""
    long = " ".join(random.Random(2).choices(words, k=60_000))
    return [(1, None), (2, ""), (3, " \n\t"), (4, long), (5, long), (6, "one two"), (7, "one two"), (7, "one two"),
            (None, "one two three four five six"), (None, None), (8, "É ß 😀 x\x1cy a\x85b ünï"), (9, "\n\n\n")]
