"""Tables every operator must take: nulls, empty and long texts, ties, repeated rows, clashing column names."""

import random

import pytest

#: Columns named like those the operators make for themselves.
SCHEMA = ("doc_id long, text string, lang string, source string, rid long, h long, row long, token string, label string, "
          "ids string, _key0 string, _KEY0_R string, _times int, name string, kept string, class string")

LONG = " ".join(f"w{i % 977}x{i % 31}" for i in range(20_000))


def rows_of(texts):
    return [(i, t, lang, "s", 0, 0, 0, "t", "l", "i", "k", "r", 1, "n", "k", "c") for i, t, lang in texts]


EDGE = [
    (5, "one  two\tthree four", "en"), (3, "one two three four", "en"), (None, "one two three four", "en"),
    (3, "one two three four", "en"), (7, None, None), (8, "", "en"), (9, "", None), (None, None, "en"),
    (10, LONG, "en"), (11, LONG, "en"), (12, LONG + " tail", "en"), (13, "   \n\t ", "en"), (14, "1234 5678", "de"),
    (15, "Straße über Äpfel — 漢字 🙂", "de"), (3, "another text under the same id", "en"), (16, "x", "en"),
]


@pytest.fixture(scope="session")
def edge(spark):
    return spark.createDataFrame(rows_of(EDGE), SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)


def random_texts(seed, n, words=12, vocabulary=6):
    rng = random.Random(seed)
    pool = ["".join(rng.choice("abcde") for _ in range(rng.randint(1, 4))) for _ in range(vocabulary)]
    return [" ".join(rng.choice(pool) for _ in range(rng.randint(0, words))) for _ in range(n)]
