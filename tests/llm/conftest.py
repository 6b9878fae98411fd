"""Odd rows that every operator has to take: nulls, empty, blank and very long texts, repeated rows, clashing columns."""

import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double, keep boolean, set_id string"


def prose(seed, words=60, vocabulary=("the", "Of", "and", "house", "river,", "stone", "walks.", "under", "green", "light")):
    rng = random.Random(seed)
    return " ".join(rng.choice(vocabulary) + ("" if rng.random() < 0.7 else str(rng.randrange(50))) for _ in range(words))


@pytest.fixture(scope="session")
def odd_rows():
    base = prose(1, 80)
    long_text = " ".join(prose(k, 400) for k in range(60))
    rows = [(1, base, "en", "a"), (2, base, "en", "a"), (2, base, "en", "a"), (3, None, "en", "b"), (4, "", None, None),
            (5, " \n\t ", "fr", "a"), (None, base, "en", "a"), (6, long_text, "en", "c"), (7, "x" * 50_000, "de", "c"),
            (8, "one two", "fr", "a"), (9, "!!! 123 ???", "de", None), (10, base + " extra", "en", "b"),
            (11, "Ünïcödé ñandú 漢字 😀 text's it'll", "es", "b"), (12, None, None, None), (13, "a\x00b c", "en", "a"),
            (14, "la maison et la rivière sous la pierre " * 4, "fr", "a"), (15, "das Haus und der Fluß unter dem Stein " * 4, "de", "b")]
    return [(*r, len(r[1] or ""), 0.5, True, "clash") for r in rows]


@pytest.fixture(scope="session")
def odd(spark, odd_rows):
    return spark.createDataFrame(odd_rows, SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def documents(spark):
    return spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
