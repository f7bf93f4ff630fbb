"""Small tables with nulls, empty and long texts, ties, repeated rows and columns with clashing names."""

from __future__ import annotations

import pytest

LONG = " ".join(f"word{i % 97}x{i % 13}" for i in range(4000))
ODD = [
    (1, "the quick brown fox jumps over the lazy dog and runs far away from here today", "en", "a", 5),
    (2, "the quick brown fox jumps over the lazy dog and runs far away from here today", "en", "a", 5),
    (3, None, "en", None, None),
    (4, "", None, "b", 0),
    (5, "   \n\t ", "de", "b", 3),
    (6, LONG, "en", "a", len(LONG)),
    (7, "12345 !!! ???", "fr", "c", 1),
    (8, "über größe straße schön für die und der", "de", "c", 4),
    (8, "über größe straße schön für die und der", "de", "c", 4),
    (None, "a row without an id but with some words in it", "en", "a", 9),
    (9, "one two", None, None, 2),
    (10, "le chat est sur la table avec une pomme rouge et verte", "fr", "c", 7),
]
#: Names that the operators use inside.
CLASH = ["id", "token", "n", "score", "key", "tokens", "passes", "rest", "cut", "block", "component", "x", "v", "__row"]


@pytest.fixture(scope="session")
def odd(spark):
    df = spark.createDataFrame(ODD, "doc_id long, text string, lang string, source string, n_chars long")
    from pyspark.sql import functions as F

    return df.select("*", *[F.lit(f"own {c}").alias(c) for c in CLASH])


@pytest.fixture(scope="session")
def empty(odd):
    return odd.limit(0)


@pytest.fixture(scope="session")
def documents(spark):
    return spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
