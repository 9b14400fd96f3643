"""Rows that every operator must take: nulls, empty and long texts, ties, repeats, and columns with clashing names."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

ROWS = [
    (None, "a text without an id that has a few words", "en", "s1", 3),
    (1, "The same words stand here twice and more than five of them do.", "en", "s1", 3),
    (2, "The same words stand here twice and more than five of them do.", None, None, None),
    (3, None, "en", "s2", 0),
    (4, "", "en", None, 0),
    (5, "word " * 30_000, "en", "s1", 150_000),
    (6, " \t\n two  spaces\x0b\n\n", "fr", "s3", 20),
    (7, "é́ un texte où l'on compte; 12 mots à peu près, ou plus.", "fr", "s3", 60),
    (8, "repeated row", "en", "s2", 12),
    (8, "repeated row", "en", "s2", 12),
]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def odd(spark):
    docs = spark.createDataFrame(ROWS, SCHEMA)
    for name in ("key", "line", "id", "size", "score", "copies", "u", "start"):
        docs = docs.withColumn(name, F.lit("mine"))
    return docs.coalesce(2)


@pytest.fixture(scope="session")
def nothing(odd):
    return odd.limit(0)
