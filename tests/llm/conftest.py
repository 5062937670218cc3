from __future__ import annotations

import pytest
from pyspark.sql import functions as F

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
# Columns that operators use inside, with other types.
CLASHES = ("row", "chunk", "digest", "host", "part", "class", "key", "words", "plan", "size", "tree", "node")


@pytest.fixture
def documents(spark):
    """A function from (doc_id, text, source) rows to a documents table with clashing columns."""

    def make(rows):
        full = [(i, t, "en", s, None if t is None else len(t)) for i, t, s in rows]
        df = spark.createDataFrame(full, SCHEMA).repartition(3)
        return df.withColumns({name: F.lit("x") for name in CLASHES})

    return make


@pytest.fixture
def odd_rows():
    """Null ids and texts, blank and repeated rows, a long text."""
    long = " ".join(f"w{i % 977}x{i}" for i in range(6000))
    return [
        (None, "a text without a number", "s1"), (1, None, "s1"), (2, "", None), (3, " \t\n\x0b ", "s2"),
        (4, "same text here", "s2"), (4, "same text here", "s2"), (5, "same text here", "s1"), (6, long, "s2"),
        (7, "é ß 中文 😀   x", None), (8, "one", "s3"),
    ]
