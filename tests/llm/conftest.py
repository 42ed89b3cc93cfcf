from __future__ import annotations

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score int, node string, finish string"


@pytest.fixture(scope="session")
def documents(spark):
    """Rows (doc_id, text, lang, source) as documents, with extra columns whose names operators use themselves."""

    def make(rows):
        return spark.createDataFrame([(*r, len(r[1] or ""), 7, "x", "y") for r in rows], SCHEMA)

    return make


@pytest.fixture(scope="session")
def odd(documents):
    """Nulls, empty and blank texts, repeated rows and ids, a long text."""
    long = " ".join(f"word{k % 977} of{k % 13}" for k in range(20_000))
    rows = [
        (1, "The cat sat on the mat and then it left the house.", "en", "a"),
        (2, None, "en", "a"),
        (3, "", None, None),
        (4, " \t\n ", "fr", None),
        (5, "Le chat est assis sur le tapis et puis il sort.", "fr", "b"),
        (5, "Le chat est assis sur le tapis et puis il sort.", "fr", "b"),
        (6, long, "en", "c"),
        (7, "12345 !!! 678", "en", "c"),
        (None, "The cat sat on the mat and then it left the house.", "en", "a"),
        (8, "😀 naïve café ÉTÉ", None, "b"),
    ]
    return documents(rows)
