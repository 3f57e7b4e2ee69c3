from __future__ import annotations

import pytest

from lumencat.llm.ship import ship


@pytest.fixture(autouse=True)
def shipped(spark):
    ship(spark)


DOCS = "doc_id long, text string, lang string, source string, slot string, row string, label int"


@pytest.fixture
def odd_docs(spark):
    """Nulls in every column, empty and very long texts, ties, repeated rows, clashing names."""
    long = " ".join(f"word{n % 997}" for n in range(60_000))
    return spark.createDataFrame([
        (1, "a plain text of some few words that goes on", "en", "a", "s", "r", 1),
        (1, "a plain text of some few words that goes on", "en", "a", "s", "r", 1),
        (2, None, None, None, None, None, None),
        (3, "", "en", "a", "s", "r", 0),
        (4, " \n\t ", "de", "b", "s", "r", 0),
        (5, long, "en", "a", "s", "r", 0),
        (None, "a row without an id", "fr", "b", None, None, None),
        (None, "a row without an id", "fr", "b", None, None, None),
        (6, "naïve <|endoftext|> 漢字 \x00 end", None, "b", "", "", 0),
        (7, "tied", "en", None, "s", "r", 0),
        (7, "tied too", "en", "c", "s", "r", 0),
    ], DOCS)


@pytest.fixture
def no_docs(spark):
    return spark.createDataFrame([], DOCS)
