from __future__ import annotations

import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long, score double, spans string, label string"


@pytest.fixture(scope="session")
def make_docs(spark):
    """Documents of (doc_id, text), with extra columns whose names clash with those of results."""

    def make(rows):
        return spark.createDataFrame([(i, t, "en", "src", len(t or ""), 0.5, "x", "y") for i, t in rows], DOCS)

    return make


#: Nulls, empty and blank texts, ties, repeated rows and a very long text.
ODD = [(1, None), (2, ""), (3, "   \n\t"), (4, "same text here"), (5, "same text here"), (4, "same text here"), (6, "é ß Ǆ 😀 ﬁ"), (7, "word " * 60_000), (8, "x" * 100_000), (None, "no id")]
