from __future__ import annotations

import pytest

DOCUMENTS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture
def documents(spark):
    """A maker of small document tables; the extra columns have names that operators use inside."""

    def make(texts, ids=None, lang="en", source="host"):
        ids = list(range(len(texts))) if ids is None else ids
        rows = [(i, t, lang, source, len(t or ""), 7, "x", 1) for i, t in zip(ids, texts, strict=True)]
        return spark.createDataFrame(rows, DOCUMENTS + ", node long, line string, length int")

    return make
