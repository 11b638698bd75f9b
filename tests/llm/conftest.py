"""Fixtures of the corpus operators' tests."""

from __future__ import annotations

import pytest

from tests.llm.tables import DOCUMENTS
from turnwise.llm.common import prepare


@pytest.fixture
def documents(spark):
    prepare(spark)

    def make(rows, parts: int = 3):
        """rows: text, or (doc_id, text), or (doc_id, text, lang, source)."""
        full = []
        for i, r in enumerate(rows):
            r = (i, r) if not isinstance(r, tuple) else r
            r = (*r, "en", "src0") if len(r) == 2 else r
            full.append((*r, len(r[1] or ""), "k", "x", 1, 0.5))
        return spark.createDataFrame(full, DOCUMENTS).repartition(parts)

    return make
