from __future__ import annotations

import pytest

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, n_words string, __key string, score string, copies string"


@pytest.fixture
def documents(spark):
    """Documents from (doc_id, text[, lang[, source]]), with extra columns whose names the operators use themselves."""

    def make(rows, parts=3):
        full = [(*r, *("en", "s")[len(r) - 2 :])[:4] for r in rows]
        return spark.createDataFrame([(i, t, g, s, len(t or ""), "own", "own", "own", "own") for i, t, g, s in full], SCHEMA).repartition(parts)

    return make


#: Rows that every operator must stand: nulls, empty and blank texts, repeats, one very long text.
ODD = [(None, None), (None, "a b c"), (1, None), (2, ""), (3, " \n\t "), (4, "same text here"), (4, "same text here"), (5, "same text here"), (6, "é " * 60_000), (7, "x" * 200_000), (8, "\x00 \x01 漢字 🙂   \xa0")]


@pytest.fixture
def odd():
    return list(ODD)
