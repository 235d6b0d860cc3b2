from __future__ import annotations

import pytest

CLASHING = "size long, n_tokens string, key string, spans long, kept string, part int, Score string"


@pytest.fixture(scope="session")
def docs(spark):
    """docs((doc_id, text, lang, source), ...): documents with columns named like results."""

    def build(*rows):
        full = [
            (*(list(r) + [None] * (4 - len(r))), None, 7, "x", "k", 1, "no", 3, "s") for r in rows
        ]
        return spark.createDataFrame(
            full, f"doc_id long, text string, lang string, source string, n_chars long, {CLASHING}"
        )

    return build


@pytest.fixture(scope="session")
def given():
    return "/root/testdata/sf0.001"
