from __future__ import annotations

import random

import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
WORDS = [a + b + c for a in ("ka", "lo", "mi", "tu", "re", "so") for b in ("na", "pe", "ri", "vo") for c in ("", "s", "ta")]


@pytest.fixture(scope="session")
def docs_of(spark):
    """A documents table of (id, text) pairs."""

    def make(rows):
        return spark.createDataFrame([(i, t, "en", "s", None if t is None else len(t)) for i, t in rows], DOCS)

    return make


@pytest.fixture
def prose():
    def make(seed: int, words: int) -> list[str]:
        r = random.Random(seed)
        return [r.choice(WORDS) for _ in range(words)]

    return make
