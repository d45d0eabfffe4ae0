"""Helpers for the corpus operators' tests."""

import random

import pytest


@pytest.fixture(scope="session")
def read(spark):
    """A driver table at the small scale."""
    from trafficscore.llm.common import read_table
    return lambda name, sf="/root/testdata/sf0.001": read_table(spark, sf, name)


@pytest.fixture(scope="session")
def documents(spark):
    """Rows of (doc_id, text) as a table with the columns of ``documents`` and one of a clashing name."""
    def make(rows):
        full = [(i, t, "en", "src0", None if t is None else len(t), "x") for i, t in rows]
        return spark.createDataFrame(full, "doc_id long, text string, lang string, source string, n_chars long, ids string")
    return make


@pytest.fixture(scope="session")
def odd_texts():
    """Texts that break things: null, empty, blank, one giant word, astral characters, controls."""
    rng = random.Random(5)
    alphabet = "abcde ABC\n\t.,;:'0123456789éß漢字😀\x0b ŝİ"
    own = [None, "", " ", "\n\n", "a", "ab", "x" * 30_000, " " * 5_000, "the the the", "é" * 7, "😀😀 😀",
           "a b c d e f g h i j", "0" * 400]
    return own + ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 300))) for _ in range(60)]
