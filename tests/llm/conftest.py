from __future__ import annotations

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, key string, token string"


@pytest.fixture(scope="session")
def corpus(spark):
    """Documents with nulls, empties, ties, copies, long texts and columns whose names clash with the operators' own."""
    base = "the quick brown fox jumps over the lazy dog while seven wizards brew strange tea in the old stone tower near the river bank every night"
    words = base.split()
    near = " ".join([*words[:-1], "morning"])
    long = " ".join(f"w{i % 977} the{i % 13}" for i in range(30_000))
    texts = [base, base.replace(" ", "  "), near, "", None, "   \n", "one", "one two three four", long, "Ünïcode 世界 <|endoftext|> tail", base, "1 2 3 !!", "one two three four five six", "a\tb\x1cc\xa0d"]
    rows = [(i, t, "en" if i % 2 else None, "s", None, "k", "t") for i, t in enumerate(texts)]
    rows += [(3, "repeated id", None, None, 1, None, None), (None, "no id", "de", "s", 1, "k", "t")]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def texts_of(frame):
    return [(r.doc_id, r.text or "") for r in frame.collect()]
