import random

import pytest

KINDS = "doc_id long, text string, lang string, source string, n_chars long, score double, slot int, id string, doc int, bucket int"


@pytest.fixture
def docs_of(spark):
    """A documents table, with clashing extra columns, from (doc_id, text) rows."""

    def make(rows):
        return spark.createDataFrame([(i, t, "en", None, None, 9.0, 7, "x", 3, None) for i, t in rows], KINDS)

    return make


@pytest.fixture
def prose():
    """Random texts of invented words."""

    def make(seed, n_docs, most_words=120, words=60):
        rng = random.Random(seed)
        vocabulary = ["".join(rng.choice("abcdehilnorst") for _ in range(rng.randint(1, 6))) for _ in range(words)]
        return [" ".join(rng.choice(vocabulary) for _ in range(rng.randint(0, most_words))) for _ in range(n_docs)]

    return make


@pytest.fixture
def odd_rows():
    """Rows with every kind of trouble: nulls, empty, blank, repeated, repeated ids, very long."""
    return [(1, "a b c d e f"), (1, "a b c d e f"), (2, None), (3, ""), (4, " \n\t"), (None, "a b c d e f"), (5, "Ünïcode é x\0y"),
            (1, "other text under the same id"), (6, "long words " * 40_000), (7, "x" * 300_000)]
