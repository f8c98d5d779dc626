import random

import pytest


@pytest.fixture(scope="session")
def documents(spark):
    """A table of documents from (doc_id, text) pairs; with columns whose names clash with internal ones if asked."""

    def make(rows, odd=False):
        schema = "doc_id long, text string, lang string, source string, n_chars long"
        if odd:
            schema += ", order string, copy string, row string, hash string, places string, `a.b` string"
        width = 11 if odd else 5
        full = [(i, t, "en", "s", len(t or ""), *(["x"] * (width - 5))) for i, t in rows]
        return spark.createDataFrame(full, schema)

    return make


@pytest.fixture(scope="session")
def vocabulary():
    pick = random.Random(5)
    return ["".join(pick.choice("abcdefghij") for _ in range(pick.randint(2, 7))) for _ in range(400)]


@pytest.fixture
def prose(vocabulary):
    def make(seed, words):
        pick = random.Random(seed)
        return " ".join(pick.choice(vocabulary) for _ in range(words))

    return make
