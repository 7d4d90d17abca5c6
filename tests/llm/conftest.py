import random

import pytest

CLASH = ["digest", "start", "win", "id", "score", "keep", "ids", "rare", "row", "copies", "hash", "bucket", "languages", "text_2", "spans", "n", "vec", "window", "stats", "query"]
KIND = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"{c} string" for c in CLASH)


def words(rng, n, alphabet="abcdefghij", size=(2, 8)):
    return [" ".join([]).join(rng.choice(alphabet) for _ in range(rng.randint(*size))) for _ in range(n)]


@pytest.fixture(scope="session")
def make(spark):
    """A table of documents from (id, text) or (id, text, lang), with columns whose names clash with the operators' own."""

    def build(rows):
        full = [(r[0], r[1], r[2] if len(r) > 2 else "en", "s", None if r[1] is None else len(r[1]), *[f"x{i}" for i in range(len(CLASH))]) for r in rows]
        return spark.createDataFrame(full, KIND)

    return build


@pytest.fixture(scope="session")
def odd(make):
    """Nulls, empties, blanks, a very long text, ties and repeated rows."""
    rng = random.Random(5)
    long = " ".join(words(rng, 30_000))
    shared = "one two three four five six seven eight nine ten\n" * 4
    return make([(1, None), (2, ""), (3, "   \n\n"), (None, "a text without an id"), (None, None), (4, shared), (4, shared), (5, shared), (6, "!!!"), (7, long), (8, "x"), (4, "same id, other text")])


@pytest.fixture(scope="session")
def empty(make):
    return make([])
