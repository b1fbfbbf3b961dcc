import random

import pytest

WORDS = "river stone garden letter morning winter bridge harbour copper lantern meadow signal orchard paper candle valley engine window silver forest market shadow branch anchor".split()


@pytest.fixture
def prose():
    """prose(seed, n): n words of invented text, the same for the same arguments."""

    def make(seed: int, n: int) -> str:
        r = random.Random(seed)
        return " ".join(r.choice(WORDS) + str(r.randrange(40)) for _ in range(n))

    return make


@pytest.fixture
def documents(spark):
    """documents(rows of (doc_id, text[, source])): the table with all its columns and clashing extras."""

    def make(rows):
        full = [(r[0], r[1], "en", r[2] if len(r) > 2 else "web", len(r[1] or ""), "x", 1, True) for r in rows]
        return spark.createDataFrame(full, "doc_id long, text string, lang string, source string, n_chars long, kept string, n long, rep boolean")

    return make
