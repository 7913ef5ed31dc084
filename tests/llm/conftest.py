import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, rid long, h string"


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Null and empty texts, null and repeated ids, copies, a very long text, clashing column names."""
    rng = random.Random(7)
    words = ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(1, 7))) for _ in range(300)]

    def text(n):
        return " ".join(rng.choice(words) for _ in range(n))
    long = text(30_000)
    base = text(200)
    rows = [(1, None, None, None), (2, "", "en", "a"), (3, " \n\t ", None, "a"), (4, base, "en", "a"), (5, base.upper(), "en", "a"),
            (6, base, "en", "b"), (6, base, "en", "b"), (None, "Straße ÄÖÜ", "de", None), (8, "straße ÄÖÜ", "de", "b"),
            (9, long, "en", "c"), (10, long + " x", "en", "c"), (11, long, "fr", "c"), (12, "one two", "en", "c"),
            (13, "ONE\ttwo", "en", "c"), (14, "日本語 テキスト", None, "d"), (15, "12 34 !!", None, "d")]
    rows += [(100 + i, text(rng.randint(1, 60)), rng.choice(["en", "de", None]), "s%d" % (i % 3)) for i in range(60)]
    return spark.createDataFrame([(*r, -1, i, "x") for i, r in enumerate(rows)], SCHEMA).repartition(5)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], SCHEMA)
