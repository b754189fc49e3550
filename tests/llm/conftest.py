import random

import pytest

WORDS = ["the", "of", "river", "stone", "Über", "cañón", "light", "seven", "walks", "under", "old", "bridge", "naïve", "tree", "cloud", "iron", "salt", "wind", "green", "door"]


@pytest.fixture(scope="session")
def edge_docs(spark):
    """Nulls, empty and long texts, ties, repeated rows, and extra columns with clashing names."""
    rng = random.Random(5)
    text = lambda n: " ".join(rng.choice(WORDS) + str(rng.randrange(40)) for _ in range(n))
    base = text(60)
    near = base.split()
    near[30] = "changed"
    long = text(3000)
    rows = [
        (1, base, "en"), (2, " ".join(near), "en"), (3, base, "en"), (3, base, "en"), (4, "", "en"), (5, None, "de"), (6, "  \n \t", None), (7, "one", "en"), (None, text(20), "en"),
        (8, long, "en"), (9, long + " tail", "en"), (10, "!!! ### 123", "en"), (11, "a b c d e", "fr"), (11, "another text here", "fr"), (12, "x" * 5000, "en"), (13, "日本語 テキスト 😀 é", "ja"),
    ]
    frame = spark.createDataFrame([(*r, "s", 1.5, 7, "x") for r in rows], "doc_id bigint, text string, lang string, source string, score double, ids int, items string")
    return frame


@pytest.fixture(scope="session")
def no_docs(edge_docs):
    return edge_docs.limit(0)
