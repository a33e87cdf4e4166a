import random

import pytest

WORDS = [f"{a}{b}{c}" for a in ("ba", "ke", "li", "mo", "nu") for b in ("ra", "se", "ti") for c in ("", "n", "st", "ly")]


def sentence(rng, n):
    return " ".join(rng.choice(WORDS) for _ in range(n))


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Null, empty, blank, very long, repeated and tied rows, with clashing extra columns."""
    rng = random.Random(4)
    long = sentence(rng, 30_000)
    body = sentence(rng, 120)
    rows = [
        (1, None), (2, ""), (3, " \t\n "), (4, "one"), (5, "one two"), (6, long), (7, body), (7, body), (8, body), (9, body + " tail"),
        (None, "no id here"), (10, "Zürich ÄÖ ßen 漢字 🙂 " * 9), (11, "a\x0bb\x0cc d"), (12, sentence(rng, 300)), (13, "x" * 5000), (14, "ab " * 400),
    ]
    cols = "doc_id long, text string, fingerprint string, component_id int, chunk int, score double, node long, slot int, size int"
    return spark.createDataFrame([(i, t, "z", 0, 0, 0.0, 0, 0, 0) for i, t in rows], cols)


@pytest.fixture(scope="session")
def no_docs(odd_docs):
    return odd_docs.limit(0)

