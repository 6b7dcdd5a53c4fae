import random

import pytest

#: Columns with names that operators use for themselves.
EXTRA = "score string, kept string, key string, head string, fp string, bin_id string, g string, cluster string, n_tokens string, u string"


@pytest.fixture(scope="session")
def corpus():
    """(doc_id, text): prose with copies, near copies and shared passages."""
    rng = random.Random(11)
    vocabulary = ["".join(rng.choice(["an", "er", "th", "on", "é", "st", "ing"]) for _ in range(rng.randrange(1, 5))) for _ in range(400)]
    prose = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    shared = [prose(30) for _ in range(4)]
    rows = []
    for i in range(0, 600, 2):
        parts = [prose(rng.randrange(1, 80))] + ([rng.choice(shared), prose(20)] if rng.random() < 0.3 else [])
        rows.append((i, "\n".join(parts)))
    for i in range(1, 200, 2):
        text = rng.choice(rows)[1]
        words = text.split(" ")
        if rng.random() < 0.5 and len(words) > 20:
            words[rng.randrange(len(words))] = "changed"
        rows.append((i, " ".join(words) if rng.random() < 0.7 else text.replace(" ", "  \t")))
    return rows


@pytest.fixture(scope="session")
def make(spark):
    """Documents with all columns from (doc_id, text), and columns with clashing names."""

    def build(rows):
        full = [(i, t, ["en", "de", None][n % 3], ["a", "a", "b", None][n % 4], len(t or ""), *["x"] * 10) for n, (i, t) in enumerate(rows)]
        return spark.createDataFrame(full, f"doc_id long, text string, lang string, source string, n_chars long, {EXTRA}").repartition(3)

    return build


@pytest.fixture(scope="session")
def awkward(make):
    """Null, empty, blank, very long and repeated texts, null ids."""
    long = " ".join(f"word{n % 977}" for n in range(30_000))
    return make([(1, None), (2, ""), (3, " \n\t "), (4, long), (5, long), (6, "a b c d e f"), (6, "a b c d e f"), (None, "a b c d e f"), (None, None), (7, "x"), (8, "é \U0001f600 A-Z"), (9, "y" * 5000)])


@pytest.fixture(scope="session")
def nothing(make):
    return make([]).limit(0)
