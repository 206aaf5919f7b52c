import random

import pytest

SCHEMA = "doc_id long, text string, lang string, bucket int, rep_id string, quality string, ids string, keep string, part int, row string, grp int, bits string, line int"
WORDS = "the of and cat river stone light window paper green silent morning walk under over seven maple cloud engine letter".split()


def prose(seed: int, n: int, vocabulary: int = 400) -> str:
    r = random.Random(seed)
    out = []
    for k in range(n):
        w = r.choice(WORDS) if r.random() < 0.4 else f"{r.choice(WORDS)}{r.choice(WORDS)}{r.randrange(vocabulary)}"
        out.append(w.capitalize() if k % 11 == 0 else w)
        if k % 11 == 10:
            out[-1] += ".\n" if k % 33 == 32 else "."
    return " ".join(out)


def row(doc_id, text):
    return (doc_id, text, "en", 1, "x", "high", "7", "no", 3, "r", 0, "b", 9)


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls, empty and very long texts, repeated rows and ids, columns with clashing names."""
    long = prose(7, 60_000)
    texts = [
        (None, prose(1, 60)), (1, None), (2, ""), (3, "  \n\n "), (4, prose(1, 60)), (5, prose(1, 60)), (5, prose(1, 60)), (6, long), (7, long + " tail"),
        (8, "***"), (9, "one"), (10, "one"), (11, "É́ 日本語 \U0001f600 x"), (None, None), (12, prose(3, 80)), (12, prose(4, 80)), (-13, prose(3, 80)),
    ]
    return spark.createDataFrame([row(*t) for t in texts], SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def make(spark):
    return lambda texts: spark.createDataFrame([row(*t) for t in texts], SCHEMA)
