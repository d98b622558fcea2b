import random

import pytest

SYLLABLES = ["on", "tha", "re", "é", "schl", "ing", "ou", "ver", "ci", "lo"]
EXTRA = "node binary, n string, prefix string, part string, key string, bench_from string, secret_base string, n_chars int"


def words(rng, n):
    return ["".join(rng.choice(SYLLABLES) for _ in range(rng.randint(1, 4))) for _ in range(n)]


@pytest.fixture(scope="session")
def rng():
    return random.Random(7)


@pytest.fixture(scope="session")
def documents(spark):
    """Near copies, copies, repeated rows, null and empty texts, a long text, a null id and columns with clashing names."""
    rng = random.Random(7)
    rows, base = [], words(rng, 120)
    for i in range(40):
        own = list(base)
        for _ in range(rng.randint(0, 6)):
            own[rng.randrange(len(own))] = "".join(words(rng, 2))
        rows.append((i, " ".join(own)))
    rows += [(40 + i, " ".join(words(rng, rng.randint(1, 80)))) for i in range(30)]
    rows += [(80, "Same text here"), (81, "same TEXT  here"), (82, None), (83, ""), (84, " \n\t "), (85, None), (86, "one two three four"), (87, "one two three four five")]
    rows += [(88, " ".join(words(rng, 30_000))), (89, "x" * 200_000), (0, rows[0][1]), (90, rows[3][1]), (None, "a text of a row without any id"), (91, "é" * 9 + " \U0001F600 ß")]
    extra = (None, "n", None, "part", "key", "from", "base", 3)
    return spark.createDataFrame([r + extra for r in rows], f"doc_id long, text string, {EXTRA}").repartition(4).cache()


@pytest.fixture(scope="session")
def no_documents(spark):
    return spark.createDataFrame([], f"doc_id long, text string, lang string, {EXTRA}")
