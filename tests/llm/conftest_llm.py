import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, row string, label string, text_key string"


def rows(texts, ids=None):
    """Documents with extra columns whose names the operators use inside."""
    ids = range(len(texts)) if ids is None else ids
    return [(i, t, "en", f"s{k % 3}", len(t or ""), "r", "l", "k") for k, (i, t) in enumerate(zip(ids, texts, strict=True))]


@pytest.fixture(scope="session")
def frame(spark):
    return lambda texts, ids=None: spark.createDataFrame(rows(texts, ids), SCHEMA)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def vocabulary():
    rng = random.Random(1)
    return ["".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(2, 8))) for _ in range(3000)]


@pytest.fixture(scope="session")
def prose(vocabulary):
    def make(n, seed):
        rng = random.Random(seed)
        return " ".join(rng.choice(vocabulary) for _ in range(n))

    return make


#: Null, empty, blank, no word of letters, one word, invalid pairs of marks, NUL, and one long text.
ODD = [None, "", " \t\n", "123 !?", "one", "é ß 中文 🙂", "a\0b\0", "word " * 30_000]
