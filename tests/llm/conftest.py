import random

import pytest

DOCUMENTS = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def words(rng, n, vocabulary=4000):
    return " ".join(f"w{rng.randrange(vocabulary):x}q" for _ in range(n))


def corpus(seed=1, n=120):
    """Rows (doc_id, text, lang, source, n_chars): copies, near copies, shared passages, empty, null and long texts."""
    rng = random.Random(seed)
    texts = [words(rng, rng.randrange(3, 120)) for _ in range(n)]
    passage = words(rng, 60)
    for k in range(0, n, 9):
        texts[k] = texts[k] + "\n" + passage + "\n" + words(rng, 5)
    base = words(rng, 90).split()
    for k in range(1, n, 10):
        near = list(base)
        for _ in range(rng.randrange(0, 3)):
            near[rng.randrange(len(near))] = f"x{rng.randrange(999)}"
        texts[k] = " ".join(near)
    texts[2], texts[3] = texts[50], texts[50].replace(" ", "\t \n")
    texts[4], texts[5], texts[6], texts[7] = "", None, "   \n", "Ünï çödé ☃ ẞ"
    texts[8] = words(rng, 9000)
    texts[12] = texts[8] + " tail"
    texts[13] = "one two three"
    texts[14] = "ONE two three"
    return [(k, t, ("en", "de", None)[k % 3], ("a", "a", "b", None)[k % 4], None if t is None else len(t)) for k, t in enumerate(texts)]


@pytest.fixture(scope="session")
def rows():
    return corpus()


@pytest.fixture(scope="session")
def docs(spark, rows):
    return spark.createDataFrame(rows, DOCUMENTS).repartition(5)


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], DOCUMENTS)
