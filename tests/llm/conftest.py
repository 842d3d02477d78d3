import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, digest string, n long, kept boolean, component long, size int, _file string"


def words(rng, n):
    return " ".join("".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 7))) for _ in range(n))


def rows_of(texts):
    """(id, text) pairs as rows with further columns whose names the operators use inside."""
    return [(i, t, "en", f"s{(i or 0) % 3}" if i is None or i % 5 else None, len(t or ""), "x", 1, True, 7, 3, "f") for i, t in texts]


@pytest.fixture(scope="session")
def texts():
    """Nulls, empty and very long texts, white space, ties, copies, near copies, shared passages, repeated rows."""
    rng = random.Random(3)
    base, long = words(rng, 120), words(rng, 30000)
    passage = words(rng, 110)
    near = base.split()
    out = [(0, None), (1, ""), (2, "  \t\n "), (3, base), (4, base.replace(" ", "  \n", 9)), (5, long), (6, long + " tail"), (7, "one"), (8, "ONE"), (9, "a b c d"), (10, "a b c d"), (11, "Ünï cödé ☃ 😀 <|endoftext|> x"), (None, base), (None, "alone without id")]
    out += [(12 + k, " ".join([*near[:k * 20], "zz", *near[k * 20 + 1 :]])) for k in range(6)]
    out += [(20 + k, words(rng, 60) + " " + passage + " " + words(rng, 40)) for k in range(4)]
    out += [(30, passage * 3), (31, "ab" * 900), (32, "same words " * 200), (33, "x" * 399), (34, "x" * 399), (35, "y" * 400), (36, "y" * 400), (3, base)]
    out += [(40 + k, words(rng, rng.randint(1, 90))) for k in range(25)]
    return out


@pytest.fixture(scope="session")
def docs(spark, texts):
    return spark.createDataFrame(rows_of(texts), SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], SCHEMA)
