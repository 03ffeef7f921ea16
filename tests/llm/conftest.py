import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, tokens int, score double, part string"


def prose(rng, n):
    return " ".join(rng.choice("the of and a to in it was on that".split()) if rng.random() < 0.3 else "".join(rng.choice("abcdefgh") for _ in range(rng.randrange(2, 9))) for _ in range(n))


@pytest.fixture(scope="session")
def rows():
    """Texts with copies, near copies, shared passages, nulls, empties, a long one, repeated ids; columns that clash with the operators' own names."""
    rng = random.Random(5)
    shared = prose(rng, 40)
    base = [prose(rng, rng.randrange(1, 120)) for _ in range(30)]
    out = [(i, t) for i, t in enumerate(base)]
    out += [(100 + i, base[3]) for i in range(6)]
    out += [(110 + i, base[4].replace("the", "that", 1)) for i in range(2)]
    out += [(120 + i, f"{prose(rng, 15)} {shared} {prose(rng, 9)}") for i in range(5)]
    out += [(130, None), (131, ""), (132, "   \n\t"), (133, None), (134, prose(rng, 6000)), (135, "one"), (136, f"{shared} {shared}"), (137, "Mixed CASE Text and é ñ ü 日本"), (138, "a\n\na\n  a b\n")]
    return [(i, t, rng.choice(["en", None]), None if i % 9 == 0 else f"s{i % 3 if i % 2 else 0}", len(t or ""), 7, 0.5, "x") for i, t in out]


@pytest.fixture(scope="session")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="session")
def odd(spark):
    """Repeated rows and null ids."""
    return spark.createDataFrame([(5, "same text here", "en", "s", 1, 1, 1.0, "")] * 3 + [(None, "no id", None, None, None, None, None, None)] * 2, SCHEMA)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def labels(spark, rows):
    return spark.createDataFrame([(r[0], r[0] % 2, int(r[0] % 10 == 3)) for r in rows if r[0] % 3] + [(None, 1, 1), (2, None, None)], "doc_id long, quality int, toxic int")
