from __future__ import annotations

import random

import pytest

LONG = " ".join(f"w{i % 977}" for i in range(30_000))


@pytest.fixture(scope="session")
def nasty(spark):
    """Documents with nulls, empty and long texts, repeated rows and ids, and columns whose names operators use inside."""
    rng = random.Random(5)
    say = lambda n: " ".join(rng.choice("the of and alpha beta gamma delta Apple banana, cherry. émile zwölf 12 x-y").split()[0] if rng.random() < 0 else rng.choice(["the", "of", "and", "alpha", "beta", "gamma", "Apple", "banana,", "cherry.", "émile", "zwölf", "12", "x-y"]) for _ in range(n))
    base = say(60)
    rows = [(i, say(rng.randint(1, 90)), ("en", "de", None)[i % 3], ("a", "b", "ä", None)[i % 4]) for i in range(30)]
    rows += [(100, base, "en", "a"), (101, base + " more", "en", "a"), (102, base, "en", "b"), (103, None, "en", "b"), (104, "", None, None), (105, " \n\t ", "de", "b"), (106, LONG, "en", "a"), (107, "one", "fr", "c")]
    rows += [rows[3], rows[3], (None, say(40), "en", "a"), (None, None, None, None), (108, "a\0b\u00a0c\u2028d  e\r\nf", "en", "a")]
    return spark.createDataFrame([(*r, 7, "x", 1.5, True, 9, "y", 0, 3) for r in rows], "doc_id long, text string, lang string, source string, n_chars long, id string, size double, target boolean, taken int, label string, row int, n int")


@pytest.fixture(scope="session")
def no_labels(spark):
    return spark.createDataFrame([], "doc_id long, quality int, toxic int")
