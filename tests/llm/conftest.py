import os
import random

import pytest

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, id long, size long, key string, doc string, score double, label int, found string"


@pytest.fixture(scope="session")
def sf():
    if not os.path.isdir(SF):
        pytest.skip("test tables are not here")
    return SF


def rows():
    """Nulls in every column, empty and very long texts, ties, repeated rows, and columns with clashing names."""
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abcdeé") for _ in range(rng.randint(2, 7)))
    text = " ".join(word() for _ in range(300))
    texts = [text, text, text.upper(), None, "", "", " \n\t ", "x", "x", text + " tail", "word " * 40_000, "ÄÖ ü z 漢字 🙂", "  two  spaces \n\n lines \n"]
    out = [(i, t, None if i % 4 == 0 else "en", None if i % 5 == 0 else f"s{i % 2}", None if t is None else len(t)) for i, t in enumerate(texts)]
    out += [(3, None, "en", "s1", None), (7, "x", None, None, 1), (7, "x", None, None, 1), (None, "no id", "en", "s0", 5), (None, None, None, None, None)]
    return [(*r, 1, None, "k", "d", None, None, "f") for r in out]


@pytest.fixture(scope="session")
def odd(spark):
    return spark.createDataFrame(rows(), SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], SCHEMA)
