import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double, word string, row long, draw long, block string"


def awkward_rows():
    """Nulls in any column, empty and long texts, ties, repeated rows; extra columns named like the operators' own."""
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abcdeé") for _ in range(rng.randint(1, 7)))
    texts = [" ".join(word() for _ in range(rng.randint(0, 60))) for _ in range(30)]
    texts += [None, "", "   \n\t ", "x", " ".join(word() for _ in range(6000)), "Ünïcode ’quotes’ 你好 <|endoftext|> İΣ", texts[3], texts[3], texts[5] + " tail"]
    rows = [(i, t, None if i % 5 == 0 else "en", [None, "hot", "hot", "b"][i % 4], None if t is None else len(t), 0.5, "w", i, i, "z") for i, t in enumerate(texts)]
    rows += [rows[2], rows[2], (None, "no id here", None, None, None, None, None, None, None, None), (7, "another text of an id", "en", "b", 1, 0.1, None, None, None, None)]
    return rows


@pytest.fixture(scope="session")
def awkward(spark):
    return spark.createDataFrame(awkward_rows(), SCHEMA).repartition(3).cache()


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)
