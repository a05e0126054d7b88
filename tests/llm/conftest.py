import random

import pytest

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"
#: Columns whose names the operators use themselves.
CLASHES = {"kept": "'mine'", "digest": "1", "tag": "2", "place": "3", "score": "'s'", "_text": "4", "covered": "5", "n": "6"}


def prose(seed: int, words: int) -> str:
    rnd = random.Random(seed)
    return " ".join("".join(rnd.choice("abcdefgéß") for _ in range(rnd.randint(2, 8))) for _ in range(words))


def edge_rows() -> list[tuple]:
    """Nulls in every column, empty and very long texts, ties, repeated rows."""
    base = prose(1, 300)
    near = base.replace(base.split()[7], "changed", 1)
    return [
        (1, base, "en", "a", 5),
        (2, base, "en", "a", 5),
        (2, base, "en", "a", 5),
        (3, near, None, None, None),
        (4, None, "en", "a", 0),
        (5, "", "en", "a", 0),
        (6, " \t\n ", "de", "b", 4),
        (None, prose(2, 40), "fr", "b", 1),
        (None, None, None, None, None),
        (7, prose(3, 30_000), "en", "a", 9),
        (8, "one two", "en", "a", 7),
        (9, "one  two", "en", "a", 8),
        (10, prose(4, 100) + " " + base[200:900] + " " + prose(5, 50), "es", "c", 1),
        (11, "é" * 900 + "x", "en", "c", 1),
        (12, "a" * 1000, "en", "c", 1),
    ]


@pytest.fixture(scope="session")
def edges(spark):
    return spark.createDataFrame(edge_rows(), COLUMNS).selectExpr("*", *[f"{v} AS {k}" for k, v in CLASHES.items()]).repartition(3)


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], COLUMNS)


@pytest.fixture(scope="session")
def documents(spark, small):
    return spark.read.parquet(f"{small}/documents.parquet")
