import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def words(rng: random.Random, n: int) -> str:
    return " ".join("".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 7))) for _ in range(n))


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Nulls in every column, empty and very long texts, ties, repeated rows, clashing extra columns."""
    rng = random.Random(5)
    base = words(rng, 60)
    rows = [
        (1, base, "en", "src0", 3),
        (2, base + " ", "en", "src0", 3),
        (3, base.replace(" ", "\n"), None, None, None),
        (3, base.replace(" ", "\n"), None, None, None),
        (4, None, None, "src1", None),
        (5, "", "en", None, 0),
        (6, " \t\n", "de", "src1", 3),
        (None, base, "en", "src2", 1),
        (None, None, None, None, None),
        (7, words(rng, 30_000), "fr", "src1", 1),
        (8, "Ünï \U0001f600 é ß x\x85y  z", "de", "src9", 1),
        (9, "one", "en", "src0", 3),
        (10, "one two", "en", "src0", 3),
        *((100 + k, words(rng, 40), "en", f"src{k % 4}", 1) for k in range(40)),
    ]
    return spark.createDataFrame([(*r, "x", 0.5, 7) for r in rows], SCHEMA + ", id string, score double, key int").repartition(3)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], SCHEMA)
