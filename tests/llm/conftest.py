"""Documents with every odd case: nulls, empty and long texts, ties, repeated rows, columns whose names clash."""

import random

import pytest

WORDS = [f"{a}{b}{c}" for a in ("ka", "lo", "mi") for b in ("ra", "sel", "to", "un") for c in ("", "n", "s", "ten")]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, id long, key string, rank int, n long, row string, component string"


def prose(seed: int, n: int) -> str:
    rnd = random.Random(seed)
    return " ".join(rnd.choice(WORDS) + ("." if rnd.random() < 0.1 else "") for _ in range(n))


def odd_rows() -> list[tuple]:
    base = prose(1, 120)
    near = base.replace(base.split()[60], "changed", 1)
    texts = [base, base, near, prose(2, 200), None, "", " \t\n", "Ab", "ab", "one two three", "One TWO three", prose(3, 30_000), "é漢字 <|endoftext|> 'll we've  \n\n x" * 3, "x" * 5000, "a b c d e " * 60, "JUNK!! WORDS!! " * 80, prose(4, 90), prose(5, 75) + "\n" + prose(5, 75)]
    rows = [(i, t, "en", ["s1", "s2", None, "s3"][i % 4], len(t or ""), 7, "k", 1, 2, "r", "c") for i, t in enumerate(texts)]
    return [*rows, rows[3], rows[3], (None, prose(6, 60), None, None, None, None, None, None, None, None, None), (None, base, None, "s1", None, None, None, None, None, None, None)]


@pytest.fixture(scope="session")
def docs(spark):
    return spark.createDataFrame(odd_rows(), SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], SCHEMA)
