"""Documents with nulls, ties, repeats, long and empty texts, and columns with clashing names."""

from __future__ import annotations

import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def prose(seed: int, n: int) -> str:
    rnd = random.Random(seed)
    letters = "abcdefghijklmnopqrstuvwxyz"
    return " ".join("".join(rnd.choice(letters) for _ in range(rnd.randint(2, 9))) for _ in range(n))


def rows_of(texts: list[str | None], first: int = 0):
    return [(first + i, t, ("en", "de", None)[i % 3], ("s1", "s1", "s2", None)[i % 4], len(t) if t is not None else None) for i, t in enumerate(texts)]


@pytest.fixture(scope="session")
def odd_texts() -> list[str | None]:
    base = prose(1, 120)
    words = base.split()
    near = " ".join([*words[:60], "other", *words[61:]])
    return [None, "", " \t\n", "one", "One", "two words", base, base, near, base.upper(), prose(2, 5000), "é ü ñ 中文 🎉", "a b\na b\na b", prose(3, 60) + " " + base, "<|endoftext|> it's"]


@pytest.fixture(scope="session")
def odd_docs(spark, odd_texts):
    from pyspark.sql import functions as F

    rows = rows_of(odd_texts)
    rows += [rows[6], rows[6], (None, "text without an id", "en", "s1", 18), (None, None, None, None, None)]
    docs = spark.createDataFrame(rows, SCHEMA)
    # Names that operators might use inside.
    return docs.withColumns({c: F.lit("clash") for c in ("id", "body", "h", "n", "kept", "keep_id", "tag", "node", "component", "row", "mark", "queue", "part", "ids", "payload")})


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], SCHEMA)
