from __future__ import annotations

import random

import pytest
from pyspark.sql import DataFrame, SparkSession

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def sentences(seed: int, n: int, words: int = 400) -> str:
    rng = random.Random(seed)
    out = []
    for _ in range(n):
        out.append(" ".join("".join(rng.choice("abdeghiknorstu") for _ in range(rng.randint(1, 8))) for _ in range(rng.randint(3, 12))).capitalize() + ".")
    return "\n".join(out)


def texts() -> dict[int, str | None]:
    """Nulls, empties, odd spaces, near and exact copies, shared passages, a long text, other scripts."""
    base, passage = sentences(1, 30), sentences(2, 8)
    words = base.split(" ")
    near = words.copy()
    near[10] = "changed"
    far = [w if k % 6 else f"x{k}" for k, w in enumerate(words)]
    return {
        0: base, 1: base, 2: " ".join(near), 3: " ".join(far), 4: None, 5: "", 6: " \t\n\x0b\x0c\r ", 7: "one", 8: "one two three", 9: "ONE two THREE",
        10: sentences(3, 6) + "\n" + passage + "\n" + sentences(4, 6), 11: sentences(5, 3) + "\n" + passage, 12: "word " * 200, 13: "a\x00b c  d é Ü ß 日本語 🎉",
        14: sentences(6, 900), 15: "x" * 5000, 16: base.upper(), 17: "same line\nsame line\nsame line\n", 18: "ab " * 34, 19: "### $$$ %%% &&& <|> word word", 20: "12345 67890 !!!",
        21: base.replace("\n", "\r\n"),
    }


@pytest.fixture(scope="session")
def odd(spark: SparkSession) -> DataFrame:
    rows = [(k, t, None if k == 3 else "en", None if k == 2 else f"s{k % 2}", None) for k, t in texts().items()]
    extra = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "'z' AS score", "1 AS kept", "array(1) AS ids", "2 AS piece", "0 AS row_key")
    return extra.repartition(3)


@pytest.fixture(scope="session")
def empty(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], SCHEMA)
