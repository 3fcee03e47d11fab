"""Small awkward tables for the operators."""

from __future__ import annotations

import random

from pyspark.sql import DataFrame, SparkSession

LONG = " ".join(f"word{k % 977}" for k in range(30_000))
BASE = " ".join(f"tok{k}" for k in range(60))
NEAR = BASE.replace("tok30 ", "changed ")


def awkward_documents(spark: SparkSession) -> DataFrame:
    """Nulls in every column, empty and very long texts, ties, repeated rows, extra columns with clashing names."""
    rows = [
        (1, BASE, "en", "a", 1, "x"), (2, NEAR, "en", "a", 1, "y"), (3, BASE.upper() + "  ", None, None, None, None),
        (4, None, "en", "a", 0, "z"), (5, "", "en", "a", 0, None), (6, " \n\t ", "en", "a", 0, "z"), (7, LONG, "en", "b", len(LONG), "q"),
        (8, "short text", "en", "b", 10, "q"), (8, "short text", "en", "b", 10, "q"), (8, "other text of eight", "en", "b", 10, "q"),
        (None, "nobody's text", None, None, None, None), (None, BASE, None, None, None, None), (9, "ünïcode ☃\nline\r\nlast\n", "fr", "b", 20, "q"),
    ]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, kept string")


def empty_documents(spark: SparkSession) -> DataFrame:
    return awkward_documents(spark).where("1 = 0")


def random_documents(seed: int, count: int, vocabulary: int = 40, longest: int = 30) -> list[tuple[int, str]]:
    """Texts with exact and near copies."""
    r = random.Random(seed)
    texts: list[str] = []
    for _ in range(count):
        if texts and r.random() < 0.5:
            words = r.choice(texts).split(" ")
            for _ in range(r.randint(0, 2)):
                words[r.randrange(len(words))] = f"w{r.randrange(vocabulary)}"
            texts.append(" ".join(words))
        else:
            texts.append(" ".join(f"{r.choice('Ww')}{r.randrange(vocabulary)}" for _ in range(r.randint(1, longest))))
    return list(enumerate(texts))
