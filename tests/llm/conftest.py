from __future__ import annotations

import random

import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def prose(seed: int, n: int) -> str:
    r = random.Random(seed)
    return " ".join("".join(r.choice("abcdefghij") for _ in range(r.randint(2, 7))) for _ in range(n))


@pytest.fixture(scope="session")
def odd_rows():
    """Nulls in every column, empty, blank and long texts, ties, repeated rows."""
    base = prose(1, 120)
    near = base.split()
    near[60] = "changed"
    return [
        (1, base, "en", "a", 1), (2, base.upper(), "en", "a", 1), (3, " ".join(near), "en", None, None), (4, None, None, None, None), (5, "", "de", "b", 0), (6, "  \n ", "de", "b", 4),
        (7, prose(2, 40_000), "de", "a", 9), (8, "one", "en", "c", 3), (9, "one", "en", "c", 3), (9, "one", "en", "c", 3), (10, "1234 5678", None, "c", 9), (None, "ein Text ohne Nummer", "de", "a", 20),
        (11, "Größe ÄÖÜ ß ñ", "de", "b", 13), (12, "Größe äöü ß ñ", "de", "b", 13), (13, prose(3, 30) + "\n" + prose(4, 30), "en", "a", 7), (14, prose(5, 30) + "\n" + prose(4, 30), "en", "a", 7),
    ]


@pytest.fixture(scope="session")
def odd(spark, odd_rows):
    """The odd rows, with columns whose names clash with results."""
    from pyspark.sql import functions as F

    df = spark.createDataFrame(odd_rows, DOCS)
    for c in ("kept", "keep_id", "id", "copy", "score", "lang_pred", "rejected", "component_id", "class_id", "n_tokens", "removed", "bin_id"):
        df = df.withColumn(c, F.lit("clash"))
    return df


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], DOCS)


@pytest.fixture(scope="session")
def docs(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet")
