"""Rows that every corpus operator must handle: nulls, empty and long texts, repeats, clashing columns."""

import random

import pytest
from pyspark.sql import functions as F

FOLDER = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def odd_rows():
    rnd = random.Random(7)
    words = ["the", "of", "Ünïcode", "it's", "a1b2", "...", "x=y", "naïve", "日本語", "don't", "WORD", "re-do"]
    texts = [" ".join(rnd.choice(words) for _ in range(rnd.randint(1, 60))) for _ in range(30)]
    texts += [None, "", " ", "\n", "  two  spaces \t tab\r\n end \n", "á é", "x y　z\x1cq\x00r",
              "ends with space ", " starts", "line\n\nline", "İstanbul ſtraße K", "<|endoftext|> inside",
              "long " * 30000, "y" * 5000]
    rows = [(i, t, "en", "s", None if t is None else len(t)) for i, t in enumerate(texts)]
    return rows + [rows[3], rows[3], (None, "no id here", None, None, None), (None, None, None, None, None),
                   (3, "same id, other text", "en", "s", 19)]


@pytest.fixture(scope="module")
def odd(spark):
    """The odd rows over several partitions, with extra columns named like the operators' own."""
    df = spark.createDataFrame(odd_rows(), SCHEMA).repartition(5)
    for name in ("part", "n", "ids", "first", "start", "score", "class_id", "hash", "features", "key"):
        df = df.withColumn(name, F.lit("clash"))
    return df


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)
