"""Bag-of-words features, long (relational) and as Spark ML vectors."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml import Pipeline
from pyspark.ml.feature import CountVectorizer, RegexTokenizer, VectorAssembler, VectorSlicer
from pyspark.sql import DataFrame, functions as F

# word characters, two at least: letters, digits and underscore of any script
TERM_PATTERN = r"[\p{L}\p{N}_]{2,}"
WIDEST = 2 ** 31 - 1    # the library asks for a width; this one, the longest vector there is, drops no term


def terms_long(df: DataFrame, key: str, text: str) -> DataFrame:
    """(key, term, n): term counts per row, combined map-side."""
    words = F.regexp_extract_all(F.lower(F.col(text)), F.lit(f"({TERM_PATTERN})"), 1)
    return (df.select(key, F.explode(words).alias("term"))
            .groupBy(key, "term").agg(F.count(F.lit(1)).alias("n")))


def vocabulary(train_terms: DataFrame, n_rows: int, min_df: int = 2, max_df: float = 0.5) -> DataFrame:
    """(term, df) within the document-frequency bounds, of any size."""
    return (train_terms.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
            .where((F.col("df") >= min_df) & (F.col("df") <= max_df * n_rows)))


def bag_of_words(terms: DataFrame, words: DataFrame) -> DataFrame:
    """(key, term, n) restricted to the vocabulary: the sparse matrix in long form."""
    return terms.join(words.select("term"), "term", "left_semi")


def feature_pipeline(text: str, numeric: Sequence[str] = (), min_df: int = 2, max_df: float = 0.5,
                     out: str = "features") -> Pipeline:
    """Tokenizer, counts and the numeric columns appended; vectors stay sparse.

    All terms within the document-frequency bounds are kept. The fitted stage holds them on the driver, as
    every Spark ML text model does; ``bag_of_words`` is the long form without that.
    """
    words = RegexTokenizer(inputCol=text, outputCol="_words", pattern=TERM_PATTERN, gaps=False, toLowercase=True)
    counts = CountVectorizer(inputCol="_words", outputCol="_counts", minDF=min_df, maxDF=max_df, vocabSize=WIDEST)
    both = VectorAssembler(inputCols=["_counts", *numeric], outputCol=out)
    return Pipeline(stages=[words, counts, both])


TAIL = "tail"


def with_tail(df: DataFrame, n: int, vec: str = "features", out: str = TAIL) -> DataFrame:
    """The last ``n`` columns of a vector as a short vector; the long one is never made dense."""
    first = plain_vectors(df, vec).select(vec).first()      # all vectors are of one size
    size = first[vec].size if first else n
    return VectorSlicer(inputCol=vec, outputCol=out, indices=list(range(size - n, size))).transform(plain_vectors(df, vec))


def plain_vectors(df: DataFrame, vec: str = "features") -> DataFrame:
    """``df`` without the attributes of the vector's columns.

    The library's stages describe every column of a vector in the schema. With a vocabulary of hundreds of
    thousands of terms each task of each step of a fit would carry and parse that description; no model asks
    for it, as all columns are numeric.
    """
    return df.withColumn(vec, F.col(vec).alias(vec, metadata={}))
