"""Bag-of-words features whose vocabulary is a table: terms numbered by range, vectors assembled by a join.

Nothing of the vocabulary reaches the driver but its size. Document frequencies come from the training rows
alone; terms that only other rows hold have no column.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.linalg import VectorUDT
from pyspark.sql import DataFrame, functions as F, types as T

from diffgauge.operators.features import vocabulary
from diffgauge.operators.joins import hot_keys, salted_lookup
from diffgauge.operators.numbering import numbered
from diffgauge.session import materialize, scratch_dir


def term_index(train_terms: DataFrame, n_rows: int, min_df: int = 2, max_df: float = 0.5) -> DataFrame:
    """(term, df, index): the terms within the document-frequency bounds, numbered from 0 in their order. Stored."""
    kept = vocabulary(train_terms, n_rows, min_df, max_df)
    return materialize(numbered(kept, ["term"]).select("term", "df", (F.col("number") - 1).cast("int").alias("index")))


def sparse_rows(rows: DataFrame, terms: DataFrame, index: DataFrame, key: str, numeric: Sequence[str] = ()) -> DataFrame:
    """``rows`` with ``indices`` and ``values``: the term counts by ascending index, then the numeric columns.

    ``terms``: (key, term, n). A row without a known term has the numeric columns only. A term of most rows is
    spread over tasks.
    """
    size = index.count()
    known = salted_lookup(terms, index.select("term", "index"), ["term"], "inner", hot_keys(terms, ["term"]))
    bags = known.groupBy(key).agg(F.sort_array(F.collect_list(F.struct("index", F.col("n").cast("double").alias("n")))).alias("_b"))
    bag = F.coalesce("_b", F.expr("array()").cast("array<struct<index:int,n:double>>"))
    tail = [F.col(c).cast("double") for c in numeric]
    ends = [F.lit(size + i).cast("int") for i in range(len(numeric))]
    return (rows.join(bags, key, "left").withColumn("_b", bag)
            .withColumn("indices", F.concat(F.col("_b.index"), F.array(*ends).cast("array<int>")))
            .withColumn("values", F.concat(F.col("_b.n"), F.array(*tail).cast("array<double>"))).drop("_b"))


def with_vectors(rows: DataFrame, size: int, out: str = "features") -> DataFrame:
    """``rows`` with ``indices`` and ``values`` as one sparse vector of Spark ML, stored.

    A sparse vector is written as what it is made of and read back under the vector type, so no Python runs.
    """
    packed = rows.withColumn(out, F.struct(F.lit(0).cast("byte").alias("type"), F.lit(size).cast("int").alias("size"),
                                           "indices", "values")).drop("indices", "values")
    path = scratch_dir(rows.sparkSession)
    packed.write.parquet(path)
    schema = T.StructType([T.StructField(f.name, VectorUDT() if f.name == out else f.dataType) for f in packed.schema])
    return rows.sparkSession.read.schema(schema).parquet(path)


def column_moments(rows: DataFrame, n_rows: int) -> DataFrame:
    """(index, mean, scale): mean and standard deviation of every column that some row has, zeros included."""
    cells = rows.select(F.explode(F.arrays_zip("indices", "values")).alias("c")).select("c.indices", "c.values")
    sums = cells.groupBy(F.col("indices").alias("index")).agg(
        F.sum("values").alias("s"), F.sum(F.col("values") * F.col("values")).alias("q"))
    mean = F.col("s") / F.lit(float(n_rows))
    spread = F.sqrt(F.greatest(F.col("q") / F.lit(float(n_rows)) - mean * mean, F.lit(0.0)))
    return sums.select("index", mean.alias("mean"), F.when(spread > 0, spread).otherwise(1.0).alias("scale"))
