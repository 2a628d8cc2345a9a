"""Helpers the corpus operators share: texts of a batch, document splits, stored tables, running totals."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import pairwise

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from diffgauge.session import scratch_dir


def texts_of(column: pa.Array) -> list[str]:
    """The strings of a column; a null text counts as empty."""
    return [t or "" for t in column.to_pylist()]


def slices(batches: Iterator[pa.RecordBatch], rows: int = 256) -> Iterator[pa.RecordBatch]:
    """The same rows in short batches, so what a worker derives from a batch of texts stays small."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def text_slices(batches: Iterator[pa.RecordBatch], size: int = 1 << 22) -> Iterator[pa.RecordBatch]:
    """The same rows in batches whose texts lie in one window of ``size`` bytes, by the bytes before their end."""
    for batch in batches:
        lengths = pc.fill_null(pc.binary_length(batch.column("text")), 0).to_numpy()
        window = np.cumsum(lengths, dtype=np.int64) // size
        cuts = [0, *(np.flatnonzero(np.diff(window)) + 1).tolist(), batch.num_rows]
        for at, stop in pairwise(cuts):
            if at < stop:
                yield batch.slice(at, stop - at)


def partition_id() -> int:
    return TaskContext.get().partitionId()


def remainder(doc_id: Column, mod: int) -> Column:
    """crc32 of the id written as text, modulo ``mod``; a null id counts as the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % mod


def store(df: DataFrame, path: str | None = None, codec: str = "zstd") -> DataFrame:
    """Write a table to the shared folder and read it back; cuts the lineage for good."""
    path = path or scratch_dir(df.sparkSession)
    df.write.option("compression", codec).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def part_bases(parts: DataFrame, part: str, count: str) -> DataFrame:
    """What lies before each part: one row per part, from one total per part.

    The window sorts a row per written part (never data rows), so its single task stays small.
    """
    totals = parts.groupBy(part).agg(F.sum(count).alias("total"))
    before = F.sum("total").over(Window.orderBy(part).rowsBetween(Window.unboundedPreceding, -1))
    return totals.select(part, F.coalesce(before, F.lit(0)).alias("base"), "total")


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")
