"""Consecutive numbers for rows in a given order, without a sort in one task."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from diffgauge.session import materialize

_PLACE_BITS = 33    # of a monotonically increasing id


def numbered(df: DataFrame, order: Sequence[str | Column], groups: Sequence[str] = (), out: str = "number") -> DataFrame:
    """1-based numbers per group in the given order; rows with a null group are dropped.

    Rows are range-partitioned by all keys and at last by a hash of the whole row, so a column of one value,
    or one group that holds most rows, spreads over all tasks. A task numbers its rows as it writes them; one
    count per group and written part gives the rest.
    """
    order = [F.col(c) if isinstance(c, str) else c for c in order]
    keys = [*[F.col(g) for g in groups], *order, F.xxhash64(*df.columns)]
    parts = max(1, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    rows = df.where(" and ".join(f"`{g}` is not null" for g in groups)) if groups else df
    placed = materialize(rows.repartitionByRange(parts, *keys).sortWithinPartitions(*keys).withColumn(
        "_id", F.monotonically_increasing_id()))
    placed = placed.withColumn("_part", F.shiftright("_id", _PLACE_BITS)).withColumn(
        "_place", F.col("_id").bitwiseAND((1 << _PLACE_BITS) - 1)).drop("_id")
    counts = placed.groupBy(*groups, "_part").agg(F.count(F.lit(1)).alias("_n"), F.min("_place").alias("_first"))
    earlier = (Window.partitionBy(*groups) if groups else Window.partitionBy(F.lit(0))).orderBy("_part").rowsBetween(
        Window.unboundedPreceding, -1)
    starts = counts.select(*groups, "_part", (F.coalesce(F.sum("_n").over(earlier), F.lit(0)) - F.col("_first")).alias("_start"))
    if not groups:
        starts = F.broadcast(starts)        # one row per written part
    return placed.join(starts, [*groups, "_part"]).withColumn(out, F.col("_place") + F.col("_start") + 1).drop(
        "_part", "_place", "_start")
