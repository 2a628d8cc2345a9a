"""Top-k selection per group with the two tie rules in use."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F


def score_levels(df: DataFrame, groups: Sequence[str], score: str, k: int,
                 extra: Sequence[Column] = ()) -> DataFrame:
    """The highest score levels of each group that the first k ranks touch.

    Rows are reduced to (group, score) counts map-side, then ``row_number() <= k``
    keeps at most k levels per group and task before the shuffle, whatever the
    number of ties. ``above`` counts the rows with a greater score.
    """
    groups = list(groups)
    levels = df.where(F.col(score).isNotNull()).groupBy(*groups, score).agg(F.count(F.lit(1)).alias("rows"), *extra)
    order = Window.partitionBy(*groups).orderBy(F.col(score).desc())
    few = levels.withColumn("_level", F.row_number().over(order)).where(F.col("_level") <= k)
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    return (few.withColumn("above", F.coalesce(F.sum("rows").over(before), F.lit(0)))
            .where(F.col("above") < k).drop("_level"))


def top_with_ties(df: DataFrame, groups: Sequence[str], score: str, k: int) -> DataFrame:
    """Rows whose rank by descending score is at most k; ties are all kept.

    The cut score of each group is joined back (one row per group) instead of
    ranking the rows, so a group whose rows all tie is not gathered in a task.
    """
    if k <= 0:
        return df.where(F.lit(False))
    cut = (score_levels(df, groups, score, k).groupBy(*groups)
           .agg(F.min(score).alias("_cut")))
    return df.join(cut, list(groups), "inner").where(F.col(score) >= F.col("_cut")).drop("_cut")


def top_exact(df: DataFrame, groups: Sequence[str], order: Sequence[Column], k: int,
              rank_as: str = "rank") -> DataFrame:
    """Exactly k rows per group in a total order (planned as WindowGroupLimit,
    so every task sends at most k rows per group)."""
    w = Window.partitionBy(*groups).orderBy(*order)
    return df.withColumn(rank_as, F.row_number().over(w)).where(F.col(rank_as) <= k)


def arg_min(df: DataFrame, *order: str) -> DataFrame:
    """The first row by the given order."""
    return df.orderBy(*order).limit(1)


def top_hits(df: DataFrame, groups: Sequence[str], score: str, truth: str, k: int = 10,
             prefix: str = "") -> DataFrame:
    """(groups, top, total_true, top_per): true rows among the top k with ties,
    and their share of all true rows of the group."""
    truth_sum = F.sum(F.col(truth)).alias("_true")
    best = (score_levels(df, groups, score, k, [truth_sum]).groupBy(*groups)
            .agg(F.sum("_true").alias(f"{prefix}top")))
    total = df.groupBy(*groups).agg(F.sum(truth).alias("total_true"))
    return (total.join(best, list(groups), "inner")
            .withColumn(f"{prefix}top_per",
                        F.try_divide(F.col(f"{prefix}top").cast("double"), F.col("total_true").cast("double"))))
