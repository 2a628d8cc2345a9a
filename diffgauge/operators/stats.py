"""Summaries and rank tests on histograms of distinct values."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F, types as T

from diffgauge.operators.joins import measured_lookup, with_scalars
from diffgauge.operators.ranks import (HIGH_MIDDLE, LOW_MIDDLE, medians, order_statistics,
                                       running_totals, top_share)


def summary(df: DataFrame, value: str, groups: Sequence[str] = (), position: str | None = None,
            cuts: Sequence[float] | None = None) -> DataFrame:
    """Mean, both medians, mode, population variance and the value at descending
    index int(0.1 n). Mode ties go to the value met first by ``position``
    (the smallest value without one)."""
    groups = list(groups)
    mids = order_statistics(df, value, {"_lo": LOW_MIDDLE, "_hi": HIGH_MIDDLE, "top_tenth": top_share(0.1)},
                            groups, cuts)
    rows = df.where(F.col(value).isNotNull())
    moments = rows.groupBy(*groups).agg(F.avg(value).alias("mean"), F.var_pop(value).alias("pvariance"))
    first = mode_first(rows, value, groups, position)
    out = _join(_join(mids, moments, groups), first, groups)
    return out.select(*groups, "n", "mean", ((F.col("_lo") + F.col("_hi")) / 2).alias("median"),
                      F.col("_hi").alias("median_high"), "mode", "pvariance", "top_tenth")


def mode_first(df: DataFrame, value: str, groups: Sequence[str] = (), position: str | None = None) -> DataFrame:
    """(groups, mode): most frequent value; ties go to the first met."""
    first = F.min(position or value).alias("_p")
    hist = df.groupBy(*groups, value).agg(F.count(F.lit(1)).alias("_c"), first)
    return hist.groupBy(*groups).agg(
        F.min_by(value, F.struct((-F.col("_c")).alias("c"), F.col("_p").alias("p"))).alias("mode"))


def _join(left: DataFrame, right: DataFrame, groups: Sequence[str]) -> DataFrame:
    """Join a table to one with one row per group (one row in all without groups)."""
    return left.join(right, list(groups), "inner") if groups else with_scalars(left, right)


def _quantile(p: float) -> tuple:
    """Neighbouring positions and the weight of linear interpolation."""
    def at(n: Column) -> Column:
        return (n - 1) * p
    return (lambda n: F.floor(at(n)), lambda n: F.ceil(at(n)), at)


def box_summary(df: DataFrame, value: str, groups: Sequence[str] = (),
                cuts: Sequence[float] | None = None) -> DataFrame:
    """Minimum, quartiles, maximum, whisker ends at 1.5 IQR and the outlier count."""
    groups = list(groups)
    probs = {"min": 0.0, "q1": 0.25, "median": 0.5, "q3": 0.75, "max": 1.0}
    positions = {}
    for name, p in probs.items():
        lo, hi, _ = _quantile(p)
        positions[f"_{name}_lo"], positions[f"_{name}_hi"] = lo, hi
    found = order_statistics(df, value, positions, groups, cuts)
    cols = []
    for name, p in probs.items():
        at = (F.col("n") - 1) * p
        part = at - F.floor(at)
        cols.append((F.col(f"_{name}_lo") + part * (F.col(f"_{name}_hi") - F.col(f"_{name}_lo"))).alias(name))
    box = found.select(*groups, "n", *cols)
    iqr = F.col("q3") - F.col("q1")
    box = box.withColumn("lower_fence", F.col("q1") - 1.5 * iqr).withColumn("upper_fence", F.col("q3") + 1.5 * iqr)
    # one fence row per group meets the histogram of the group, not its rows
    hist = df.where(F.col(value).isNotNull()).groupBy(*groups, value).agg(F.count(F.lit(1)).alias("_c"))
    inside = (F.col(value) >= F.col("lower_fence")) & (F.col(value) <= F.col("upper_fence"))
    counted = _join(hist, box.select(*groups, "lower_fence", "upper_fence"), groups)
    tails = counted.groupBy(*groups).agg(
        F.min(F.when(inside, F.col(value))).alias("whisker_low"),
        F.max(F.when(inside, F.col(value))).alias("whisker_high"),
        F.sum(F.when(inside, 0).otherwise(F.col("_c"))).alias("outliers"))
    return _join(box, tails, groups)


def median_split(df: DataFrame, size: str, groups: Sequence[str], out: str = "is_large",
                 cuts: Sequence[float] | None = None) -> DataFrame:
    """Mark rows at or above their group's median size."""
    mid = medians(df, size, groups, "_median", cuts).drop("n")
    marked = measured_lookup(df, mid, groups, "inner") if groups else with_scalars(df, mid)
    return marked.withColumn(out, F.col(size) >= F.col("_median")).drop("_median")


def normal_tail(z: Column) -> Column:
    """P(Z > z) for the standard normal, by a Chebyshev fit of the
    complementary error function (relative error below 1.2e-7)."""
    x = F.abs(z) / F.sqrt(F.lit(2.0))
    t = 1 / (1 + 0.5 * x)
    # Published Chebyshev coefficients of erfc.
    coef = (-1.26551223, 1.00002368, 0.37409196, 0.09678418, -0.18628806, 0.27886807,
            -1.13520398, 1.48851587, -0.82215223, 0.17087277)
    poly = F.lit(coef[-1])
    for c in reversed(coef[:-1]):
        poly = F.lit(c) + t * poly
    erfc = t * F.exp(-x * x + poly)
    return F.when(z >= 0, erfc / 2).otherwise(1 - erfc / 2)


def _p_values(z: Column) -> list[Column]:
    return [F.least(2 * normal_tail(F.abs(z)), F.lit(1.0)).alias("p_two_sided"),
            normal_tail(z).alias("p_greater"), normal_tail(-z).alias("p_less")]


EXACT_BELOW = 50    # fixed value: both samples must be smaller for the exact rank-sum distribution


def rank_sum_counts(n1: int, n2: int) -> np.ndarray:
    """How many of the C(n1 + n2, n1) orders of two samples without ties have U = 0, 1, ..., n1 * n2.

    Ranks join one after another: a sample of i members with pair sum u either leaves out the next rank or
    takes it, which adds the number of others before it.
    """
    ways = np.zeros((n1 + 1, n1 * n2 + 1))
    ways[0, 0] = 1.0
    for rank in range(n1 + n2):
        for i in range(min(rank + 1, n1), 0, -1):
            others = rank - (i - 1)         # members of the other sample below this rank
            if 0 <= others <= n2:
                ways[i, others:] += ways[i - 1, :ways.shape[1] - others]
    return ways[n1]


@F.pandas_udf(T.StructType([T.StructField("low", T.DoubleType()), T.StructField("high", T.DoubleType())]))
def _exact_tails(n1: pd.Series, n2: pd.Series, u: pd.Series) -> pd.DataFrame:
    """P(U <= u) and P(U >= u) without ties; one small table per pair of sample sizes."""
    tails = {}
    low, high = [], []
    for a, b, x in zip(n1, n2, u):
        if (a, b) not in tails:
            ways = rank_sum_counts(int(a), int(b))
            tails[a, b] = np.cumsum(ways) / ways.sum(), np.cumsum(ways[::-1])[::-1] / ways.sum()
        low.append(tails[a, b][0][int(round(x))])
        high.append(tails[a, b][1][int(round(x))])
    return pd.DataFrame({"low": low, "high": high})


def mann_whitney(df: DataFrame, value: str, side: str, groups: Sequence[str] = (),
                 continuity: bool = True, cuts: Sequence[float] | None = None, exact: bool = True) -> DataFrame:
    """Rank-sum test of rows with ``side`` true (first sample) against the others.

    W is U of the first sample. As the usual test has it, p-values are exact where both samples have fewer than
    ``EXACT_BELOW`` members and no value repeats, else by the normal approximation with tie correction and, by
    default, continuity correction; ``method`` says which. ``z`` is the approximation's in any case.
    """
    groups = list(groups)
    first = F.col(side).cast("long")
    rows = df.where(F.col(side).isNotNull() & F.col(value).isNotNull())
    hist = running_totals(rows, value, {"n": F.lit(1), "n_first": first}, groups, cuts=cuts)
    rank = F.col("n_before") + (F.col("n") + 1) / 2
    agg = hist.groupBy(*groups).agg(
        F.sum(rank * F.col("n_first")).alias("_r"), F.sum("n_first").alias("n1"), F.sum("n").alias("_n"),
        F.sum(F.pow(F.col("n").cast("double"), 3) - F.col("n")).alias("_ties"))
    n1, n = F.col("n1").cast("double"), F.col("_n").cast("double")
    n2 = n - n1
    u = F.col("_r") - n1 * (n1 + 1) / 2
    centre = u - n1 * n2 / 2
    var = n1 * n2 / 12 * ((n + 1) - F.coalesce(F.try_divide(F.col("_ties"), n * (n - 1)), F.lit(0.0)))
    shift = F.signum(centre) * 0.5 if continuity else F.lit(0.0)
    # one-sided corrections move towards the centre from each side
    up = F.try_divide(centre - (0.5 if continuity else 0.0), F.sqrt(var))
    down = F.try_divide(centre + (0.5 if continuity else 0.0), F.sqrt(var))
    small = (n1 > 0) & (n2 > 0) & (n1 < EXACT_BELOW) & (n2 < EXACT_BELOW) & (F.col("_ties") == 0) if exact else F.lit(False)
    out = agg.select(*groups, "n1", n2.cast("long").alias("n2"), u.alias("w"),
                     F.try_divide(centre - shift, F.sqrt(var)).alias("z"), up.alias("_up"), down.alias("_down"),
                     F.when(small, "exact").otherwise("normal").alias("method"))
    if exact:       # one row per group meets the exact distribution
        is_exact = F.col("method") == "exact"
        counted = _exact_tails(*[F.when(is_exact, F.col(c)).otherwise(0).alias(c) for c in ("n1", "n2", "w")])
        out = out.withColumn("_t", counted).withColumn("_low", F.when(is_exact, F.col("_t.low"))).withColumn(
            "_high", F.when(is_exact, F.col("_t.high")))
    else:
        out = out.withColumn("_low", F.lit(None).cast("double")).withColumn("_high", F.lit(None).cast("double"))
    both = F.coalesce(2 * F.least("_low", "_high"), 2 * normal_tail(F.abs(F.col("z"))))
    return out.select(*groups, "n1", "n2", "w", "z", F.least(both, F.lit(1.0)).alias("p_two_sided"),
                      F.coalesce("_high", normal_tail(F.col("_up"))).alias("p_greater"),
                      F.coalesce("_low", normal_tail(-F.col("_down"))).alias("p_less"), "method")


def signed_rank(df: DataFrame, value: str, baseline: str, groups: Sequence[str] = (),
                zeros: str = "pratt", zero_baseline_as_one: bool = False,
                cuts: Sequence[float] | None = None) -> DataFrame:
    """Paired signed-rank test of value against baseline with effect size Z/sqrt(n).

    ``pratt`` ranks zero differences and then leaves them out of the sums,
    ``wilcoxon`` drops them first. ``zero_baseline_as_one`` repeats the published
    handling, which overwrites a zero baseline before testing.
    """
    groups = list(groups)
    base = F.when(F.col(baseline) == 0, F.lit(1.0)).otherwise(F.col(baseline)) if zero_baseline_as_one else F.col(baseline)
    diff = F.col(value) - base
    rows = df.where(F.col(value).isNotNull() & F.col(baseline).isNotNull()) \
        .select(*groups, F.abs(diff).alias("_size"), F.signum(diff).alias("_sign"))
    if zeros == "wilcoxon":
        rows = rows.where("_size > 0")
    hist = running_totals(rows, "_size", {"n": F.lit(1), "_plus": (F.col("_sign") > 0).cast("long")},
                          groups, cuts=cuts)
    rank = F.col("n_before") + (F.col("n") + 1) / 2
    used = F.col("_size") > 0
    agg = hist.groupBy(*groups).agg(
        F.sum("n").alias("n"),
        F.sum(F.when(used, F.col("n")).otherwise(F.lit(0))).alias("n_used"),
        F.sum(F.when(used, rank * F.col("_plus")).otherwise(F.lit(0.0))).alias("w_plus"),
        F.sum(F.when(used, rank * F.col("n")).otherwise(F.lit(0.0))).alias("_all"),
        F.sum(F.when(used, rank * rank * F.col("n")).otherwise(F.lit(0.0))).alias("_sq"))
    # under the null each used rank carries a fair sign: mean all/2, variance sq/4
    z = F.try_divide(F.col("w_plus") - F.col("_all") / 2, F.sqrt("_sq") / 2)
    out = agg.withColumn("z", z)
    return out.select(*groups, "n", "n_used", "w_plus", "z", *_p_values(F.col("z")),
                      (F.col("z") / F.sqrt(F.col("n").cast("double"))).alias("effect"))
