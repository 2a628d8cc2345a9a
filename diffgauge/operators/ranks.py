"""Order statistics, ranks and running totals that never sort a group in one task.

A window over a whole group puts that group into one task. Here the value axis
is cut into ranges first; windows then run inside (group, range) pieces, and
only the per-range totals are ordered per group. The cut points are a bounded
list of numbers taken from a quantile sketch, and literals in the plan, so
every branch and every retried task cuts at the same places.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window, functions as F

from diffgauge.operators.numbering import numbered

_RANGE = "_range"


def cut_points(df: DataFrame, value: str, ranges: int | None = None) -> list[float]:
    """Up to ``ranges - 1`` increasing cut points from a quantile sketch."""
    if ranges is None:
        ranges = 4 * int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranges = min(ranges, 4096)
    if ranges < 2:
        return []
    numbers = df.select(F.col(value).cast("double").alias("v")).where("v is not null and not isnan(v)")
    found = numbers.approxQuantile("v", [i / ranges for i in range(1, ranges)], 1 / (2 * ranges))
    return sorted(set(found))


def unit_cuts(ranges: int = 64) -> list[float]:
    """Cut points for values known to lie in [0, 1]; needs no sketch."""
    return [i / ranges for i in range(1, ranges)]


def with_range(df: DataFrame, value: str, cuts: Sequence[float]) -> DataFrame:
    if not cuts:
        return df.withColumn(_RANGE, F.lit(0))
    edges = [float("-inf"), *cuts, float("inf")]
    stage = Bucketizer(splits=edges, inputCol="_as_double", outputCol=_RANGE, handleInvalid="keep")
    out = stage.transform(df.withColumn("_as_double", F.col(value).cast("double")))
    return out.withColumn(_RANGE, F.col(_RANGE).cast("int")).drop("_as_double")


def _before(keys: Sequence[str], order: Column):
    part = Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(0))
    return part.orderBy(order).rowsBetween(Window.unboundedPreceding, -1)


def _same(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> Column:
    cond = F.lit(True)
    for k in keys:
        cond = cond & left[k].eqNullSafe(right[k])
    return cond


def running_totals(df: DataFrame, value: str, sums: Mapping[str, str | Column],
                   groups: Sequence[str] = (), descending: bool = False,
                   cuts: Sequence[float] | None = None) -> DataFrame:
    """One row per (groups, value) with each sum and ``<name>_before``: the total
    over all values placed earlier in the order.

    Rows are reduced to distinct values map-side before anything is ordered.
    ``cuts=[]`` suits few distinct values per group.
    """
    groups = list(groups)
    if cuts is None:
        cuts = cut_points(df, value)
    exprs = {n: (F.col(e) if isinstance(e, str) else e) for n, e in sums.items()}
    hist = (with_range(df.where(F.col(value).isNotNull()), value, cuts)
            .groupBy(*groups, _RANGE, value)
            .agg(*[F.sum(e).alias(n) for n, e in exprs.items()]))
    direction = (lambda c: F.col(c).desc()) if descending else (lambda c: F.col(c).asc())
    inside = _before([*groups, _RANGE], direction(value))
    local = hist.select("*", *[F.coalesce(F.sum(n).over(inside), F.lit(0)).alias(f"{n}_before")
                               for n in exprs])
    if not cuts:
        return local.drop(_RANGE)
    totals = hist.groupBy(*groups, _RANGE).agg(*[F.sum(n).alias(f"_t_{n}") for n in exprs])
    across = _before(groups, direction(_RANGE))
    offsets = totals.select(*groups, _RANGE,
                            *[F.coalesce(F.sum(f"_t_{n}").over(across), F.lit(0)).alias(f"_o_{n}")
                              for n in exprs])
    joined = local.join(offsets, [*groups, _RANGE], "inner")
    return joined.select(*groups, value, *exprs,
                         *[(F.col(f"{n}_before") + F.col(f"_o_{n}")).alias(f"{n}_before")
                           for n in exprs])


def average_ranks(df: DataFrame, value: str, groups: Sequence[str] = (),
                  weight: str | Column | None = None,
                  cuts: Sequence[float] | None = None) -> DataFrame:
    """(groups, value, n, avg_rank): ties share the mean of their ranks."""
    count = F.lit(1) if weight is None else weight
    out = running_totals(df, value, {"n": count}, groups, cuts=cuts)
    return out.select(*groups, value, "n",
                      (F.col("n_before") + (F.col("n") + 1) / 2).alias("avg_rank"))


Position = Callable[[Column], Column]

# 0-based positions in ascending order, as functions of the group size
LOW_MIDDLE: Position = lambda n: F.floor((n - 1) / 2)
HIGH_MIDDLE: Position = lambda n: F.floor(n / 2)


def top_share(share: float) -> Position:
    """The value at descending index int(share * n)."""
    return lambda n: n - 1 - F.floor(n * share)


def order_statistics(df: DataFrame, value: str, positions: Mapping[str, Position],
                     groups: Sequence[str] = (), cuts: Sequence[float] | None = None,
                     one_pass: bool = False) -> DataFrame:
    """(groups, n, <name>...): the values at the asked positions, exact.

    First pass: row counts per range, combined map-side. Second pass: only rows
    of the ranges that hold an asked position are shuffled and ordered. With
    ``one_pass`` (an input that is costly to compute twice, or few distinct
    values) both work on one shared histogram of all values instead.
    """
    groups = list(groups)
    rows = df.where(F.col(value).isNotNull()).select(*groups, F.col(value).alias("_v"))
    if cuts is None:
        cuts = cut_points(rows, "_v")
    ranged = with_range(rows, "_v", cuts)
    part = Window.partitionBy(*groups) if groups else Window.partitionBy(F.lit(0))
    one_pass = one_pass or not cuts
    hist = ranged.groupBy(*groups, _RANGE, "_v").agg(F.count(F.lit(1)).alias("_c"))
    if one_pass:
        totals = hist.groupBy(*groups, _RANGE).agg(F.sum("_c").alias("_c"))
    else:
        totals = ranged.groupBy(*groups, _RANGE).agg(F.count(F.lit(1)).alias("_c"))
    placed = totals.select(
        *groups, _RANGE, "_c", F.sum("_c").over(part).alias("n"),
        F.coalesce(F.sum("_c").over(_before(groups, F.col(_RANGE))), F.lit(0)).alias("_start"))
    asked = F.array(*[F.struct(F.lit(name).alias("name"), pos(F.col("n")).cast("long").alias("at"))
                      for name, pos in positions.items()])
    wanted = (placed.select("*", F.explode(asked).alias("_p"))
              .where((F.col("_p.at") >= F.col("_start")) & (F.col("_p.at") < F.col("_start") + F.col("_c")))
              .select(*groups, _RANGE, "n", F.col("_p.name").alias("_name"),
                      (F.col("_p.at") - F.col("_start")).alias("_off")))
    # one row per (groups, range): the asked offsets as a short array
    per_range = (wanted.groupBy(*groups, _RANGE)
                 .agg(F.first("n").alias("n"),
                      F.collect_list(F.struct("_name", "_off")).alias("_asked")))
    if not one_pass:
        near = ranged.join(per_range.select(*groups, _RANGE), [*groups, _RANGE], "left_semi")
        hist = near.groupBy(*groups, _RANGE, "_v").agg(F.count(F.lit(1)).alias("_c"))
    ordered = hist.withColumn("_b", F.coalesce(
        F.sum("_c").over(_before([*groups, _RANGE], F.col("_v"))), F.lit(0)))
    hit = (ordered.join(per_range, [*groups, _RANGE], "inner")
           .select("*", F.explode("_asked").alias("_a"))
           .where((F.col("_a._off") >= F.col("_b")) & (F.col("_a._off") < F.col("_b") + F.col("_c"))))
    return hit.groupBy(*groups).agg(
        F.first("n").alias("n"),
        *[F.max(F.when(F.col("_a._name") == name, F.col("_v"))).alias(name) for name in positions])


def medians(df: DataFrame, value: str, groups: Sequence[str] = (), out: str = "median",
            cuts: Sequence[float] | None = None) -> DataFrame:
    """(groups, n, out): exact median, the mean of the two middle values."""
    found = order_statistics(df, value, {"_lo": LOW_MIDDLE, "_hi": HIGH_MIDDLE}, groups, cuts)
    return found.select(*groups, "n", ((F.col("_lo") + F.col("_hi")) / 2).alias(out))


def number_rows(df: DataFrame, order: str, groups: Sequence[str] = (), out: str = "number",
                cuts: Sequence[float] | None = None, ties: Sequence[str] = ()) -> DataFrame:
    """1-based consecutive numbers per group in the order of a key and then of ``ties``.

    Rows are written once in range partitions of all keys, see ``numbered``; ``cuts`` is not needed any more.
    """
    return numbered(df, [order, *ties], groups, out)
