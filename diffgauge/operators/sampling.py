"""Reproducible splits and class balancing.

Randomness comes from a digest of key and seed, so the same rows are chosen in
every run, on every cluster layout and after every retry. Exact quotas are cut
by a histogram over the first digits of the digest: no class is sorted as a
whole, only the one digest range that the quota ends in.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from diffgauge.functions import numbers as N
from diffgauge.operators.joins import measured_lookup
from diffgauge.operators.neighbours import nearest_neighbours
from diffgauge.operators.ranks import order_statistics
from diffgauge.operators.sparse_neighbours import nearest_sparse
from diffgauge.session import materialize

DIGITS = 4
MAX_CLASSES = 1000          # where every class needs a number at the driver
FEW_CLASSES, BROADCAST_CLASSES = 32, 100_000


def class_counts(df: DataFrame, label: str) -> dict:
    """Rows per class; the label has few values by definition, which is checked."""
    rows = df.groupBy(label).count().limit(MAX_CLASSES + 1).collect()
    if len(rows) > MAX_CLASSES:
        raise ValueError(f"{label} is no class column: more than {MAX_CLASSES} values")
    return {r[0]: r[1] for r in rows}


Quota = Callable[[Column], Column]


def _quota_column(label: str, quotas: Mapping | Quota, size: Column) -> Column:
    if callable(quotas):
        return quotas(size)
    out = F.lit(0)
    for c, q in quotas.items():
        if c is not None:
            out = F.when(F.col(label) == F.lit(c), F.lit(q)).otherwise(out)
    return out


def take_by_digest(df: DataFrame, label: str, key: Sequence[str], quotas: Mapping | Quota, seed: int,
                   out: str = "taken") -> DataFrame:
    """Mark, per class, exactly ``quota`` rows: those with the smallest digests.

    ``quotas`` maps a class to its quota (none = 0) or computes it from the class
    size, and is cut to it; ``key`` identifies a row, and rows of one key on both sides of a quota are an error.
    The last digest taken is
    found in two scans: the first counts the ranges of digests, the second
    orders only the range the quota ends in. The cut digests are a table of one
    row per class: a few become an expression, any number is joined to the rows.
    """
    hashed = (df.withColumn("_digest", N.digest(key, seed))
              .withColumn("_head", N.digest_number("_digest", 1, DIGITS)))
    ranges = hashed.groupBy(label, "_head").agg(F.count(F.lit(1)).alias("_c"))
    whole = Window.partitionBy(label)
    before = whole.orderBy("_head").rowsBetween(Window.unboundedPreceding, -1)
    size = F.sum("_c").over(whole)
    placed = (ranges.withColumn("_start", F.coalesce(F.sum("_c").over(before), F.lit(0)))
              .withColumn("_q", F.least(_quota_column(label, quotas, size), size)))
    edges = placed.where((F.col("_start") < F.col("_q")) & (F.col("_q") <= F.col("_start") + F.col("_c"))).select(
        F.col(label).alias("_class"), F.col("_head").alias("_edge"), (F.col("_q") - F.col("_start")).alias("_left"))
    nth = F.row_number().over(Window.partitionBy("_class").orderBy("_digest", *key))
    cuts = materialize(
        hashed.join(_small(materialize(edges)), F.col(label).eqNullSafe(F.col("_class")) & (F.col("_head") == F.col("_edge")))
        .withColumn("_n", nth).withColumn("_last", F.max("_n").over(Window.partitionBy("_class", "_digest")))
        .where(F.col("_n") == F.col("_left")).select("_class", F.col("_digest").alias("_cut"), (F.col("_last") > F.col("_left")).alias("_over")))
    found = cuts.agg(F.count(F.lit(1)).alias("n"), F.max("_over").alias("over")).first()
    if found["over"]:
        raise ValueError(f"{list(key)} does not identify a row: rows of one key lie on both sides of a quota")
    digest, n_classes, cuts = N.digest(key, seed), found["n"], cuts.drop("_over")
    if n_classes <= FEW_CLASSES:        # the cuts are part of the expression: rows are marked where they lie
        cut = F.lit("")
        for r in cuts.collect():
            cut = F.when(F.col(label).eqNullSafe(F.lit(r["_class"])), F.lit(r["_cut"])).otherwise(cut)
        return df.withColumn(out, F.coalesce(digest <= cut, F.lit(False)))
    return (df.join(_small(cuts), F.col(label).eqNullSafe(F.col("_class")), "left")
            .withColumn(out, F.coalesce(digest <= F.col("_cut"), F.lit(False))).drop("_class", "_cut"))


def _small(classes: DataFrame) -> DataFrame:
    """A stored table of one row per class, with the broadcast hint if its counted rows are few."""
    return F.broadcast(classes) if classes.count() <= BROADCAST_CLASSES else classes


def holdout(df: DataFrame, label: str, key: Sequence[str], share_of_ten: int = 1,
            seed: int = 1000, out: str = "split") -> DataFrame:
    """Stratified hold-out: per class ceil(share/10 of n) rows are 'test'."""
    marked = take_by_digest(df, label, key, lambda n: F.ceil(n * share_of_ten / 10), seed)
    return marked.withColumn(out, F.when(F.col("taken"), "test").otherwise("train")).drop("taken")


def chronological_split(df: DataFrame, order: str, change: str, bias: int | None = None,
                        out: str = "split") -> DataFrame:
    """First int(.2 n) + int(.6 n) rows in time order are 'train'.

    The boundary moves to the end of the change it falls into, so that no change
    is cut. ``bias`` shifts the boundary by rows instead and leaves it there.
    """
    def boundary(n):
        at = F.floor(n / 5) + F.floor(n * 3 / 5) + F.lit(bias or 0) - 1
        return F.greatest(F.least(at, n - 1), F.lit(0))
    edge = order_statistics(df, order, {"edge": boundary}).select("edge").first()
    if edge is None:
        return df.withColumn(out, F.lit("train"))
    early = F.col(order) <= F.lit(edge["edge"])
    if bias is not None:
        return df.withColumn(out, F.when(early, "train").otherwise("test"))
    crossing = (df.groupBy(change).agg(F.min(order).alias("_lo"), F.max(order).alias("_hi"))
                .where((F.col("_lo") <= F.lit(edge["edge"])) & (F.col("_hi") > F.lit(edge["edge"])))
                .select(change, F.lit(True).alias("_cross")))
    return (measured_lookup(df, crossing, [change])
            .withColumn(out, F.when(early | F.col("_cross"), "train").otherwise("test"))
            .drop("_cross"))


def undersample(df: DataFrame, label: str, key: Sequence[str], ratio: float = 0.5,
                seed: int = 2) -> DataFrame:
    """Cut the larger class to minority / ratio rows; the smaller one stays whole."""
    counts = class_counts(df, label)
    small, large = min(counts.values()), max(counts, key=counts.get)
    quotas = dict(counts)
    quotas[large] = min(counts[large], int(small / ratio))
    return take_by_digest(df, label, key, quotas, seed).where("taken").drop("taken")


def smote_copies(few: DataFrame, label: str, count: Mapping, missing: int, seed: int) -> DataFrame:
    """(base, x, copy): ``missing`` copies dealt evenly over the rows of the smaller class, the remainder by digest.

    ``few``: its rows as (label, base, x); ``count``: the class and its number of rows.
    """
    (small, n), = count.items()
    share, rest = divmod(missing, n)
    dealt = take_by_digest(few, label, ["base"], {small: rest}, seed, "_extra")
    return (dealt.withColumn("_n", F.lit(share) + F.col("_extra").cast("int")).where("_n > 0")
            .select("base", "x", F.explode(F.sequence(F.lit(1), F.col("_n"))).alias("copy")))


def smote_sparse(df: DataFrame, label: str, key: str, k: int = 10, seed: int = 2, minority=None) -> DataFrame:
    """``smote`` on sparse rows: (base, copy, neighbour, u, indices, values), the same points as on dense ones.

    Neighbours come from ``nearest_sparse``; a new row has the columns of its two parents.
    """
    counts = class_counts(df, label)
    small = minority if minority is not None else min(counts, key=counts.get)
    missing = max(counts.values()) - counts[small]
    own = df.where(F.col(label) == F.lit(small))
    few = own.select(label, F.col(key).alias("base"), F.map_from_arrays("indices", "values").alias("x"))
    copies = smote_copies(few, label, {small: counts[small]}, missing, seed)
    k = max(min(k, counts[small] - 1), 0)
    if k == 0:
        pairs = copies.withColumn("neighbour", F.col("base")).withColumn("u", F.lit(0.0)).withColumn("_nx", F.col("x"))
    else:
        near = nearest_sparse(own, own, key, k, exclude_self=True)
        picked = copies.withColumn("rank", (N.digest_number(N.digest(["base", "copy"], seed, "n")) % k + 1).cast("int"))
        pairs = (picked.join(near.select(F.col("query").alias("base"), "rank", "neighbour"), ["base", "rank"])
                 .join(few.select(F.col("base").alias("neighbour"), F.col("x").alias("_nx")), "neighbour")
                 .withColumn("u", N.unit_hash(["base", "copy"], seed, "u")))
    zero = F.lit(0.0)
    mixed = F.map_zip_with("x", "_nx", lambda i, a, b: F.coalesce(a, zero) + F.col("u") * (F.coalesce(b, zero) - F.coalesce(a, zero)))
    return pairs.select("base", "copy", "neighbour", "u", F.array_sort(F.map_entries(mixed)).alias("_e")).select(
        "base", "copy", "neighbour", "u", F.col("_e.key").alias("indices"), F.col("_e.value").alias("values"))


def smote(df: DataFrame, label: str, key: str, features: str, k: int = 10, seed: int = 2,
          minority=None) -> DataFrame:
    """Synthetic minority rows that bring the two classes to 1:1.

    (base, copy, neighbour, u, features): ``x + u * (neighbour - x)``. The copies
    are dealt evenly over the minority rows, the remainder by digest. The
    neighbour of a copy and u come from digests of (base, copy).
    """
    counts = class_counts(df, label)
    small = minority if minority is not None else min(counts, key=counts.get)
    missing = max(counts.values()) - counts[small]
    few = df.where(F.col(label) == F.lit(small)).select(label, F.col(key).alias("base"),
                                                        F.col(features).cast("array<double>").alias("x"))
    copies = smote_copies(few, label, {small: counts[small]}, missing, seed)
    k = max(min(k, counts[small] - 1), 0)
    if k == 0:
        return (copies.withColumn("neighbour", F.col("base")).withColumn("u", F.lit(0.0))
                .select("base", "copy", "neighbour", "u", F.col("x").alias("features")))
    near = nearest_neighbours(few, few, "base", "x", k, exclude_self=True)
    picked = copies.withColumn("rank", (N.digest_number(N.digest(["base", "copy"], seed, "n")) % k + 1).cast("int"))
    points = few.select(F.col("base").alias("neighbour"), F.col("x").alias("_nx"))
    return (picked.join(near.select(F.col("query").alias("base"), "rank", "neighbour"), ["base", "rank"], "inner")
            .join(points, "neighbour", "inner")
            .withColumn("u", N.unit_hash(["base", "copy"], seed, "u"))
            .select("base", "copy", "neighbour", "u",
                    F.zip_with("x", "_nx", lambda a, b: a + F.col("u") * (b - a)).alias("features")))
