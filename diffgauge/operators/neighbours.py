"""Exact k nearest neighbours without a cross join.

Points go to their nearest pivot (a bounded list of rows chosen by digest). From
the pivot distances, the radii and the counts of the cells, the triangle
inequality tells which cells can hold a neighbour of which cell; a cell is met
only by those. Large cells are cut into blocks, so no task ever holds more than
two blocks, and a task returns only its k best per query, never the pairs.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F, types as T

from diffgauge.functions import numbers as N

DECIMALS = 9        # distances are compared after rounding, ties go to the smaller id
MAX_PIVOTS = 128
BLOCK_ROWS, LONG_BLOCK_ROWS = 2048, 8192        # every block that meets another receives it once; long ones suit short vectors
GROUPS = 128            # of reference rows, whose least values bound the k-th
UNPRUNED = 0.5          # share of the pairs of cells from which on the cells are given up
ROWS_AT_ONCE = 512      # queries of a block measured together


def _matrix(series) -> np.ndarray:
    return np.array([np.asarray(v, dtype=np.float64) for v in series])


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Euclidean distances between the rows of a and of b, from coordinate differences."""
    out = np.empty((len(a), len(b)))
    for j, row in enumerate(b):
        out[:, j] = np.sqrt(((a - row) ** 2).sum(1))
    return out


def k_nearest(a: np.ndarray, b: np.ndarray, k: int, barred: np.ndarray | None = None) -> list[tuple[np.ndarray, np.ndarray]]:
    """Per row of a the places and rounded distances of its k nearest rows of b; ties keep the earlier place.

    |b|^2 - 2ab, one matrix product, with the bound of its rounding error, only preselects; what can be among
    the k nearest is measured by coordinate differences, so far-off origins and near copies are told apart.
    """
    na, nb = (a * a).sum(1), (b * b).sum(1)
    error = (na + 2.0 * nb.max(initial=0.0)) * (8 * (a.shape[1] + 5) * np.finfo(float).eps) + 1e-300
    low = np.column_stack([-2.0 * a, np.ones(len(a))]) @ np.vstack([b.T, nb])
    if barred is not None:
        low[barred] = np.inf
    # the k-th smallest of the groups' least values is no less than the k-th smallest of all
    groups, k_here = min(len(b), max(GROUPS, k)), min(k, len(b))
    least = np.minimum.reduceat(low, np.linspace(0, len(b), groups, endpoint=False).astype(int), axis=1)
    upper = np.partition(least, k_here - 1, axis=1)[:, k_here - 1] + error + na
    # distances that round to the same number are ties
    limit = (np.sqrt(np.maximum(upper, 0.0)) + 10.0 ** -DECIMALS) ** 2 - na + 2 * error
    out = []
    for i, row in enumerate(a):
        at = np.flatnonzero(low[i] <= limit[i])
        at = at[np.isfinite(low[i, at])]
        d = np.round(np.sqrt(((b[at] - row) ** 2).sum(1)), DECIMALS)
        best = np.argsort(d, kind="stable")[:k]
        out.append((at[best], d[best]))
    return out


def _assign(points: DataFrame, key: str, vec: str, pivots: np.ndarray) -> DataFrame:
    key_type = points.schema[key].dataType
    # floats travel as floats and are widened where they are measured
    single = getattr(points.schema[vec].dataType, "elementType", None) == T.FloatType()
    kind = T.ArrayType(T.FloatType() if single else T.DoubleType())
    schema = T.StructType([T.StructField("id", key_type), T.StructField("v", kind),
                           T.StructField("cell", T.IntegerType()), T.StructField("far", T.DoubleType())])

    def nearest(batches):
        for batch in batches:
            if len(batch):
                d = distances(_matrix(batch["v"]), pivots)
                batch["cell"] = d.argmin(1).astype("int32")
                batch["far"] = d.min(1)
                yield batch
    return points.select(F.col(key).alias("id"), F.col(vec).cast(kind).alias("v")) \
        .mapInPandas(nearest, schema)


def _stats(cells: DataFrame) -> dict[int, tuple[int, float]]:
    """(rows, radius) per cell; at most MAX_PIVOTS rows."""
    return {r["cell"]: (r["n"], r["r"]) for r in
            cells.groupBy("cell").agg(F.count(F.lit(1)).alias("n"), F.max("far").alias("r")).collect()}


def _needed(pivots: np.ndarray, queries: dict, refs: dict, k: int) -> dict[int, list[int]]:
    """Per query cell the reference cells that may hold one of the k nearest."""
    between = distances(pivots, pivots)
    out = {}
    for i, (_, radius) in queries.items():
        upper = sorted((radius + between[i, j] + r, n) for j, (n, r) in refs.items())
        seen, bound = 0, float("inf")
        for u, n in upper:
            seen += n
            if seen >= k:
                bound = u
                break
        slack = 1e-6 * (1.0 + min(bound, 1e12))
        out[i] = [j for j, (_, r) in refs.items() if between[i, j] - radius - r <= bound + slack]
    return out


def nearest_neighbours(queries: DataFrame, refs: DataFrame, key: str, vec: str, k: int,
                       exclude_self: bool = False, pivots: int | None = None,
                       block_rows: int = BLOCK_ROWS, seed: int = 7) -> DataFrame:
    """(query, rank, neighbour, distance) with rank 1..k by (distance, id)."""
    n_refs = refs.count()
    if n_refs == 0 or k <= 0:
        t = refs.schema[key].dataType.simpleString()
        return queries.sparkSession.createDataFrame([], f"query {t}, rank int, neighbour {t}, distance double")
    pivots = min(MAX_PIVOTS, pivots or max(1, n_refs // min(BLOCK_ROWS, block_rows)))
    chosen = (refs.withColumn("_d", N.digest([key], seed)).orderBy("_d", key).limit(pivots)
              .select(F.col(vec).cast("array<double>").alias("v")).collect())
    centre = np.unique(np.array([r["v"] for r in chosen], dtype=np.float64), axis=0)
    q_cells, r_cells = _assign(queries, key, vec, centre), _assign(refs, key, vec, centre)
    q_stats, r_stats = _stats(q_cells), _stats(r_cells)
    need = _needed(centre, q_stats, r_stats, k + int(exclude_self))
    if len(r_stats) > 1 and sum(map(len, need.values())) > UNPRUNED * len(need) * len(r_stats):
        # nearly all cells meet: fewer, fuller blocks receive fewer copies of every row
        return nearest_neighbours(queries, refs, key, vec, k, exclude_self, 1, block_rows, seed)

    def blocks(stats, cell):
        return max(1, -(-stats[cell][0] // block_rows))

    # which cells meet, with their block counts: at most MAX_PIVOTS squared entries
    meets_ref = {i: [(j, blocks(r_stats, j)) for j in need[i]] for i in need}
    meets_query = {j: [(i, blocks(q_stats, i)) for i in need if j in need[i]] for j in r_stats}
    spark = queries.sparkSession

    def with_tiles(cells, stats, meets, own: str, other: str) -> DataFrame:
        """Send each point to every block of every cell its own cell meets."""
        plan = spark.createDataFrame(
            [(int(c), blocks(stats, c), [(int(x), int(n)) for x, n in to]) for c, to in meets.items()],
            "cell int, blocks int, meets array<struct<cell:int,blocks:int>>")
        at = cells.join(F.broadcast(plan), "cell").withColumn(
            "block", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
        met = at.select("id", "v", F.struct("cell", "block").alias(own), F.explode("meets").alias("m"))
        tile = met.select("id", "v", own, "m", F.explode(F.sequence(F.lit(0), F.col("m.blocks") - 1)).alias("n"))
        return tile.select("id", "v", own, F.struct(F.col("m.cell").alias("cell"), F.col("n").alias("block")).alias(other))
    q = with_tiles(q_cells, q_stats, meets_ref, "qb", "rb")
    r = with_tiles(r_cells, r_stats, meets_query, "rb", "qb")
    flat = [F.col("qb.cell").alias("qc"), F.col("qb.block").alias("qn"),
            F.col("rb.cell").alias("rc"), F.col("rb.block").alias("rn")]
    q, r = q.select("id", "v", *flat), r.select("id", "v", *flat)
    id_type = refs.schema[key].dataType.simpleString()

    def tile(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        empty = pd.DataFrame({"query": left["id"][:0], "neighbour": right["id"][:0], "distance": pd.Series(dtype=float)})
        if not len(left) or not len(right):
            return empty
        right = right.sort_values("id")
        ids = right["id"].to_numpy()
        own = left["id"].to_numpy()
        barred = own[:, None] == ids[None, :] if exclude_self else None     # ids ascend: ties keep the smaller
        a, b = _matrix(left["v"]), _matrix(right["v"])
        found = [x for i in range(0, len(a), ROWS_AT_ONCE)
                 for x in k_nearest(a[i:i + ROWS_AT_ONCE], b, k, None if barred is None else barred[i:i + ROWS_AT_ONCE])]
        return pd.DataFrame({"query": np.repeat(own, [len(at) for at, _ in found]),
                             "neighbour": ids[np.concatenate([at for at, _ in found])],
                             "distance": np.concatenate([d for _, d in found])})

    tile_keys = ["qc", "qn", "rc", "rn"]
    found = (q.groupBy(*tile_keys).cogroup(r.groupBy(*tile_keys))
             .applyInPandas(tile, f"query {id_type}, neighbour {id_type}, distance double"))
    order = Window.partitionBy("query").orderBy("distance", "neighbour")
    return (found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
            .select("query", "rank", "neighbour", "distance"))


def knn_vote(neighbours: DataFrame, labels: DataFrame, key: str, label: str) -> DataFrame:
    """(query, prob, prediction) by the mean label of the neighbours."""
    named = labels.select(F.col(key).alias("neighbour"), F.col(label).alias("_y"))
    vote = neighbours.join(named, "neighbour", "inner").groupBy("query").agg(
        F.avg(F.col("_y").cast("double")).alias("prob"))
    return vote.withColumn("prediction", (F.col("prob") > 0.5).cast("int"))
