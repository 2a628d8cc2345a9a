"""Exact top k by inner product with multi-resolution segment statistics.

A vector is cut into segments; each keeps its mean and deviation. For two vectors the inner product over a
segment of length n is n * mean * mean' plus the product of the residuals, which by Cauchy-Schwarz is at most
n * dev * dev'. Summed up this bounds the inner product from above, and, with the norms, the distance from
below. Halving segments tightens the bound. Blocks of queries meet blocks of candidates; bounds run from
coarse to fine and only survivors are computed exactly.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BLOCK = 2048            # candidates measured together; up to twice as many where batches end inside a block
QUERY_BLOCK = 8192      # queries in a block
QUERY_ROWS = 1024       # queries measured together
DENSE = 0.05            # share of survivors from which on a block's product is computed as a whole
SPARE = 1e-9            # relative room for rounding in the bounds


def scaled(vector: Column, factor: float) -> Column:
    """Components floor(factor * x) as longs; null where a component is null or not finite."""
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x.cast("double")) == float("inf")))
    return F.when(vector.isNotNull() & ~bad, F.transform(vector, lambda x: F.floor(x.cast("double") * factor)))


def levels(dimension: int) -> list[int]:
    """Segment lengths from coarse to fine: the whole vector, then quarters of what was."""
    out = [max(dimension, 1)]
    while out[-1] > 8:
        out.append(-(-out[-1] // 4))
    return out


def statistics(vectors: np.ndarray, length: int) -> np.ndarray:
    """Per vector sqrt(n) * mean and sqrt(n) * deviation of each segment: products of these bound products."""
    n, d = vectors.shape
    out = []
    for at in range(0, d, length):
        part = vectors[:, at:at + length]
        mean = part.mean(1)
        out += [mean * np.sqrt(part.shape[1]), np.sqrt(((part - mean[:, None]) ** 2).sum(1))]
    return np.array(out).T if out else np.zeros((n, 0))


def best(queries: np.ndarray, ids: np.ndarray, vectors: np.ndarray, names: np.ndarray, k: int) -> list[tuple]:
    """The k best candidates of each query: (query, candidate, score); ties to the smaller candidate id.

    ``queries`` and ``vectors`` hold integers; scores are computed in float64 where that is exact (all
    partial sums below 2^53) and in Python's integers elsewhere.
    """
    if not len(ids) or not len(names):
        return []
    d = queries.shape[1]
    largest = [max((abs(int(x.max())), abs(int(x.min()))) if x.size else (0, 0)) for x in (queries, vectors)]
    exact = np.float64 if max(largest[0], 1) * max(largest[1], 1) * max(d, 1) < 2 ** 53 else object
    q, c = queries.astype(exact), vectors.astype(exact)
    qf, cf = queries.astype(float), vectors.astype(float)
    # seeds: the first candidates, scored exactly, give each query a score that k candidates reach
    seeds = min(len(names), 8 * k)
    first = np.where(names[None, :seeds] == ids[:, None], -np.inf, (q @ c[:seeds].T).astype(float))
    floor = np.sort(first, 1)[:, -k] if seeds >= k + 1 else np.full(len(ids), -np.inf)
    alive = None
    for length in levels(d):
        qs, cs = statistics(qf, length), statistics(cf, length)
        spare = SPARE * (np.linalg.norm(qs, axis=1)[:, None] * np.linalg.norm(cs, axis=1)[None, :] + 1)
        bound = qs @ cs.T + spare
        alive = bound >= floor[:, None] if alive is None else alive & (bound >= floor[:, None])
    alive &= names[None, :] != ids[:, None]
    full = None
    if exact is np.float64 and alive.mean() > DENSE:    # one product of the block is cheaper than a gather per query
        full = np.where(alive, q @ c.T, -np.inf)
        alive &= full >= np.partition(full, max(len(names) - k, 0), axis=1)[:, [max(len(names) - k, 0)]]
    out = []
    for i, own in enumerate(alive):
        at = np.flatnonzero(own)
        score = c[at] @ q[i] if full is None else full[i, at]
        for j in np.lexsort((names[at], -score))[:k]:
            out.append((int(ids[i]), int(names[at[j]]), int(score[j])))
    return out


def meetings(vectors: DataFrame, is_query: Column, factor: float = 256.0) -> DataFrame:
    """Rows (dim, q_block, group, candidate, id, v), one vector each; in a partition queries stand before the candidates they meet.

    A query goes to each group of candidates, a candidate to each block of queries. A row is one vector, so a batch
    that travels to Python is bounded by its number of rows.
    """
    rows = vectors.select(F.col("vec_id").cast("long").alias("id"), is_query.alias("q"),
                          scaled(F.col("embedding"), factor).alias("v")).where("id is not null and v is not null")
    rows = rows.withColumn("dim", F.size("v"))
    asked = rows.where("q").drop("q").dropDuplicates(["id", "v"])
    n_blocks = max(1, -(-asked.count() // QUERY_BLOCK))
    groups = max(1, min(int(vectors.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-rows.count() // BLOCK)))
    asked = asked.select("dim", F.pmod(F.xxhash64("id", "v"), F.lit(n_blocks)).alias("q_block"),
                         F.explode(F.sequence(F.lit(0), F.lit(groups - 1))).alias("group"), F.lit(False).alias("candidate"), "id", "v")
    met = rows.select("dim", F.explode(F.expr(f"sequence(0L, {n_blocks - 1}L)")).alias("q_block"),
                      F.pmod(F.xxhash64("id", "v"), F.lit(groups)).cast("int").alias("group"), F.lit(True).alias("candidate"), "id", "v")
    key = ["dim", "q_block", "group"]
    return asked.unionByName(met).repartition(*key).sortWithinPartitions(*key, "candidate")


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """((dim, q_block, group), candidate, ids, vectors) of equal keys that stand together."""
    for batch in batches:
        keys = np.stack([batch.column(c).cast(pa.int64()).to_numpy() for c in ("dim", "q_block", "group", "candidate")])
        ids, v = batch.column("id").to_numpy(), batch.column("v")
        at, flat = np.asarray(v.offsets), v.values.to_numpy(zero_copy_only=False)
        edges = [0, *(np.flatnonzero((keys[:, 1:] != keys[:, :-1]).any(0)) + 1).tolist(), batch.num_rows]
        for first, last in zip(edges, edges[1:]):
            if first < last:
                d, q_block, group, candidate = keys[:, first].tolist()
                yield (d, q_block, group), bool(candidate), ids[first:last], flat[at[first]:at[last]].reshape(last - first, d)


def top_k(vectors: DataFrame, is_query: Column, k: int, factor: float = 256.0) -> DataFrame:
    """For each query row its k highest inner products among all other ids of its dimension.

    Columns read: ``vec_id``, ``embedding``. Rows with a null id, a null vector or a null or non-finite
    component take no part; vectors meet only vectors of their own length. Candidates with the query's own id
    are left out; a query row that repeats is answered once, repeated candidates count each; query rows of one id
    with different vectors share one list, the k highest scores that any of them reaches. Result:
    ``query_id, rank, vec_id, score``. Every block of queries meets every group of candidates once, under one key of
    dimension, query block and group, so the meetings of one dimension spread over many keys; a task holds one block of
    queries and ``BLOCK`` candidates at a time and returns k rows per query and block of candidates.
    """
    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def met(held):
            ids, cands = (np.concatenate([h[i] for h in held]) for i in (0, 1))
            for q_ids, qs in queries:
                for at in range(0, len(q_ids), QUERY_ROWS):
                    found = best(qs[at:at + QUERY_ROWS], q_ids[at:at + QUERY_ROWS], cands, ids, k)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([f[c] for f in found], pa.int64()) for c in range(3)], ["query_id", "vec_id", "score"])

        now, queries, held, n = None, [], [], 0
        for key, candidate, ids, part in _runs(batches):
            if key != now:
                if held and queries:
                    yield from met(held)
                now, queries, held, n = key, [], [], 0
            if not candidate:
                queries = [tuple(np.concatenate(both) for both in zip(*queries, (ids, part)))]
                continue
            for at in range(0, len(ids), BLOCK):
                held.append((ids[at:at + BLOCK], part[at:at + BLOCK]))
                n += len(held[-1][0])
                if n >= BLOCK:
                    if queries:
                        yield from met(held)
                    held, n = [], 0
        if held and queries:
            yield from met(held)

    found = meetings(vectors, is_query, factor).mapInArrow(search, "query_id long, vec_id long, score long")
    ranks = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(ranks)).where(F.col("rank") <= k).select(
        "query_id", "rank", "vec_id", "score")
