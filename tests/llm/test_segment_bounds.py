"""Top k against brute force, and the bounds against the products they bound."""

import math

import numpy as np
from pyspark.sql import functions as F

from diffgauge.llm import topk


def brute(rows, k):
    good = [(i, [math.floor(256 * float(x)) for x in v]) for i, v in rows
            if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = set()
    for q in {(i, tuple(v)) for i, v in good if i % 5 == 0}:
        found = sorted((-sum(a * b for a, b in zip(q[1], v)), i) for i, v in good if i != q[0] and len(v) == len(q[1]))
        out |= {(q[0], r + 1, i, -s) for r, (s, i) in enumerate(found[:k])}
    return out


def test_bounds():
    rnd = np.random.default_rng(3)
    a, b = rnd.integers(-50, 50, (40, 37)), rnd.integers(-50, 50, (30, 37))
    last = None
    for length in topk.levels(37):
        bound = topk.statistics(a.astype(float), length) @ topk.statistics(b.astype(float), length).T
        assert (bound >= a @ b.T - 1e-6).all()
        assert last is None or bound.mean() <= last.mean()
        last = bound


def test_top_k(spark):
    rnd = np.random.default_rng(5)
    rows = [(i, [float(x) for x in rnd.choice([-1.0, -0.5, 0.1, 0.25, 1.0], 12)]) for i in range(300)]
    rows += [(300, None), (305, [1.0, None]), (310, [float("nan")] * 12), (315, [float("inf")] * 12), (None, [0.0] * 12),
             (320, [1.0, 2.0]), (321, [3.0, 1.0]), (325, []), (326, []), (330, [5e4] * 12), (331, [9e8, 1.0])]
    rows += [rows[7], rows[5]]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(7)
    df = df.withColumn("id", F.lit("clash")).withColumn("dim", F.lit("clash")).withColumn("score", F.lit(0))
    got = [tuple(r) for r in topk.top_k(df, F.col("vec_id") % 5 == 0, 4).collect()]
    assert set(got) == brute(rows, 4) and len(got) == len(set(got))
    assert topk.top_k(df.where("false"), F.col("vec_id") % 5 == 0, 4).count() == 0


def test_query_equals_sql(spark):
    from compare import compare, connect
    from diffgauge.llm.queries import ORACLES, QUERIES
    folder = "/root/testdata/sf0.001"
    for name, sql in ORACLES.items():
        text, ok, _ = compare(QUERIES[name], sql, spark, connect(folder), folder)
        assert ok, f"{name}: {text}"


def test_queries_of_one_id_share_a_list(spark):
    """Two vectors under one query id: the k best of both together; equal query rows change nothing."""
    rows = [(50, [1.0, 0.0]), (50, [0.0, 2.0]), (50, [0.0, 2.0])] + [(i, [i / 8, 1 - i / 8]) for i in range(1, 9)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(3)
    got = [(r["rank"], r["vec_id"], r["score"]) for r in topk.top_k(df, F.col("vec_id") % 50 == 0, 3).orderBy("rank").collect()]
    scale = lambda v: [int(256 * x // 1) for x in v]
    found = sorted(((sum(a * b for a, b in zip(scale(q), scale(v))), -i) for q in ([1.0, 0.0], [0.0, 2.0])
                    for i, v in rows if i != 50), reverse=True)[:3]
    assert got == [(n + 1, -i, s) for n, (s, i) in enumerate(found)]


def test_one_vector_a_row_and_dense_products(spark, monkeypatch):
    """What travels to Python is bounded by its rows; whole products and gathered ones give the same lists."""
    rnd = np.random.default_rng(9)
    rows = [(i, [float(x) for x in rnd.choice([-1.0, 0.5, 0.25], 8)]) for i in range(200)] + [(7, [0.5] * 8), (6, [0.5] * 8)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3)
    met = topk.meetings(df, F.col("vec_id") % 5 == 0)
    assert met.agg(F.max(F.size("v"))).first()[0] == 8 and met.where("candidate").count() == len(rows)
    monkeypatch.setattr(topk, "BLOCK", 16)
    assert {tuple(r) for r in topk.top_k(df, F.col("vec_id") % 5 == 0, 3).collect()} == brute(rows, 3)
    q, c = rnd.integers(-3, 3, (20, 6)), rnd.integers(-3, 3, (50, 6))
    ids, names = np.arange(20), rnd.integers(0, 40, 50)
    monkeypatch.setattr(topk, "DENSE", -1.0)
    whole = topk.best(q, ids, c, names, 4)
    monkeypatch.setattr(topk, "DENSE", 2.0)
    assert whole == topk.best(q, ids, c, names, 4)
