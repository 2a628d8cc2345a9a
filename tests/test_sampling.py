"""Splits, balancing, neighbours, skewed joins, surrogates, models."""

import inspect
import random

import numpy as np
import pytest
from pyspark.ml.functions import array_to_vector
from pyspark.ml.linalg import Vectors
from pyspark.sql import functions as F

from helpers import rows
from diffgauge.operators import joins, models as L, ngrams, sampling as S, surrogate
from diffgauge.operators.neighbours import nearest_neighbours
from diffgauge.operators.substrings import substring_pairs
from diffgauge.session import scratch_dir


def test_holdout_is_exact_and_stable(spark):
    t = spark.range(1003).select("id", (F.col("id") % 10 == 0).cast("int").alias("label"))
    one = S.holdout(t, "label", ["id"])
    got = {(r["label"], r["split"]): r["count"] for r in one.groupBy("label", "split").count().collect()}
    assert got == {(0, "test"): 91, (0, "train"): 811, (1, "test"): 11, (1, "train"): 90}
    again = S.holdout(t.repartition(7), "label", ["id"])
    assert rows(one.where("split='test'").select("id")) == rows(again.where("split='test'").select("id"))
    assert S.undersample(t, "label", ["id"]).groupBy("label").count().where("label = 0").first()["count"] == 202
    # marking rows must not move them
    assert "Exchange" not in one._jdf.queryExecution().executedPlan().toString().replace("RoundRobin", "")


def test_chronological_split_cuts_no_change(spark):
    t = spark.range(1000).select(F.col("id").alias("seq"), F.floor(F.col("id") / 7).alias("change"))
    out = S.chronological_split(t, "seq", "change")
    assert out.groupBy("change").agg(F.countDistinct("split").alias("n")).where("n > 1").count() == 0
    assert out.where("split = 'train'").count() == 805
    assert S.chronological_split(t, "seq", "change", bias=-4).where("split = 'train'").count() == 796


@pytest.mark.parametrize("pivots,block", [(1, 5000), (9, 16)])
def test_neighbours_equal_brute_force(spark, pivots, block):
    rng = np.random.default_rng(4)
    pts = np.round(np.concatenate([rng.normal(0, .1, (150, 3)), rng.normal(8, .1, (60, 3)), np.zeros((20, 3))]), 3)
    t = spark.createDataFrame([(i, [float(x) for x in p]) for i, p in enumerate(pts)], "id long, v array<double>")
    got = {}
    for r in nearest_neighbours(t, t, "id", "v", 4, exclude_self=True, pivots=pivots, block_rows=block).collect():
        got.setdefault(r["query"], {})[r["rank"]] = r["neighbour"]
    for i, p in enumerate(pts):
        d = np.round(np.sqrt(((pts - p) ** 2).sum(1)), 9)
        want = sorted((x, j) for j, x in enumerate(d) if j != i)[:4]
        have = [got[i][k] for k in (1, 2, 3, 4)]
        assert [round(float(d[j]), 6) for j in have] == [round(float(x), 6) for x, _ in want]


def test_smote_points_lie_between(spark):
    rng = np.random.default_rng(2)
    data = [(i, int(i < 12), [float(x) for x in rng.normal(size=3)]) for i in range(80)]
    t = spark.createDataFrame(data, "id long, y int, v array<double>")
    new = S.smote(t, "y", "id", "v", k=5).collect()
    assert len(new) == 68 - 12
    at = {i: np.array(v) for i, _, v in data}
    for r in new:
        assert r["base"] < 12 and r["neighbour"] < 12 and r["base"] != r["neighbour"] and 0 <= r["u"] < 1
        want = at[r["base"]] + r["u"] * (at[r["neighbour"]] - at[r["base"]])
        assert np.allclose(r["features"], want)
    per = [sum(r["base"] == i for r in new) for i in range(12)]
    assert max(per) - min(per) <= 1


def test_hot_keys_and_salted_lookup(spark):
    facts = spark.range(3000).select("id", F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id")).alias("k"))
    lookup = spark.range(0, 3000, 2).select(F.col("id").alias("k"), (F.col("id") * 2).alias("v"))
    hot = joins.hot_keys(facts, ["k"])
    assert spark.range(1).select(F.xxhash64(F.lit(0).cast("long")).alias("h")).first()["h"] in hot and len(hot) <= 100
    plain, salted = facts.join(lookup, "k", "left"), joins.salted_lookup(facts, lookup, ["k"], hot=hot, salts=7)
    assert rows(plain.select("id", "k", "v")) == rows(salted.select("id", "k", "v"))


def test_measured_lookup_broadcasts_only_below_its_bounds(spark):
    facts = spark.createDataFrame([(i, f"k{i % 7}" if i % 5 else None) for i in range(60)], "id long, k string")
    lookup = spark.createDataFrame([(f"k{i}", "v" * i) for i in range(0, 9, 2)], "k string, v string")
    want = rows(facts.join(lookup, "k", "left").select("id", "k", "v"))
    ways = {"small": {}, "many rows": {"most_rows": 4}, "wide rows": {"most_bytes": 25}}
    for name, bounds in ways.items():
        df = joins.measured_lookup(facts, lookup, ["k"], **bounds)
        assert rows(df.select("id", "k", "v")) == want
        assert ("BroadcastHashJoin" in df._jdf.queryExecution().sparkPlan().toString()) == (name == "small")
    assert joins.is_small(lookup, 5, 30) and not joins.is_small(lookup, 5, 29)      # 10 bytes of keys, 20 of values
    assert joins.is_small(spark.range(0), 0, 0) and joins.is_small(lookup.where("k is null"))
    semi = joins.measured_lookup(facts, lookup.select("k"), ["k"], "left_semi")
    assert rows(semi) == rows(facts.join(lookup, "k", "left_semi"))


def test_adaptive_execution_splits_a_hot_join_key(spark):
    names = ["spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes", "spark.sql.adaptive.advisoryPartitionSizeInBytes",
             "spark.sql.adaptive.autoBroadcastJoinThreshold", "spark.sql.adaptive.maxShuffledHashJoinLocalMapThreshold",
             "spark.sql.adaptive.skewJoin.skewedPartitionFactor"]
    old = {n: spark.conf.get(n) for n in names}
    try:
        for n, v in zip(names, ("20KB", "20KB", "-1", "0", "2")):
            spark.conf.set(n, v)
        facts = spark.range(0, 40000, 1, 8).select(F.col("id"), F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id")).alias("k"),
                                                        F.sha2(F.col("id").cast("string"), 256).alias("payload"))
        lookup = spark.range(0, 40000, 1, 8).select(F.col("id").alias("k"), F.lit(1).alias("v"))
        df = joins.salted_lookup(facts, lookup, ["k"]).groupBy("k").agg(F.sum("v").alias("n"), F.max("payload").alias("p"))
        assert df.where("k = 0").first()["n"] == 13334
        df.collect()
        assert "skew=true" in df._jdf.queryExecution().executedPlan().toString()
    finally:
        for n, v in old.items():
            spark.conf.set(n, v)


def test_substring_pairs_against_brute_force(spark):
    rng = np.random.default_rng(8)
    text = lambda n: "".join(rng.choice(list("ab c"), n))
    texts = [("hot" if i % 3 else f"g{i % 4}", i, text(int(rng.integers(0, 90)))) for i in range(120)]
    needles = [("hot" if i % 2 else f"g{i % 4}", i, text(int(rng.integers(0, 9)))) for i in range(60)]
    needles += [(g, 1000 + i, t[3:3 + n]) for i, (g, _, t) in enumerate(texts) for n in (40,) if len(t) > 50]
    n = spark.createDataFrame(needles, "g string, n_id long, n string")
    t = spark.createDataFrame(texts, "g string, t_id long, t string")
    got = set(rows(substring_pairs(n, t, ["g"], "n_id", "n", "t_id", "t")))
    assert got == {(i, j) for g, i, x in needles for h, j, y in texts if g == h and x and x in y}


def test_blocks_measured_in_slices_give_the_nearest_of_floats(spark, monkeypatch):
    """Float vectors travel as floats; a block's queries are measured a few at a time; ids at one place tie by id."""
    from diffgauge.operators import neighbours as NB
    from pyspark.sql import types as T
    monkeypatch.setattr(NB, "ROWS_AT_ONCE", 3)
    rng = np.random.default_rng(3)
    x = rng.standard_normal((40, 5)).astype("float32")
    x[7] = x[3]
    t = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, v array<float>")
    assert NB._assign(t, "id", "v", x[:2].astype(float)).schema["v"].dataType == T.ArrayType(T.FloatType())
    wide = x.astype(float)
    d = np.round(np.sqrt(((wide[:, None] - wide[None]) ** 2).sum(2)), NB.DECIMALS)
    np.fill_diagonal(d, np.inf)
    got = {(r["query"], r["rank"]): (r["neighbour"], r["distance"]) for r in nearest_neighbours(
        t, t, "id", "v", 3, exclude_self=True, block_rows=NB.LONG_BLOCK_ROWS).collect()}
    for i in range(len(x)):
        best = sorted((d[i, j], j) for j in range(len(x)) if j != i)[:3]
        assert [got[i, r + 1][0] for r in range(3)] == [j for _, j in best]
        assert [got[i, r + 1][1] for r in range(3)] == pytest.approx([v for v, _ in best], abs=1e-8)


def test_tail_of_a_vector_without_the_rest(spark):
    """The last columns of sparse vectors, without a dense vector of all columns on the way."""
    from diffgauge.operators import features as FT
    rows_of = [(1, Vectors.sparse(100_000, [5, 99_998], [2.0, 7.0])), (2, Vectors.sparse(100_000, [], []))]
    out = FT.with_tail(spark.createDataFrame(rows_of, ["id", "features"]), 3)
    assert {r["id"]: r[FT.TAIL].toArray().tolist() for r in out.collect()} == {1: [0.0, 7.0, 0.0], 2: [0.0, 0.0, 0.0]}


def test_only_asked_sequences_are_counted(spark):
    """The counts of wanted n-grams are those of all n-grams; other sequences and contexts are not counted at all."""
    train = spark.createDataFrame([("a b c a b",), ("a c <s> b",), ("x y z",), ("",), (None,)], "text string")
    wanted = ngrams.exploded_grams(spark.createDataFrame([("a b q",), ("b",)], "text string"), "text", 3).select("g").distinct()
    whole = {(r["kind"], r["gram"]): r["c"] for r in ngrams.gram_counts(train, "text", 3).collect()}
    got = {(r["kind"], r["gram"]): r["c"] for r in ngrams.asked_counts(train, "text", 3, wanted).collect()}
    asked = {(r["kind"], r["gram"]) for r in wanted.select(F.explode(F.array(*ngrams.gram_parts(3))).alias("p")).select("p.*").collect()}
    assert got == {k: c for k, c in whole.items() if k in asked or k[0] == "g" and " " not in k[1]}
    assert ("g", "x y") not in got and got["g", "x"] == 1 and got["g", "a b"] == 2


def test_line_entropy_by_hand(spark):
    train = spark.createDataFrame([("a b",), ("a c",)], "text string")
    test = spark.createDataFrame([(1, "a b"), (2, "a b"), (3, "z"), (4, " ")], "line_id long, text string")
    got = {r["line_id"]: r["entropy"] for r in ngrams.line_entropy(train, test, order=2).collect()}
    p0 = 1 / 4                                         # three words and the unknown one
    a = .5 * 1.0 + .5 * (.5 * 2 / 4 + .5 * p0)          # after the start mark
    b = .5 * .5 + .5 * (.5 * 1 / 4 + .5 * p0)           # after "a"
    z = .5 * 0.0 + .5 * (.5 * 0 + .5 * p0)
    assert got[1] == got[2] == pytest.approx((-np.log2(a) - np.log2(b)) / 2)
    assert got[3] == pytest.approx(-np.log2(z)) and got[4] is None


def test_text_surrogate_finds_the_words(spark):
    words = spark.createDataFrame([(1, "good", 2.0), (1, "bad", -2.0), (1, "dull", 0.0)], "row_id long, token string, effect double")
    got = {r["token"]: r["score"] for r in surrogate.explain_text(words, "row_id", 0.0, samples=3000).collect()}
    assert got["good"] > .1 > abs(got["dull"]) and got["bad"] < -.1
    top = surrogate.explain_text(words, "row_id", 0.0, samples=3000, features=1).collect()
    assert len(top) == 1 and top[0]["token"] in ("good", "bad")


def test_ridge_solution():
    rng = np.random.default_rng(0)
    x, w = rng.normal(size=(400, 3)), rng.random(400)
    y = 1.5 + x @ [2.0, -1.0, 0.0]
    full = np.column_stack([np.ones(400), x])
    beta = surrogate.solve_ridge(full.T @ (full * w[:, None]), full.T @ (w * y), 1e-9)
    assert np.allclose(beta, [2.0, -1.0, 0.0])


def test_row_surrogate_and_models(spark):
    rng = np.random.default_rng(1)
    data = [(i, [float(a), float(b), float(c)], int(a > 0)) for i, (a, b, c) in enumerate(rng.normal(size=(300, 3)))]
    t = spark.createDataFrame(data, "id long, x array<double>, label int").withColumn("features", array_to_vector("x"))
    model = L.logistic(300).fit(t)
    got = {}
    for r in surrogate.explain_rows(t.where("id < 5"), "id", "x", model, np.zeros(3), np.ones(3), samples=800).collect():
        got.setdefault(r["id"], {})[r["feature"]] = r["score"]
    assert len(got) == 5 and all(v[0] > 5 * abs(v[1]) and v[0] > 5 * abs(v[2]) for v in got.values())
    metrics = L.compare(t.where("id < 200"), t.where("id >= 200"), "id", "demo", ["LG", "KNN", "DT", "Random Guessing"])
    table = {(r["Technique"], r["Measure"]): r["Value"] for r in metrics.collect()}
    assert len(table) == 4 * 9
    assert table["LG", "AUC"] > .95 and table["KNN", "F1 measure"] > .8 and .3 < table["Random Guessing", "AUC"] < .7
    for name in ("LG", "KNN", "DT", "Random Guessing"):
        assert sum(table[name, m] for m in ("true positive", "true negative", "false positive", "false negative")) == 100


def test_balancing_recipes(spark):
    rng = np.random.default_rng(6)
    t = spark.createDataFrame([(i, [float(x) for x in rng.normal(size=2)], int(i < 10)) for i in range(100)],
                              "id long, x array<double>, label int").withColumn("features", array_to_vector("x"))
    both = L.oversampled(t, "id", k=5).groupBy("label").count().collect()
    assert {r["label"]: r["count"] for r in both} == {0: 90, 1: 90}
    second = L.under_then_oversampled(t, "id", k=100).groupBy("label").agg(F.count("*").alias("n"), F.max("weight").alias("w")).collect()
    assert {r["label"]: (r["n"], r["w"]) for r in second} == {0: (20, 1.0), 1: (20, 1.0)}


def test_fit_or_load_fits_once(spark):
    from pyspark.ml import Pipeline
    t = spark.createDataFrame([([float(i)], i % 2) for i in range(20)], "x array<double>, label int").withColumn("features", array_to_vector("x"))
    calls = []

    def fit():
        calls.append(1)
        return Pipeline(stages=[L.naive_bayes()]).fit(t)
    path = scratch_dir(spark) + "/nb-demo-2-5"
    a = L.fit_or_load(spark, path, fit).transform(t).select("prediction").collect()
    b = L.fit_or_load(spark, path, fit).transform(t).select("prediction").collect()
    assert a == b and len(calls) == 1


def test_neighbours_far_from_the_origin_and_near_copies(spark):
    from diffgauge.operators.neighbours import nearest_neighbours
    for centre, step in ((1e3, 1e-5), (1e6, 1e-2), (0.0, 1.0)):
        data = [(i, [centre + step * i] + [centre] * 7) for i in range(12)]
        df = spark.createDataFrame(data, "id long, v array<double>")
        got = {}
        for r in nearest_neighbours(df, df, "id", "v", 2, exclude_self=True, pivots=3, block_rows=4).collect():
            got.setdefault(r["query"], {})[r["rank"]] = r["neighbour"]
        assert all(got[i] == {1: i - 1, 2: i + 1} for i in range(1, 11)), centre


def test_hold_out_of_many_classes_and_large_quotas(spark):
    from diffgauge.operators.sampling import holdout, take_by_digest
    df = spark.range(6000).selectExpr("id", "id % 1500 as label")
    split = holdout(df, "label", ["id"])
    assert split.where("split = 'test'").select("label").distinct().count() == 1500
    assert split.where("split = 'test'").count() == 1500 and split.count() == 6000
    taken = take_by_digest(df.where("label < 3"), "label", ["id"], {0: 100, 1: 2}, 5)
    assert {r["label"]: r["n"] for r in taken.where("taken").groupBy("label").agg({"*": "count"}).toDF("label", "n").collect()} == {0: 4, 1: 2}


def test_forest_grows_as_deep_as_the_tree(spark):
    """Labels at random need a split for almost each row: no tree may stop early."""
    rnd = random.Random(5)
    t = spark.createDataFrame([(float(rnd.random() < 0.5), Vectors.dense([rnd.random() for _ in range(4)])) for _ in range(1500)],
                              ["label", "features"])
    trees = L.random_forest(2, trees=3).fit(t).trees
    assert min(tree.depth for tree in trees) > 10
    assert inspect.signature(L.predict).parameters["depth"].default == L.random_forest(2).getMaxDepth() == 30


def test_evaluation_orders_probabilities_by_ranges(spark, monkeypatch):
    """The probabilities of one technique are cut into ranges; the area equals the count of ordered pairs."""
    cuts, real = [], L.roc_auc
    monkeypatch.setattr(L, "roc_auc", lambda *a, **k: (cuts.append(k["cuts"]), real(*a, **k))[1])
    rnd = random.Random(1)
    scores = [(i % 2, p) for i, p in enumerate([0.0, 1.0, 0.5, 0.5, *(rnd.random() for _ in range(196))])]
    t = spark.createDataFrame([("a", "b", y, p, int(p > 0.5)) for y, p in scores],
                              "Technique string, Datasets string, label int, prob double, prediction int")
    got = [r for r in L.evaluate(t).collect() if "auc" in map(str, [str(x).lower() for x in r])]
    pairs = [(p > q) + (p == q) / 2 for y, p in scores for z, q in scores if y == 1 and z == 0]
    assert len(cuts[0]) > 1 and len(got) == 1
    assert any(isinstance(x, float) and abs(x - sum(pairs) / len(pairs)) < 1e-9 for x in got[0])


def test_a_repeated_key_cannot_break_a_quota(spark):
    """105 rows, 7 to a key, quota 11: no set of whole keys has 11 rows, so the hold-out refuses."""
    df = spark.createDataFrame([(i // 7, 1) for i in range(105)], "k long, label int")
    with pytest.raises(ValueError, match="does not identify a row"):
        S.holdout(df, "label", ["k"])
    unique = df.withColumn("id", F.monotonically_increasing_id())
    assert S.holdout(unique, "label", ["k", "id"]).where("split = 'test'").count() == 11
