"""Sparse rows, neighbours, SMOTE and forest explanations against plain restatements."""

import random

import duckdb
import numpy as np
import pandas as pd
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from diffgauge.operators import file_study as S
from diffgauge.operators import models as L
from diffgauge.operators.forest import Trees, explain_by_forest, forest_nodes, score_by_forest, tree_groups
from diffgauge.operators.numbering import numbered
from diffgauge.operators.sampling import smote, smote_sparse
from diffgauge.operators.sparse_neighbours import nearest_sparse, squared_distances
from diffgauge.operators.vocabulary import column_moments, with_vectors
from diffgauge.session import scratch_dir

SPARSE = "id long, label int, indices array<int>, values array<double>"


def sparse(spark, n, width, seed, copies=0, whole=True):
    rnd = random.Random(seed)
    rows = []
    for i in range(n):
        own = sorted(rnd.sample(range(width), rnd.randint(0, min(6, width))))
        rows.append((i, int(rnd.random() < 0.25), own, [float(rnd.randint(1, 9)) if whole else rnd.random() for _ in own]))
    rows += [(n + i, 1, [1, 2], [3.0, 4.0]) for i in range(copies)]
    return rows, spark.createDataFrame(rows, SPARSE).repartition(5)


def dense(row, width):
    x = np.zeros(width)
    x[row[2]] = row[3]
    return x


@pytest.mark.parametrize("groups", [(), ("g",)])
def test_numbers(spark, groups):
    """One value in all rows, or one group of most rows: numbers are gapless and follow the order."""
    df = spark.range(3000).select((F.col("id") % 50 == 0).cast("int").alias("g"), F.lit(7).alias("v"),
                                  F.expr("id * 7919 % 3000").alias("w")).repartition(6)
    for order in (["v"], ["v", "w"]):
        got = numbered(df, order, groups).collect()
        assert len(got) == 3000
        for g in ({r["g"] for r in got} if groups else [None]):
            own = sorted((r for r in got if g is None or r["g"] == g), key=lambda r: r["number"])
            assert [r["number"] for r in own] == list(range(1, len(own) + 1))
            if len(order) == 2:
                assert [r["w"] for r in own] == sorted(r["w"] for r in own)
    assert numbered(df.limit(0), ["v"], groups).count() == 0


def test_one_value_is_spread(spark):
    df = spark.range(20000).select(F.lit(1).alias("v"), "id").repartition(4)
    plan = df.repartitionByRange(4, "v", F.xxhash64("v", "id")).groupBy(F.spark_partition_id()).count()
    assert max(r["count"] for r in plan.collect()) < 7000


@settings(max_examples=60, deadline=None)
@given(st.lists(st.dictionaries(st.integers(0, 12), st.integers(-5, 5)), min_size=1, max_size=5),
       st.lists(st.dictionaries(st.integers(0, 12), st.integers(-5, 5)), min_size=1, max_size=5))
def test_distances(a, b):
    def split(rows):
        return [sorted(r) for r in rows], [[float(r[i]) for i in sorted(r)] for r in rows]
    def full(rows):
        return np.array([[r.get(i, 0) for i in range(13)] for r in rows], float)
    assert np.array_equal(squared_distances(split(a), split(b)), ((full(a)[:, None] - full(b)[None]) ** 2).sum(2))


@pytest.mark.parametrize("cells,copies", [(4, 0), (16, 60), (512, 5)])
def test_nearest_equals_brute_force(spark, cells, copies):
    """Cells small enough to prune, a large group of copies, self left out or not."""
    rows, df = sparse(spark, 120, 15, cells, copies)
    points = np.array([dense(r, 15) for r in rows])
    for alone in (False, True):
        want = []
        for i, x in enumerate(points):
            d = np.round(np.sqrt(((points - x) ** 2).sum(1)), 9)
            order = [j for j in np.argsort(d, kind="stable") if not (alone and j == i)][:3]
            want += [(i, rank + 1, int(j), d[j]) for rank, j in enumerate(order)]
        got = sorted(tuple(r) for r in nearest_sparse(df, df, "id", 3, alone, cell_rows=cells).collect())
        assert got == want


@pytest.mark.parametrize("held", [7, 40])
def test_long_rows_meet_in_slices(spark, monkeypatch, held):
    """Blocks bounded by the columns they hold give the neighbours of undivided ones, and no task sees a larger block."""
    from diffgauge.operators import sparse_neighbours as SN
    _, df = sparse(spark, 90, 15, 4, 10)
    want = sorted(tuple(r) for r in nearest_sparse(df, df, "id", 3, True, cell_rows=16).collect())
    monkeypatch.setattr(SN, "BLOCK_CELLS", held)
    real = SN._best

    def bounded(left, right, k, exclude_self):
        assert right["indices"].map(len).sum() <= held + 6
        return real(left, right, k, exclude_self)
    monkeypatch.setattr(SN, "_best", bounded)
    assert sorted(tuple(r) for r in nearest_sparse(df, df, "id", 3, True, cell_rows=16).collect()) == want


def test_bayes_on_sparse_rows_is_the_library_s(spark):
    _, train = sparse(spark, 80, 12, 5)
    _, test = sparse(spark, 40, 12, 6)
    test = test.unionByName(test.limit(3))          # keys may repeat
    s = S.Study("id", spark.createDataFrame([], "term string, df long, index int"), 12, train, test)
    want = L.scored(L.naive_bayes().fit(s.vectors(train)).transform(s.vectors(test)), "id").collect()
    got = S.predict("NB", s).collect()
    assert len(got) == len(want) == 43
    for a, b in zip(sorted(map(tuple, got)), sorted(map(tuple, want))):
        assert a[0] == b[0] and a[1] == b[1] and a[2] == pytest.approx(b[2], abs=1e-12) and a[3] == b[3]
    plan = S.naive_bayes(s)._jdf.queryExecution().toString()
    assert "summary" not in plan.lower()        # no vector of a class


def test_rows_of_one_key_keep_their_own_words(spark):
    files = spark.createDataFrame([(0, 1, "one two two", "train"), (1, 1, "two three", "train"), (0, 2, "one three", "train"),
                                   (1, 3, "one", "test"), (0, 4, "four", "train"), (0, 5, "five", "train"), (0, 6, "six", "train")],
                                  "label int, key int, text string, split string")
    for by_row, want in ((False, [[1.0, 1.0, 3.0]] * 2), (True, [[1.0, 1.0], [1.0, 2.0]])):
        s = S.study(files, "key", "text", by_row=by_row, min_df=1)
        assert sorted(r["values"] for r in s.train.where("key = 1").collect()) == want


def test_no_label_is_an_error(spark):
    from diffgauge.operators.sparse_trees import grow
    _, train = sparse(spark, 20, 8, 5)
    train = train.withColumn("label", F.when(F.col("id") != 3, F.col("label")))
    with pytest.raises(ValueError, match="null"):
        grow(train.drop("id"), 8, trees=2)
    with pytest.raises(ValueError, match="null"):
        S.naive_bayes(S.Study("id", train, 8, train, train))


def test_nearest_edges(spark):
    rows, df = sparse(spark, 5, 8, 1)
    assert nearest_sparse(df, df.limit(0), "id", 3).count() == 0
    assert nearest_sparse(df.limit(0), df, "id", 3).count() == 0
    assert nearest_sparse(df, df, "id", 9).count() == 25        # fewer rows than asked for


def test_sparse_smote_equals_dense(spark):
    _, df = sparse(spark, 60, 10, 3)
    wide = df.withColumn("x", F.expr("transform(sequence(0, 9), i -> coalesce(map_from_arrays(indices, values)[i], 0.0D))"))
    a = {(r["base"], r["copy"]): (r["neighbour"], r["features"]) for r in smote(wide, "label", "id", "x", 4).collect()}
    b = {(r["base"], r["copy"]): (r["neighbour"], dense((0, 0, r["indices"], r["values"]), 10))
         for r in smote_sparse(df, "label", "id", 4).collect()}
    assert a.keys() == b.keys() and len(a)
    for key in a:
        assert a[key][0] == b[key][0] and np.allclose(a[key][1], b[key][1])


@pytest.fixture(scope="module")
def forest(spark):
    rnd = random.Random(2)
    rows = []
    for i in range(300):
        own = sorted(rnd.sample(range(1, 40), rnd.randint(1, 8)))
        y = int(3 in own or (5 in own and 7 not in own))
        rows.append((i, y, [0, *own], [float(rnd.randint(1, 30)), *(float(rnd.randint(1, 4)) for _ in own)]))
    df = spark.createDataFrame(rows, SPARSE)
    model = L.random_forest(2, trees=15, depth=8).fit(with_vectors(df, 40))
    path = scratch_dir(spark)
    model.write().save(path)
    return rows, df, model, forest_nodes(spark, path)


def test_node_table_scores_like_the_model(spark, forest):
    rows, df, model, nodes = forest
    want = {r["id"]: r["p"] for r in model.transform(with_vectors(df, 40)).select(
        "id", vector_to_array("probability")[1].alias("p")).collect()}
    groups = tree_groups(nodes, 60)
    assert len(groups) > 2 and groups[0][0] == 0 and all(a[1] + 1 == b[0] for a, b in zip(groups, groups[1:]))
    for most in (60, 10 ** 6):
        got = {r["id"]: r["prob"] for r in score_by_forest(df, nodes, "id", most).collect()}
        assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-12 for k in want)


def test_explanations(spark, forest):
    """The columns that make a row positive carry the highest weights; groups of trees change nothing."""
    rows, df, model, nodes = forest
    moments = column_moments(df, len(rows))
    x = np.array([dense(r, 40) for r in rows])
    for r in moments.collect():
        assert r["mean"] == pytest.approx(x[:, r["index"]].mean()) and r["scale"] == pytest.approx(x[:, r["index"]].std())
    hits = df.where("label = 1 and array_contains(indices, 3)").limit(12)
    one = {(r["id"], r["index"]): r["score"] for r in explain_by_forest(hits, moments, nodes, "id", 800).collect()}
    many = {(r["id"], r["index"]): r["score"] for r in explain_by_forest(hits, moments, nodes, "id", 800, most=60).collect()}
    assert one.keys() == many.keys() and all(one[k] == pytest.approx(many[k], abs=1e-9) for k in one)
    best = {}
    for (i, index), s in one.items():
        best[i] = max(best.get(i, (0, None)), (s, index))
    assert np.mean([index == 3 for _, index in best.values()]) >= 0.8
    # the same regression in one piece, for one row
    rid = min(i for i, _ in one)
    own = sorted(index for i, index in one if i == rid)
    trees, stats = Trees.of(nodes.toPandas()), {r["index"]: (r["mean"], r["scale"]) for r in moments.collect()}
    mean, scale = (np.array([stats[i][k] for i in own]) for k in (0, 1))
    from diffgauge.functions import numbers as N
    from diffgauge.operators.forest import _draws
    seed = hits.where(F.col("id") == rid).select(N.digest_number(N.digest(["id"], 2))).first()[0]
    anchor = np.array([x[rid][i] for i in own])
    z = np.concatenate(list(_draws(int(seed), anchor, mean, scale, 800)))
    p = trees.votes(z, np.array(own)) / 15
    s = (z - mean) / scale
    w = np.sqrt(np.exp(-(((z - anchor) / scale) ** 2).sum(1) / (0.75 ** 2 * moments.count())))
    centre, level = (s * w[:, None]).sum(0) / w.sum(), (p * w).sum() / w.sum()
    c = s - centre
    slopes = np.linalg.solve(c.T @ (c * w[:, None]) + np.eye(len(own)), c.T @ (w * (p - level)))
    assert np.allclose(slopes, [one[rid, i] for i in own], atol=1e-8)


def test_changed_rows_mean_a_new_fit(spark, tmp_path):
    rows, df = sparse(spark, 40, 6, 9)
    fits = []

    def fit(train):
        def run():
            fits.append(1)
            from pyspark.ml import Pipeline
            return Pipeline(stages=[L.naive_bayes()]).fit(with_vectors(train, 6))
        return run
    name = ("en", "NB", 2, 5)
    a = S.catalogued(df, str(tmp_path), name, fit(df))
    assert S.catalogued(df.repartition(3), str(tmp_path), name, fit(df)) == a and len(fits) == 1
    other = df.withColumn("label", F.when(F.col("id") == 7, 1 - F.col("label")).otherwise(F.col("label")))
    assert S.catalogued(other, str(tmp_path), name, fit(other)) != a and len(fits) == 2
    assert S.catalogued(df.unionByName(df.limit(1)), str(tmp_path), name, fit(df)) != a and len(fits) == 3


def test_chain_on_stored_tables(spark):
    """From the forest's stored tables on, every stage equals its SQL."""
    from diffgauge.plans import q_chain, roles as R
    from diffgauge.plans.q_aggregates import COUNTS
    from diffgauge.plans.registry import load
    plans, _ = load()
    folder = "/root/testdata/sf0.001"
    stages = q_chain.forest_stages(spark, folder)
    con = duckdb.connect()
    for name in ("predictions", "weights", "tokens", "lines"):
        con.register(f"{name}_df", stages[name].toPandas())
    con.execute("create table token_score as select * from tokens_df")
    con.execute("create table line_score as select * from lines_df")
    # tokens: every distinct word of an explained line, with its file's weight or 0
    n_bad = con.execute("select count(*) from token_score t left join weights_df w on w.fileName = t.fileName and w.token = t.token "
                        "where abs(t.limeScore - coalesce(w.weight, 0)) > 1e-12").fetchone()[0]
    assert n_bad == 0
    hits = {r[0] for r in con.execute("select file_name from predictions_df where label = 1 and prediction = 1").fetchall()}
    assert {r[0] for r in con.execute("select distinct fileName from line_score").fetchall()} == hits
    assert plans["N1_top_k_sweep_of_forest"](spark, folder).count() == (6 if hits else 0)
    sql = R.with_ctes("SELECT * FROM topk_file", "topk_file")
    body = sql.split("line_best AS")[1]
    want = con.execute("WITH line_best AS" + body).df()
    from diffgauge.operators import sweep
    got = sweep.top_k_sweep_by_file(stages["lines"], stages["tokens"]).toPandas()
    key = ["dataset", "changeId", "fileName", "k"]
    cols = [*key, "tp", "fn", "fp", "tn"]
    a, b = (x[cols].sort_values(key).reset_index(drop=True).astype(str) for x in (got, want))
    pd.testing.assert_frame_equal(a, b)


def test_text_surrogate_of_a_forest(spark, forest):
    """The word whose column decides is the strongest; weights equal the same regression in one piece."""
    from diffgauge.operators.forest import _masks, explain_words_by_forest
    from diffgauge.functions import numbers as N
    rows, df, model, nodes = forest
    texts = [(1, [("Three", 3, 2.0), ("three", 3, 1.0), ("other", 9, 1.0), ("unknown", None, 1.0), ("zero", 0, 5.0)]),
             (2, [("five", 5, 1.0), ("ten", 10, 1.0), ("eleven", 11, 2.0)]), (3, [("unknown", None, 3.0)])]
    words = spark.createDataFrame([(i, *w) for i, ws in texts for w in ws], "row long, token string, index int, n double").repartition(3)
    got = {}
    for r in explain_words_by_forest(words, nodes, "row", samples=3000).collect():
        got.setdefault(r["row"], {})[r["token"]] = r["score"]
    again = {(r["row"], r["token"]): r["score"] for r in explain_words_by_forest(words, nodes, "row", samples=3000, most=60).collect()}
    assert all(again[i, t] == pytest.approx(v, abs=1e-9) for i, ws in got.items() for t, v in ws.items())
    assert set(got[1]) == {"Three", "three", "other", "unknown", "zero"} and abs(got[3]["unknown"]) < 1e-9
    assert max(got[2], key=got[2].get) == "five" and min(got[1]["Three"], got[1]["three"]) > got[1]["unknown"]
    trees = Trees.of(nodes.toPandas())
    own = sorted(texts[1][1])
    seed = int(spark.range(2, 3).select(F.col("id").alias("row")).select(N.digest_number(N.digest(["row"], 2))).first()[0])
    mask = np.concatenate(list(_masks(seed, 3, 3000)))
    p = trees.votes(mask * np.array([w[2] for w in own]), np.array([w[1] for w in own])) / 15 \
        if [w[1] for w in own] == sorted(w[1] for w in own) else None
    if p is None:       # columns in ascending order
        order = np.argsort([w[1] for w in own])
        p = trees.votes((mask * np.array([w[2] for w in own]))[:, order], np.array([w[1] for w in own])[order]) / 15
    w = np.sqrt(np.exp(-(((1 - np.sqrt(mask.sum(1) / 3)) * 100) ** 2) / 25.0 ** 2))
    c = mask - (mask * w[:, None]).sum(0) / w.sum()
    slopes = np.linalg.solve(c.T @ (c * w[:, None]) + np.eye(3), c.T @ (w * (p - (p * w).sum() / w.sum())))
    assert np.allclose(slopes, [got[2][w[0]] for w in own], atol=1e-8)


def test_text_chain_on_stored_tables(spark):
    """Routing and scores of the explained turns equal SQL over the stored suggestions and changed tokens."""
    from diffgauge.plans import q_chain
    from diffgauge.plans.registry import load
    folder = "/root/testdata/sf0.001"
    stages = q_chain.text_stages(spark, folder)
    con = duckdb.connect()
    for name in ("scores", "changed", "rows"):
        con.register(name, stages[name].toPandas())
    want = con.execute("""
      with suggestion as (select row_id, token, row_number() over (partition by row_id order by score desc, token) as rank from scores),
      hit as (select s.row_id, s.rank, count(c.token) as h from suggestion s left join changed c
              on c.row_id = s.row_id and contains(c.token, s.token) where s.rank <= 5 group by all),
      routed as (select r.row_id, k, n_tokens, y_pred,
          coalesce((select sum(h) from hit where hit.row_id = r.row_id and hit.rank <= k), 0)::bigint as n_common,
          (select count(*) from suggestion s where s.row_id = r.row_id and s.rank <= k) as n_suggested,
          (select count(*) from changed c where c.row_id = r.row_id) as n_changed from rows r, (select unnest([1, 3, 5]) as k))
      select row_id, k, n_common, n_suggested, n_changed,
        case when y_pred <> 1 then 'FN' when n_tokens < 7 then 'too_short' when n_common > 0 then 'positive' else 'negative' end as outcome
      from routed order by row_id, k""").fetchall()
    got = load()[0]["J6_routing_of_text_surrogate"](spark, folder).orderBy("row_id", "k").collect()
    assert [tuple(r) for r in got] == want and len(got)
    scores = {r["k"]: r for r in load()[0]["M7_token_scores_of_text_surrogate"](spark, folder).collect()}
    for k in (1, 3, 5):
        used = [r for r in want if r[1] == k and r[5] in ("positive", "negative")]
        assert scores[k]["common"] == sum(r[2] for r in used) and scores[k]["changed"] == sum(r[4] for r in used)


def test_regression_is_fitted_on_vectors_without_attributes(spark, monkeypatch):
    from pyspark.ml import Pipeline
    from diffgauge.operators import features as FT, models as L
    data = [(i % 2, f"word{i % 3} common other{i % 2} again" + " more" * (i % 4), float(i % 5)) for i in range(40)]
    train = spark.createDataFrame(data, "label int, code string, n double")
    stages, fitted = FT.feature_pipeline("code", ["n"]), []
    want = Pipeline(stages=[*stages.getStages(), L.logistic(len(data))]).fit(train)
    own = L.logistic

    def spied(*args, **options):
        lr = own(*args, **options)

        class Spy:
            def fit(self, df):
                fitted.append(df.schema["features"].metadata)
                return lr.fit(df)
        return Spy()
    monkeypatch.setattr(L, "logistic", spied)
    model = L.text_model(train, stages)
    assert fitted == [{}]
    a, b = (dict(zip([*m.stages[1].vocabulary, "n"], m.stages[-1].coefficients)) for m in (model, want))  # equal terms in any order
    assert a == pytest.approx(b, abs=1e-6)
    assert "ml_attr" not in FT.plain_vectors(stages.fit(train).transform(train)).schema["features"].metadata


def test_word_masks_take_off_the_smallest_draws():
    from diffgauge.operators.surrogate import word_masks
    for words in (1, 2, 7):
        mask, rng = word_masks(np.random.default_rng(3), words, 50), np.random.default_rng(3)
        off = rng.integers(1, words + 1, size=50)
        order = rng.random((50, words)).argsort(axis=1).argsort(axis=1)
        assert np.array_equal(mask, (order >= off[:, None]).astype(float))


def test_trees_walked_together_equal_one_by_one():
    from diffgauge.operators import forest
    rng = np.random.default_rng(5)
    cells = [(t, i, f, th, l, r, p) for t in range(9) for i, f, th, l, r, p in (
        (0, int(rng.integers(4)), float(rng.random()), 1, 2, .5), (1, -1, 0., -1, -1, float(rng.random())),
        (2, int(rng.integers(4)), float(rng.random()), 3, 4, .5), (3, -1, 0., -1, -1, float(rng.random())), (4, -1, 0., -1, -1, float(rng.random())))]
    cells.append((9, 0, -1, 0., -1, -1, 0.25))
    nodes = pd.DataFrame(cells, columns=["tree", "node", "feature", "threshold", "left", "right", "prob"])
    trees, x = forest.Trees.of(nodes), rng.random((30, 4))
    one = sum(forest.Trees.of(nodes[nodes["tree"] == t]).votes(x, np.arange(4)) for t in range(10))
    assert np.allclose(trees.votes(x, np.arange(4)), one)
    assert trees._walk(np.column_stack([x, np.zeros(30)]), np.array([*trees.features, 4])).shape == (10, 30)


def test_text_model_keeps_its_terms_in_a_table(spark, tmp_path, monkeypatch):
    """The saved regression equals the library's pipeline, loads with its own terms, and refuses null numbers."""
    from pyspark.ml import Pipeline
    from diffgauge.operators import features as FT, models as L
    data = [(i, i % 2, f"word{i % 3} common Other{i % 2} again" + " more" * (i % 4), i % 5) for i in range(40)] + [(3, 1, None, 2)]
    files = spark.createDataFrame(data, "file_name long, label int, code string, n int")      # a key repeats, a text is null
    bags = S.Bags.of(files, "code", ["n"])
    path = f"{tmp_path}/m"
    S.text_model(spark, path, bags)
    other = S.Bags.of(files.limit(5).withColumn("code", F.lit("nothing known")), "code", ["n"])
    model = S.text_model(spark, path, other)                # loaded, so these rows do not change it
    stages = FT.feature_pipeline("code", ["n"])
    known = files.fillna("", ["code"])
    want = Pipeline(stages=[*stages.getStages(), L.logistic(len(data))]).fit(known)
    assert {r["term"] for r in model.index.collect()} == set(want.stages[1].vocabulary)
    assert [type(x).__name__ for x in model.model.stages] == ["LogisticRegressionModel"]
    a, b = ([tuple(r) for r in L.scored(m, "file_name").orderBy("file_name", "prob").collect()]
            for m in (model.transform(bags), want.transform(known)))
    assert [(x[0], x[1], x[3]) for x in a] == [(x[0], x[1], x[3]) for x in b]
    assert [x[2] for x in a] == pytest.approx([x[2] for x in b], abs=1e-4)
    with pytest.raises(Exception, match="n must not be null"):
        S.text_model(spark, f"{tmp_path}/n", S.Bags.of(files.withColumn("n", F.lit(None).cast("int")), "code", ["n"]))
    from diffgauge.plans import q_features, q_text
    monkeypatch.setattr(L, "text_model", lambda *a: 1 / 0)      # neither query fits a stage that holds the terms
    for plan in (q_features.line_classifier, q_text.model_cache):
        assert plan(spark, "/root/testdata/sf0.001").count() > 0
