import random

import pytest
from pyspark.sql import functions as F

from helpers import rows
from diffgauge.operators import tokens as T

PIECES = "row_id long, pos int, piece string, score double"


def test_merge_and_top(spark):
    p = spark.createDataFrame([(1, 0, "<s>", .9), (1, 1, "Ġre", .2), (1, 2, "turn", .4), (1, 3, "Ġtotal", .3), (1, 4, "</s>", .8)], PIECES)
    top = T.suggestions(T.clean_scores(T.merge_subwords(p)), 2)
    assert rows(top.select("rank", "token", "score")) == [(1, "return", .4), (2, "total", .3)]


def test_equal_tokens_last_score_first_place(spark):
    p = spark.createDataFrame([(1, 0, "Ġa", .9), (1, 1, "Ġb", .5), (1, 2, "Ġa", .5), (2, 0, "<s>", 1.)], PIECES)
    top = T.suggestions(T.clean_scores(T.merge_subwords(p)), 5)
    assert rows(top.select("row_id", "rank", "token")) == [(1, 1, "a"), (1, 2, "b")]
    assert T.clean_scores(T.merge_subwords(p), drop=["Ġb"]).where("token = 'b'").count() == 0


def test_punctuation_forces_a_break(spark):
    p = spark.createDataFrame([(1, 0, "a", 0.), (1, 1, ".", 0.), (1, 2, "b", 0.), (1, 3, "c", 0.), (1, 4, "Ġ", 0.), (1, 5, "_d", 0.)], PIECES)
    assert [r[1] for r in rows(T.break_after_punctuation(p).select("pos", "piece"))] == ["a", "Ġb", "c", "_d"]


PAIRS = [(1, "total = get_count(x2)", "total = get_size(x2)", {"count"}, ["count"], 1, "positive"),
         (2, "a = b", "a = b + c", set(), ["a"], 0, "negative"),
         (3, "log(err10)", "log(err)", {"errNUM"}, ["err"], 1, "positive"),
         (4, "f(ab, abc)", "f()", {"ab", "abc"}, ["ab"], 2, "positive")]


@pytest.mark.parametrize("mode", ["multiset", "set", "lcs"])
def test_changed_tokens_and_routing(spark, mode):
    pairs = spark.createDataFrame([(r[0], r[1], r[2], 9, 1) for r in PAIRS], "row_id long, before_code string, after_code string, n_tokens int, y_pred int")
    changed = T.changed_tokens(pairs, mode=mode)
    got = {}
    for r in changed.collect():
        got.setdefault(r["row_id"], set()).add(r["token"])
    assert got == {r[0]: r[3] for r in PAIRS if r[3]}
    best = spark.createDataFrame([(r[0], i + 1, t) for r in PAIRS for i, t in enumerate(r[4])], "row_id long, rank int, token string")
    routed = T.route_rows(pairs, best, changed, ns=[1])
    assert rows(routed.select("row_id", "n_common", "outcome")) == [(r[0], r[5], r[6]) for r in PAIRS]
    assert routed.where((F.col("outcome") == "positive") != (F.col("n_common") > 0)).count() == 0
    exact = T.route_rows(pairs, best, changed, ns=[1], match="exact")
    assert rows(exact.select("row_id", "n_common")) == [(1, 1), (2, 0), (3, 0), (4, 1)]


def test_outcomes_and_scopes(spark):
    table = spark.createDataFrame([(1, 9, 1, False), (2, 2, 1, False), (3, 9, 0, False), (4, 9, 1, True)],
                                  "row_id long, n_tokens int, y_pred int, bad boolean").withColumn("before_code", F.lit("x")).withColumn("after_code", F.lit("y"))
    best = spark.createDataFrame([(i, 1, "x") for i in (1, 2, 3, 4)], "row_id long, rank int, token string")
    changed = spark.createDataFrame([(1, "x"), (1, "q"), (2, "x")], "row_id long, token string")
    routed = T.route_rows(table, best, changed, ns=[1], more_than_n=7, failed="bad")
    assert [r[1] for r in rows(routed.select("row_id", "outcome"))] == ["positive", "too_short", "FN", "unknown"]
    every = T.token_scores_at_k(routed).first()
    used = T.token_scores_at_k(routed, "routed").first()
    assert (every["common"], every["changed"], every["suggested"], used["suggested"]) == (1, 2, 3, 1)
    assert every["recall"] == 0.5 and abs(every["precision"] - 1 / 3) < 1e-12


def test_published_ratios():
    # published recall/precision pairs are counts over 252 changed and 155 suggested tokens
    assert round(50 / 252, 3) == 0.198 and round(50 / 155, 3) == 0.323
    r, p = 50 / 252, 50 / 155
    assert round(2 * r * p / (r + p), 3) == 0.246


def test_lcs_deletions_against_dynamic_programming():
    rng = random.Random(5)
    for _ in range(60):
        x = [rng.choice("abcd") for _ in range(rng.randrange(12))]
        y = [rng.choice("abcd") for _ in range(rng.randrange(12))]
        best = [[0] * (len(y) + 1) for _ in range(len(x) + 1)]
        for i, a in enumerate(x):
            for j, b in enumerate(y):
                best[i + 1][j + 1] = best[i][j] + 1 if a == b else max(best[i][j + 1], best[i + 1][j])
        assert len(T.lcs_deletions(x, y)) == len(x) - best[-1][-1]


def test_partial_match_is_an_equi_join(spark):
    s = spark.createDataFrame([(1, 1, "a")], "row_id long, rank int, token string")
    c = spark.createDataFrame([(1, "ab")], "row_id long, token string")
    plan = T.partial_matches(s, c)._jdf.queryExecution().executedPlan().toString()
    assert "Cartesian" not in plan and "NestedLoop" not in plan


def test_xml_tokens(spark):
    xml = ('<unit xmlns:diff="urn:d"><diff:delete><name>old1</name><name>a.b</name><diff:common><name>kept</name>'
           '</diff:common></diff:delete></unit>')
    t = spark.createDataFrame([(1, xml), (2, "<unit><broken>")], "row_id long, xml string")
    assert rows(T.xml_changed_tokens(t)) == [(1, "oldNUM")]
    assert rows(T.broken_xml(t).select("row_id")) == [(2,)]


def test_words_of_few_pairs_are_held_at_once():
    import pyarrow as pa
    from diffgauge.operators import tokens as T
    n = 3 * T.LCS_ROWS + 1
    batch = pa.RecordBatch.from_arrays([pa.array(range(n), pa.int64()), pa.array([["a", "b"]] * n), pa.array([["b"], None] * (n // 2) + [["b"]])],
                                       names=["r", "x", "y"])
    out = list(T._lcs_deleted("r")(iter([batch])))
    assert [len(set(b["r"].to_pylist())) for b in out] == [T.LCS_ROWS] * 3 + [1]
    assert [t for b in out for t in b["token"].to_pylist()] == ["a", "a", "b"] * (n // 2) + ["a"]
