"""Splits and balancing (I), change tracking and token diff (J)."""

from __future__ import annotations

from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import functions as F

from diffgauge.operators import changes as J, models as L, sampling as S, tokens as TK
from diffgauge.operators.neighbours import nearest_neighbours
from diffgauge.plans import roles as R
from diffgauge.plans.q_text import classified_sql, diff_xml
from diffgauge.plans.registry import query
from diffgauge.plans.roles import with_ctes
from diffgauge.sources.readers import table

# --- I: splits and balancing ------------------------------------------------------------


@query("I1_stratified_holdout", """
SELECT l_orderkey, l_returnflag, CASE WHEN r <= (n + 9) // 10 THEN 'test' ELSE 'train' END AS split FROM (
  SELECT l_orderkey, l_returnflag, count(*) OVER (PARTITION BY l_returnflag) AS n,
         row_number() OVER (PARTITION BY l_returnflag ORDER BY md5(l_orderkey || ':1000')) AS r
  FROM (SELECT DISTINCT l_orderkey, l_returnflag FROM lineitem))""")
def stratified(spark, d):
    rows = table(spark, d, "lineitem", ["l_orderkey", "l_returnflag"]).distinct()
    return S.holdout(rows, "l_returnflag", ["l_orderkey"]).select("l_orderkey", "l_returnflag", "split")


R.CTES["timed"] = ((), "SELECT o_orderkey AS seq, 'I' || (o_orderkey // 7) AS change_id FROM orders")


@query("I2_chronological_split", with_ctes("""
, edge AS (SELECT seq AS e FROM (SELECT seq, row_number() OVER (ORDER BY seq) AS r, count(*) OVER () AS n FROM timed) WHERE r = n // 5 + n * 3 // 5),
 cut AS (SELECT change_id FROM timed, edge GROUP BY change_id HAVING min(seq) <= max(e) AND max(seq) > max(e))
SELECT seq, change_id, CASE WHEN seq <= e OR change_id IN (SELECT change_id FROM cut) THEN 'train' ELSE 'test' END AS split FROM timed, edge""", "timed").replace("\n\n,", ",").replace("\n,", ","))
def chronological(spark, d):
    o = table(spark, d, "orders", ["o_orderkey"])
    rows = o.select(F.col("o_orderkey").alias("seq"), F.concat(F.lit("I"), F.floor(F.col("o_orderkey") / 7)).alias("change_id"))
    return S.chronological_split(rows, "seq", "change_id").select("seq", "change_id", "split")


@query("I3_undersample", """
SELECT o_orderkey, big FROM (
  SELECT o_orderkey, big, row_number() OVER (PARTITION BY big ORDER BY md5(o_orderkey || ':2')) AS r,
         count(*) FILTER (WHERE big) OVER () AS n1, count(*) FILTER (WHERE NOT big) OVER () AS n0
  FROM (SELECT o_orderkey, o_totalprice > 450000 AS big FROM orders))
WHERE big OR r <= floor(n1 / 0.5::DOUBLE)""")
def undersample(spark, d):
    o = table(spark, d, "orders", ["o_orderkey", "o_totalprice"]).select("o_orderkey", (F.col("o_totalprice") > 450000).alias("big"))
    return S.undersample(o, "big", ["o_orderkey"])


SMOTE_SQL = """
WITH few AS (SELECT vec_id AS base, embedding::DOUBLE[] AS x FROM embeddings WHERE label = 0),
 size AS (SELECT (SELECT count(*) FROM few) AS n1, (SELECT count(*) FROM embeddings WHERE label <> 0) AS n0),
 near AS (SELECT base, neighbour, nx, rank FROM (
   SELECT a.base, b.base AS neighbour, b.x AS nx, row_number() OVER (PARTITION BY a.base ORDER BY round(list_distance(a.x, b.x), 9), b.base) AS rank
   FROM few a JOIN few b ON a.base <> b.base) WHERE rank <= 10),
 dealt AS (SELECT base, x, n1, (n0 - n1) // n1 + CASE WHEN row_number() OVER (ORDER BY md5(base || ':2')) <= (n0 - n1) % n1 THEN 1 ELSE 0 END AS copies FROM few, size),
 copy AS (SELECT base, x, n1, CAST(unnest(range(1, copies + 1)) AS INTEGER) AS copy FROM dealt),
 pick AS (SELECT *, ('0x' || substr(md5(base || ':' || copy || ':2n'), 1, 8))::BIGINT % 10 + 1 AS rank,
                 ('0x' || substr(md5(base || ':' || copy || ':2u'), 1, 8))::BIGINT / 4294967296.0::DOUBLE AS u FROM copy)
SELECT base, copy, neighbour, round(u, 9) AS u,
  round(list_sum(list_transform(range(1, 65), lambda i: x[i] + u * (nx[i] - x[i]))), 6) AS total,
  round(list_sum(list_transform(range(1, 65), lambda i: (x[i] + u * (nx[i] - x[i])) * (x[i] + u * (nx[i] - x[i])))), 6) AS square
FROM pick JOIN near USING (base, rank)"""


@query("I4_smote", SMOTE_SQL)
def smote(spark, d):
    e = table(spark, d, "embeddings").select("vec_id", "embedding", (F.col("label") == 0).cast("int").alias("small"))
    new = S.smote(e, "small", "vec_id", "embedding", k=10, minority=1)
    add = lambda f: F.aggregate("features", F.lit(0.0), lambda a, v: a + f(v))
    return new.select("base", "copy", "neighbour", F.round("u", 9).alias("u"),
                      F.round(add(lambda v: v), 6).alias("total"), F.round(add(lambda v: v * v), 6).alias("square"))


@query("I4_undersample_then_smote", """
WITH few AS (SELECT vec_id AS base, embedding::DOUBLE[] AS x FROM embeddings WHERE label = 0),
 many AS (SELECT x FROM (SELECT embedding::DOUBLE[] AS x, row_number() OVER (ORDER BY md5(vec_id || ':2')) AS r FROM embeddings WHERE label <> 0)
          WHERE r <= 2 * (SELECT count(*) FROM few)),
 size AS (SELECT (SELECT count(*) FROM few) AS n1, (SELECT count(*) FROM many) AS n0, (SELECT least(100, count(*) - 1) FROM few) AS k),
 near AS (SELECT base, neighbour, nx, rank FROM (
   SELECT a.base, b.base AS neighbour, b.x AS nx, row_number() OVER (PARTITION BY a.base ORDER BY round(list_distance(a.x, b.x), 9), b.base) AS rank
   FROM few a JOIN few b ON a.base <> b.base), size WHERE rank <= k),
 dealt AS (SELECT base, x, k, (n0 - n1) // n1 + CASE WHEN row_number() OVER (ORDER BY md5(base || ':2')) <= (n0 - n1) % n1 THEN 1 ELSE 0 END AS copies FROM few, size),
 copy AS (SELECT base, x, k, CAST(unnest(range(1, copies + 1)) AS INTEGER) AS copy FROM dealt),
 pick AS (SELECT *, ('0x' || substr(md5(base || ':' || copy || ':2n'), 1, 8))::BIGINT % k + 1 AS rank,
                 ('0x' || substr(md5(base || ':' || copy || ':2u'), 1, 8))::BIGINT / 4294967296.0::DOUBLE AS u FROM copy),
 every AS (SELECT 0 AS label, x FROM many UNION ALL SELECT 1, x FROM few UNION ALL
           SELECT 1, list_transform(range(1, 65), lambda i: x[i] + u * (nx[i] - x[i])) FROM pick JOIN near USING (base, rank))
SELECT label, round(list_sum(x), 6) AS total, round(list_sum(list_transform(x, lambda v: v * v)), 6) AS square,
       round((SELECT count(*) FROM every)::DOUBLE / (2 * count(*) OVER (PARTITION BY label)), 9) AS weight FROM every""")
def undersample_then_smote(spark, d):
    """The balancing of the line model: the larger class cut to twice the smaller, SMOTE with 100 neighbours up to
    1:1, then balanced weights; one row per training row."""
    e = table(spark, d, "embeddings").select("vec_id", (F.col("label") == 0).cast("int").alias("label"),
                                             array_to_vector(F.col("embedding").cast("array<double>")).alias("features"))
    x = vector_to_array("features")
    add = lambda f: F.aggregate(x, F.lit(0.0), lambda a, v: a + f(v))
    return L.under_then_oversampled(e, "vec_id", k=100).select(
        "label", F.round(add(lambda v: v), 6).alias("total"), F.round(add(lambda v: v * v), 6).alias("square"),
        F.round("weight", 9).alias("weight"))


@query("I5_balanced_weights", """
SELECT o_orderstatus, n, round(t::DOUBLE / (3 * n), 9) AS weight FROM (
  SELECT o_orderstatus, count(*) AS n, sum(count(*)) OVER () AS t FROM orders GROUP BY o_orderstatus)""")
def balanced(spark, d):
    from diffgauge.operators.models import balanced_weights
    w = balanced_weights(table(spark, d, "orders", ["o_orderstatus"]), "o_orderstatus")
    return w.groupBy("o_orderstatus").agg(F.count(F.lit(1)).alias("n"), F.round(F.max("weight"), 9).alias("weight"))


@query("I6_k_nearest", """
SELECT query, CAST(rank AS INTEGER) AS rank, neighbour, round(distance, 6) AS distance FROM (
  SELECT a.vec_id AS query, b.vec_id AS neighbour, round(list_distance(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 9) AS distance,
         row_number() OVER (PARTITION BY a.vec_id ORDER BY round(list_distance(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 9), b.vec_id) AS rank
  FROM embeddings a JOIN embeddings b ON b.label < 5 AND a.label >= 5) WHERE rank <= 10""")
def k_nearest(spark, d):
    e = table(spark, d, "embeddings")
    return nearest_neighbours(e.where("label >= 5"), e.where("label < 5"), "vec_id", "embedding", 10).withColumn(
        "distance", F.round("distance", 6))


# --- J: change tracking and token diff -----------------------------------------------------

@query("J1_status_classification", classified_sql("""
SELECT row_id, CAST(label AS INTEGER) AS label, CAST(status AS INTEGER) AS status, outcome, count(*) AS n FROM result GROUP BY ALL"""))
def classification(spark, d):
    out = J.classify(R.review_raw(spark, d), R.review_diffs(spark, d))
    return out.groupBy("row_id", "label", "status", "outcome").agg(F.count(F.lit(1)).alias("n"))


@query("J2_rows_per_line", classified_sql("""
SELECT row_id, count(*) FILTER (WHERE outcome = 'ok') AS n_ok, count(*) AS n FROM result GROUP BY row_id"""))
def rows_per_line(spark, d):
    out = J.classify(R.review_raw(spark, d), R.review_diffs(spark, d))
    return out.groupBy("row_id").agg(F.count_if(F.col("outcome") == "ok").alias("n_ok"), F.count(F.lit(1)).alias("n"))


@query("J3_after_context", classified_sql("""
SELECT row_id, before_code, after_code FROM result WHERE status = 1"""))
def after_context(spark, d):
    out = J.classify(R.review_raw(spark, d), R.review_diffs(spark, d))
    return out.where("status = 1").select("row_id", "before_code", "after_code")


@query("J4_changed_tokens", with_ctes("SELECT row_id, token FROM changed_token", "changed_token"))
def changed_tokens(spark, d):
    return TK.changed_tokens(R.pairs(spark, d))


@query("J4_changed_tokens_set", with_ctes("""
SELECT DISTINCT row_id, regexp_replace(token, '[0-9]+', 'NUM', 'g') AS token FROM (
  SELECT row_id, unnest(regexp_extract_all(before_code, '([\\p{L}\\p{N}]+)', 1)) AS token FROM pair
  EXCEPT SELECT row_id, unnest(regexp_extract_all(after_code, '([\\p{L}\\p{N}]+)', 1)) FROM pair)""", "pair"))
def changed_tokens_set(spark, d):
    return TK.changed_tokens(R.pairs(spark, d), mode="set")


@query("J4_changed_tokens_lcs")
def changed_tokens_lcs(spark, d):
    return TK.changed_tokens(R.pairs(spark, d), mode="lcs")


@query("J5_xml_changed_tokens", with_ctes("""
SELECT DISTINCT row_id, regexp_replace(token, '[0-9]+', 'NUM', 'g') AS token
FROM (SELECT row_id, unnest(gone) AS token FROM xml_word WHERE NOT broken)
WHERE NOT regexp_matches(token, '[[:punct:]]')""", "xml_word"))
def xml_tokens(spark, d):
    return TK.xml_changed_tokens(diff_xml(spark, d))


@query("J5_broken_xml", with_ctes("SELECT row_id FROM xml_word WHERE broken", "xml_word"))
def broken(spark, d):
    return TK.broken_xml(diff_xml(spark, d)).select("row_id")


@query("J6_outcome_routing", with_ctes("""
SELECT row_id, k, n_common, n_suggested, n_changed, outcome, CASE WHEN outcome = 'too_short' THEN 'FN' ELSE outcome END AS published FROM routed""", "routed"))
def routing(spark, d):
    return R.routed(spark, d).select("row_id", "k", "n_common", F.col("n_suggested").cast("long").alias("n_suggested"),
                                     F.col("n_changed").cast("long").alias("n_changed"), "outcome",
                                     TK.published_outcome().alias("published"))
