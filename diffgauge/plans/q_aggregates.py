"""Aggregations (E) and ordered operators (F)."""

from __future__ import annotations

from pyspark.sql import functions as F

from diffgauge.functions import text as X
from diffgauge.operators import attribution as K, confusion as C, sweep
from diffgauge.operators.curves import curve_points
from diffgauge.operators.ranks import (HIGH_MIDDLE, average_ranks, medians, number_rows,
                                       order_statistics, top_share)
from diffgauge.operators.sampling import chronological_split
from diffgauge.operators.stats import box_summary, mode_first
from diffgauge.operators.tokens import clean_scores, merge_subwords, suggestions
from diffgauge.operators.epochs import early_stopping
from diffgauge.operators.topk import arg_min as first_by, top_with_ties
from diffgauge.plans import roles as R
from diffgauge.plans.q_joins import (COMMENTED, hit_lines, hits_by_line, labelled_lines,
                                     top_tokens, train_files)
from diffgauge.plans.registry import query
from diffgauge.plans.roles import FILE, with_ctes
from diffgauge.sources.readers import table

COUNTS = """
  count(*) FILTER (WHERE groundTruth = 1 AND ngramScore > {0}) AS tp,
  count(*) FILTER (WHERE groundTruth = 1 AND NOT ngramScore > {0}) AS fn,
  count(*) FILTER (WHERE groundTruth = 0 AND ngramScore > {0}) AS fp,
  count(*) FILTER (WHERE groundTruth = 0 AND NOT ngramScore > {0}) AS tn"""


@query("E1_confusion_by_file", with_ctes(
    f"SELECT dataset, changeId, fileName, {COUNTS.format('1.5::DOUBLE')} FROM item_line GROUP BY ALL", "item_line"))
def confusion_by_file(spark, d):
    return C.confusion(R.item_lines(spark, d), F.col("groundTruth") == 1, F.col("ngramScore") > 1.5, FILE)


@query("E2_confusion_matrix", with_ctes("""
SELECT count(*) FILTER (WHERE label = 1 AND prob > 0.5) AS tp, count(*) FILTER (WHERE label = 1 AND prob <= 0.5) AS fn,
       count(*) FILTER (WHERE label = 0 AND prob > 0.5) AS fp, count(*) FILTER (WHERE label = 0 AND prob <= 0.5) AS tn FROM prediction""", "prediction"))
def confusion_matrix(spark, d):
    return C.confusion(R.predictions(spark, d), F.col("label") == 1, F.col("prob") > 0.5)


@query("E3_group_counts", with_ctes("""
SELECT dataset, changeId, fileName, CAST(sum(groundTruth) AS BIGINT) AS total_true, count(*) AS total_line FROM item_line GROUP BY ALL""", "item_line"))
def group_counts(spark, d):
    return R.item_lines(spark, d).groupBy(*FILE).agg(F.sum("groundTruth").alias("total_true"), F.count(F.lit(1)).alias("total_line"))


@query("E4_top_tokens_per_line", with_ctes("SELECT fileName, lineNumber, numTopK FROM line_hit", "line_hit"))
def top_per_line(spark, d):
    return hits_by_line(spark, d).select("fileName", "lineNumber", "numTopK")


LENGTHS = f"""
SELECT length, count(*)::DOUBLE / (SELECT count(*) FROM ({COMMENTED})) AS length_score
FROM (SELECT CAST(len({R.words_sql('code')}) AS INTEGER) AS length FROM ({COMMENTED})) GROUP BY length"""


@query("E5_length_distribution", with_ctes(
    f"SELECT length, round(length_score, 9) AS length_score FROM ({LENGTHS})", "labelled_line", "train_file"))
def length_distribution(spark, d):
    lines = K.commented_lines(labelled_lines(spark, d), train_files(spark, d))
    return K.length_distribution(lines).withColumn("length_score", F.round("length_score", 9))


@query("E6_mean_variance", with_ctes("""
SELECT dataset, round(avg(size), 6) AS mean, round(var_pop(size), 6) AS pvariance, round(avg(waiting), 6) AS mean_wait FROM timing GROUP BY dataset""", "timing"))
def mean_variance(spark, d):
    return R.timing(spark, d).groupBy("dataset").agg(
        F.round(F.avg("size"), 6).alias("mean"), F.round(F.var_pop("size"), 6).alias("pvariance"), F.round(F.avg("waiting"), 6).alias("mean_wait"))


@query("E7_median", "SELECT l_returnflag, count(*) AS n, round(median(l_extendedprice), 6) AS median FROM lineitem GROUP BY l_returnflag")
def median(spark, d):
    li = table(spark, d, "lineitem", ["l_returnflag", "l_extendedprice"])
    return medians(li, "l_extendedprice", ["l_returnflag"]).withColumn("median", F.round("median", 6))


@query("E8_median_high", """
SELECT o_orderstatus, o_totalprice AS median_high FROM (
  SELECT o_orderstatus, o_totalprice, row_number() OVER (PARTITION BY o_orderstatus ORDER BY o_totalprice) AS r,
         count(*) OVER (PARTITION BY o_orderstatus) AS n FROM orders) WHERE r = n // 2 + 1""")
def median_high(spark, d):
    o = table(spark, d, "orders", ["o_orderstatus", "o_totalprice"])
    return order_statistics(o, "o_totalprice", {"median_high": HIGH_MIDDLE}, ["o_orderstatus"]).drop("n")


@query("E9_mode_first", with_ctes("""
SELECT dataset, size AS mode FROM (
  SELECT *, row_number() OVER (PARTITION BY dataset ORDER BY c DESC, p) AS r FROM (
    SELECT dataset, size, count(*) AS c, min(event_id) AS p FROM timing GROUP BY ALL)) WHERE r = 1""", "timing"))
def mode(spark, d):
    return mode_first(R.timing(spark, d), "size", ["dataset"], "event_id")


@query("E10_top_tenth_value", with_ctes("""
SELECT dataset, waiting AS top_tenth FROM (
  SELECT dataset, waiting, row_number() OVER (PARTITION BY dataset ORDER BY waiting DESC) AS r,
         count(*) OVER (PARTITION BY dataset) AS n FROM timing) WHERE r = CAST(floor(n * 0.1::DOUBLE) AS BIGINT) + 1""", "timing"))
def top_tenth(spark, d):
    return order_statistics(R.timing(spark, d), "waiting", {"top_tenth": top_share(0.1)}, ["dataset"]).drop("n")


@query("E11_hit_rate", with_ctes("""
SELECT dataset, round(100 * avg(CASE WHEN best > 0 THEN 1.0::DOUBLE ELSE 0 END), 6) AS hit_rate FROM (
  SELECT dataset, changeId, fileName, sum(CASE WHEN ngramScore > 2.8 THEN groundTruth ELSE 0 END) AS best FROM item_line GROUP BY ALL) GROUP BY dataset""", "item_line"))
def hit_rate(spark, d):
    per = R.item_lines(spark, d).groupBy(*FILE).agg(
        F.sum(F.when(F.col("ngramScore") > 2.8, F.col("groundTruth")).otherwise(0)).alias("best"))
    return per.groupBy("dataset").agg(F.round(100 * F.avg((F.col("best") > 0).cast("double")), 6).alias("hit_rate"))


@query("E12_column_sums", with_ctes("""
SELECT k, CAST(sum(n_common) AS BIGINT) AS common, CAST(sum(n_suggested) AS BIGINT) AS suggested, CAST(sum(n_changed) AS BIGINT) AS changed
FROM routed WHERE outcome IN ('positive', 'negative') GROUP BY k""", "routed"))
def column_sums(spark, d):
    return (R.routed(spark, d).where(F.col("outcome").isin("positive", "negative")).groupBy("k")
            .agg(F.sum("n_common").alias("common"), F.sum("n_suggested").cast("long").alias("suggested"),
                 F.sum("n_changed").cast("long").alias("changed")))


@query("E13_count_condition", with_ctes("""
SELECT dataset, count(*) FILTER (WHERE len(string_split(code, ' ')) - 1 >= 5) AS n FROM code_line GROUP BY dataset""", "code_line"))
def count_condition(spark, d):
    return R.code_lines(spark, d).groupBy("dataset").agg(F.count_if(X.tokens_per_line("code") >= 5).alias("n"))


@query("E14_class_weights", """
SELECT n0, n1, round((1.0::DOUBLE / n0) / (1.0::DOUBLE / n0 + 1.0::DOUBLE / n1), 9) AS w0, round((1.0::DOUBLE / n1) / (1.0::DOUBLE / n0 + 1.0::DOUBLE / n1), 9) AS w1,
       round(n0::DOUBLE / n1, 6) AS pos_weight, round((n0 + n1)::DOUBLE / (2 * n0), 6) AS balanced0, round((n0 + n1)::DOUBLE / (2 * n1), 6) AS balanced1
FROM (SELECT count(*) FILTER (WHERE toxic = 0) AS n0, count(*) FILTER (WHERE toxic = 1) AS n1 FROM labels)""")
def weights(spark, d):
    w = C.class_weights(table(spark, d, "labels"), "toxic")
    return w.select("n0", "n1", *[F.round(c, 9).alias(c) for c in ("w0", "w1")],
                    *[F.round(c, 6).alias(c) for c in ("pos_weight", "balanced0", "balanced1")])


@query("E15_median_per_column", """
SELECT 'l_quantity' AS variable, median(l_quantity) AS median FROM lineitem UNION ALL
SELECT 'l_extendedprice', round(median(l_extendedprice), 6) FROM lineitem UNION ALL
SELECT 'l_tax', median(l_tax) FROM lineitem UNION ALL SELECT 'l_discount', median(l_discount) FROM lineitem""")
def median_per_column(spark, d):
    names = ["l_quantity", "l_extendedprice", "l_tax", "l_discount"]
    long = table(spark, d, "lineitem", names).unpivot([], names, "variable", "value")
    return medians(long, "value", ["variable"]).select("variable", F.round("median", 6).alias("median"))


@query("E16_files_by_sign", with_ctes("""
SELECT dataset, count(*) FILTER (WHERE z > 0) AS zero_files, count(*) FILTER (WHERE m > 0) AS negative_files, count(*) AS total_files FROM (
  SELECT dataset, fileName, count(*) FILTER (WHERE limeScore = 0) AS z, count(*) FILTER (WHERE limeScore < 0) AS m
  FROM token_score GROUP BY ALL) GROUP BY dataset""", "token_score"))
def files_by_sign(spark, d):
    per = R.scored_tokens(spark, d).groupBy("dataset", "fileName").agg(
        F.count_if(F.col("limeScore") == 0).alias("z"), F.count_if(F.col("limeScore") < 0).alias("m"))
    return per.groupBy("dataset").agg(F.count_if(F.col("z") > 0).alias("zero_files"), F.count_if(F.col("m") > 0).alias("negative_files"),
                                      F.count(F.lit(1)).alias("total_files"))


R.CTES["epoch_loss"] = (("prediction",), """
  SELECT epoch, round(avg(-(label * ln(greatest(prob, 1e-9)) + (1 - label) * ln(greatest(1 - prob, 1e-9)))), 9) AS test_loss
  FROM prediction GROUP BY epoch""")


def epoch_losses(spark, d):
    p, q = F.greatest("prob", F.lit(1e-9)), F.greatest(1 - F.col("prob"), F.lit(1e-9))
    loss = -(F.col("label") * F.log(p) + (1 - F.col("label")) * F.log(q))
    return R.predictions(spark, d).groupBy("epoch").agg(F.round(F.avg(loss), 9).alias("test_loss"))


@query("E17_epoch_loss", with_ctes("SELECT epoch, round(test_loss, 6) AS test_loss FROM epoch_loss", "epoch_loss"))
def epoch_loss(spark, d):
    return epoch_losses(spark, d).withColumn("test_loss", F.round("test_loss", 6))


@query("E18_group_map", """
SELECT o_custkey, o_orderstatus, part, array_to_string(list(o_orderkey ORDER BY o_orderkey), ',') AS keys FROM (
  SELECT *, (row_number() OVER (PARTITION BY o_custkey, o_orderstatus ORDER BY o_orderkey) - 1) // 1000 AS part FROM orders) GROUP BY ALL""")
def group_map(spark, d):
    """(change, file) -> list, in numbered parts of a thousand, so that no group
    has to fit into one row however many entries it has."""
    o = table(spark, d, "orders", ["o_custkey", "o_orderstatus", "o_orderkey"])
    parts = number_rows(o, "o_orderkey", ["o_custkey", "o_orderstatus"]).withColumn("part", F.floor((F.col("number") - 1) / 1000))
    listed = F.sort_array(F.collect_list("o_orderkey"))
    return parts.groupBy("o_custkey", "o_orderstatus", "part").agg(
        F.array_join(F.transform(listed, lambda x: x.cast("string")), ",").alias("keys"))


@query("E19_distinct_pairs", "SELECT DISTINCT l_suppkey, l_partkey FROM lineitem")
def distinct_pairs(spark, d):
    return table(spark, d, "lineitem", ["l_suppkey", "l_partkey"]).distinct()


@query("E20_box_summary", with_ctes("""
, b AS (SELECT dataset, count(*) AS n, min(waiting) AS min, quantile_cont(waiting, 0.25) AS q1, quantile_cont(waiting, 0.5) AS median,
           quantile_cont(waiting, 0.75) AS q3, max(waiting) AS max FROM timing GROUP BY dataset)
SELECT dataset, n, min, round(q1, 6) AS q1, round(median, 6) AS median, round(q3, 6) AS q3, max,
       min(waiting) FILTER (WHERE inside) AS whisker_low, max(waiting) FILTER (WHERE inside) AS whisker_high, count(*) FILTER (WHERE NOT inside) AS outliers
FROM (SELECT b.*, waiting, waiting BETWEEN q1 - 1.5::DOUBLE * (q3 - q1) AND q3 + 1.5::DOUBLE * (q3 - q1) AS inside FROM timing JOIN b USING (dataset)) GROUP BY ALL""", "timing").replace("\n\n,", ",").replace("\n,", ","))
def box(spark, d):
    out = box_summary(R.timing(spark, d), "waiting", ["dataset"])
    return out.select("dataset", "n", "min", *[F.round(c, 6).alias(c) for c in ("q1", "median", "q3")], "max",
                      "whisker_low", "whisker_high", F.col("outliers").cast("long").alias("outliers"))


# --- F: ordered operators ------------------------------------------------------------

@query("F1_top_tokens_with_ties", with_ctes(
    "SELECT dataset, changeId, fileName, token, round(limeScore, 9) AS limeScore FROM top_token", "top_token"))
def top_ties(spark, d):
    return top_tokens(R.top_files(spark, d, 10)).withColumn("limeScore", F.round("limeScore", 9))


@query("F2_top_lines_with_ties", with_ctes("""
SELECT dataset, changeId, fileName, round(ngramScore, 6) AS ngramScore, groundTruth FROM (
  SELECT *, rank() OVER (PARTITION BY dataset, changeId, fileName ORDER BY ngramScore DESC) AS r FROM item_line) WHERE r <= 10""", "item_line"))
def top_lines(spark, d):
    return top_with_ties(R.item_lines(spark, d), FILE, "ngramScore", 10).select(
        *FILE, F.round("ngramScore", 6).alias("ngramScore"), "groundTruth")


@query("F2_top_lines_by_hits", with_ctes("""
SELECT dataset, changeId, fileName, lineNumber, numTopK, groundTruth FROM (
  SELECT *, rank() OVER (PARTITION BY dataset, changeId, fileName ORDER BY numTopK DESC) AS r FROM hit_line) WHERE r <= 10""", "hit_line"))
def top_lines_by_hits(spark, d):
    return top_with_ties(hit_lines(spark, d), FILE, "numTopK", 10).select(*FILE, "lineNumber", "numTopK", "groundTruth")


@query("F3_top_n_keys", with_ctes("SELECT row_id, CAST(rank AS INTEGER) AS rank, token, score FROM suggestion", "suggestion"))
def top_n_keys(spark, d):
    return suggestions(clean_scores(merge_subwords(R.pieces(spark, d))), 5).select("row_id", "rank", "token", "score")


@query("F4_arg_min", with_ctes("""
SELECT epoch, round(test_loss, 6) AS test_loss FROM epoch_loss ORDER BY epoch_loss.test_loss, epoch LIMIT 1""", "epoch_loss"))
def arg_min(spark, d):
    return first_by(epoch_losses(spark, d), "test_loss", "epoch").withColumn("test_loss", F.round("test_loss", 6))


@query("F5_split_by_position", """
SELECT o_orderkey, CASE WHEN r <= n // 5 + n * 3 // 5 + 5 THEN 'train' ELSE 'test' END AS split
FROM (SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey) AS r, count(*) OVER () AS n FROM orders)""")
def split_by_position(spark, d):
    o = table(spark, d, "orders", ["o_orderkey", "o_custkey"])
    return chronological_split(o, "o_orderkey", "o_custkey", bias=5).select("o_orderkey", "split")


@query("F6_early_stop", with_ctes("""
SELECT epoch, round(test_loss, 6) AS test_loss, improved, waited FROM (
  SELECT *, epoch - max(CASE WHEN improved THEN epoch END) OVER (ORDER BY epoch) AS waited FROM (
    SELECT *, coalesce(test_loss < min(test_loss) OVER (ORDER BY epoch ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), true) AS improved FROM epoch_loss))
WHERE epoch <= coalesce((SELECT min(epoch) FROM (
  SELECT epoch, epoch - max(CASE WHEN improved THEN epoch END) OVER (ORDER BY epoch) AS waited FROM (
    SELECT *, coalesce(test_loss < min(test_loss) OVER (ORDER BY epoch ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), true) AS improved FROM epoch_loss)) WHERE waited >= 5), 1000)""", "epoch_loss"))
def early_stop(spark, d):
    return early_stopping(epoch_losses(spark, d), patience=5).withColumn("test_loss", F.round("test_loss", 6))


@query("F7_line_neighbours", with_ctes("""
SELECT fileName, lineNumber, length(lag(code) OVER w) AS before, length(code) AS here, length(lead(code) OVER w) AS after
FROM code_line WINDOW w AS (PARTITION BY fileName ORDER BY lineNumber)""", "code_line"))
def line_neighbours(spark, d):
    """Neighbouring lines by array access inside the text, before it is exploded."""
    docs = table(spark, d, "documents", ["doc_id", "text"]).select("doc_id", F.split("text", "\n").alias("t"))
    around = F.transform("t", lambda x, i: F.struct(
        (i + 1).alias("lineNumber"), F.length(F.get("t", i - 1)).cast("long").alias("before"), F.length(x).cast("long").alias("here"),
        F.length(F.get("t", i + 1)).cast("long").alias("after")))
    return docs.select(F.col("doc_id").alias("fileName"), F.explode(around).alias("r")).select("fileName", "r.*")


@query("F8_average_ranks", with_ctes("""
SELECT dataset, waiting, count(*) AS n, avg(r) AS avg_rank FROM (
  SELECT dataset, waiting, row_number() OVER (PARTITION BY dataset ORDER BY waiting) AS r FROM timing) GROUP BY ALL""", "timing"))
def avg_ranks(spark, d):
    return average_ranks(R.timing(spark, d), "waiting", ["dataset"])


@query("F9_cumulative_counts", """
SELECT model, score, CAST(pos AS BIGINT) AS pos, CAST(neg AS BIGINT) AS neg, CAST(sum(pos) OVER w - pos AS BIGINT) AS pos_before, CAST(sum(neg) OVER w - neg AS BIGINT) AS neg_before FROM (
  SELECT l_linestatus AS model, l_extendedprice AS score, count(*) FILTER (WHERE l_returnflag = 'R') AS pos,
         count(*) FILTER (WHERE l_returnflag <> 'R') AS neg FROM lineitem GROUP BY ALL)
WINDOW w AS (PARTITION BY model ORDER BY score DESC)""")
def cumulative(spark, d):
    li = table(spark, d, "lineitem", ["l_linestatus", "l_extendedprice", "l_returnflag"]).select(
        F.col("l_linestatus").alias("model"), F.col("l_extendedprice").alias("score"), (F.col("l_returnflag") == "R").cast("int").alias("label"))
    return curve_points(li, "label", "score", ["model"])


@query("F10_sequence_numbers", """
SELECT l_returnflag, l_linestatus, o_orderkey, row_number() OVER (PARTITION BY l_returnflag, l_linestatus ORDER BY o_orderkey) AS number
FROM (SELECT DISTINCT l_returnflag, l_linestatus, l_orderkey AS o_orderkey FROM lineitem)""")
def sequence_numbers(spark, d):
    rows = table(spark, d, "lineitem", ["l_returnflag", "l_linestatus", "l_orderkey"]).withColumnRenamed("l_orderkey", "o_orderkey").distinct()
    return number_rows(rows, "o_orderkey", ["l_returnflag", "l_linestatus"])


@query("F11_sorted_result", with_ctes("""
SELECT epoch, count(*) FILTER (WHERE prob > 0.5) AS predicted FROM prediction GROUP BY epoch ORDER BY predicted DESC, epoch""", "prediction"))
def sorted_result(spark, d):
    return (R.predictions(spark, d).groupBy("epoch").agg(F.count_if(F.col("prob") > 0.5).alias("predicted"))
            .orderBy(F.col("predicted").desc(), "epoch"))
