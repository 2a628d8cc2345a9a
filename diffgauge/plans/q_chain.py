"""The file study on sparse rows (K6, L3, L6, L8), the chains from a forest to the sweeps and to the token evaluation,
and queries over whole turns and all turns."""

from __future__ import annotations

from pyspark.sql import functions as F

from diffgauge.functions import nested as NS
from diffgauge.functions import words as W
from diffgauge.operators import attribution as K, features as FT, file_study as S, models as L, sweep, vocabulary as V
from diffgauge.operators import tokens as TK
from diffgauge.operators.forest import predict_by_forest
from diffgauge.operators.joins import measured_lookup
from diffgauge.operators.sampling import chronological_split, class_counts, holdout
from diffgauge.operators.sparse_neighbours import nearest_sparse
from diffgauge.operators.stats import mann_whitney, median_split, signed_rank
from diffgauge.plans import roles as R
from diffgauge.plans.q_metrics import AVGS, FINAL_RATES, _signed_sql, rounded
from diffgauge.plans.q_text import TOKEN_SCORES, diff_xml
from diffgauge.plans.registry import query
from diffgauge.plans.roles import with_ctes
from diffgauge.operators.topk import top_exact
from diffgauge.functions import text as X
from diffgauge.session import materialize, scratch_dir
from diffgauge.sources import readers, writers
from diffgauge.sources.readers import table

NUMERIC = ["deletions", "additions", "changed_line"]

# the chronological split, its vocabulary and its sparse cells as SQL
R.CTES["split_edge"] = (("file_change",), """
  SELECT seq AS e FROM (SELECT seq, row_number() OVER (ORDER BY seq) AS r, count(*) OVER () AS n FROM file_change) WHERE r = n // 5 + n * 3 // 5""")
R.CTES["split_file"] = (("file_change", "split_edge"), """
  SELECT f.*, seq <= e OR change_id IN (SELECT change_id FROM file_change, split_edge GROUP BY change_id HAVING min(seq) <= max(e) AND max(seq) > max(e)) AS train
  FROM file_change f, split_edge""")
R.CTES["split_term"] = (("split_file",), """
  SELECT file_name, train, term, count(*) AS n FROM (
    SELECT file_name, train, unnest(regexp_extract_all(lower(code), '([\\p{L}\\p{N}_]{2,})', 1)) AS term FROM split_file) GROUP BY ALL""")
R.CTES["train_index"] = (("split_term", "split_file"), """
  SELECT term, count(*) AS df, CAST(row_number() OVER (ORDER BY term) - 1 AS INTEGER) AS index FROM split_term WHERE train GROUP BY term
  HAVING count(*) >= 2 AND count(*) <= 0.5::DOUBLE * (SELECT count(*) FROM split_file WHERE train)""")
R.CTES["cell"] = (("split_term", "train_index", "split_file"), """
  SELECT file_name, index, n::DOUBLE AS v FROM split_term JOIN train_index USING (term)
  UNION ALL
  SELECT file_name, (SELECT count(*) FROM train_index) + i, CASE i WHEN 0 THEN deletions WHEN 1 THEN additions ELSE changed_line END::DOUBLE
  FROM split_file, (SELECT unnest([0, 1, 2]) AS i)""")


def split_files(spark, d):
    return materialize(chronological_split(R.file_changes(spark, d), "seq", "change_id"))


@query("K6_vocabulary_of_all_documents", """
SELECT term, count(*) AS df, row_number() OVER (ORDER BY term) - 1 AS index FROM (
  SELECT DISTINCT doc_id, unnest(regexp_extract_all(lower(text), '([\\p{L}\\p{N}_]{2,})', 1)) AS term FROM documents)
GROUP BY term HAVING count(*) >= 2 AND count(*) <= 0.5::DOUBLE * (SELECT count(*) FROM documents)""")
def vocabulary_of_all(spark, d):
    """Labelled or not, every document counts; the index is a table, numbered by range."""
    docs = table(spark, d, "documents", ["doc_id", "text"])
    return V.term_index(FT.terms_long(docs, "doc_id", "text"), docs.count()).withColumn("index", F.col("index").cast("long"))


@query("K6_sparse_rows", with_ctes("""
SELECT file_name, count(*) AS n_columns, CAST(sum(index) AS BIGINT) AS index_sum, sum(v) AS value_sum, sum(v * v) AS square_sum
FROM cell GROUP BY file_name""", "cell"))
def rows_of_training_vocabulary(spark, d):
    """All files by the vocabulary of the training part alone."""
    s = S.study(split_files(spark, d), "file_name", "code", NUMERIC)

    def total(c):
        return F.aggregate(c, F.lit(0.0), lambda a, v: a + v)
    return s.train.unionByName(s.test).select(
        "file_name", F.size("indices").cast("long").alias("n_columns"), F.aggregate("indices", F.lit(0).cast("long"), lambda a, i: a + i).alias("index_sum"),
        total("values").alias("value_sum"), total(F.transform("values", lambda v: v * v)).alias("square_sum"))


@query("K7_numeric_columns_of_all_documents", f"""
SELECT d.doc_id, 1 - quality AS label, len(string_split(text, chr(10))) + len({R.words_sql('text')}) + n_chars AS numeric_sum
FROM documents d LEFT JOIN labels l USING (doc_id)""")
def numeric_of_all(spark, d):
    """The numeric columns behind the terms of every document's sparse row; the label is null where none is given."""
    from diffgauge.functions import text as X
    # two numbers a row: below the bound the texts stay where they are
    docs = measured_lookup(table(spark, d, "documents", ["doc_id", "text", "n_chars"]), table(spark, d, "labels", ["doc_id", "quality"]), ["doc_id"], most_rows=2_000_000)
    rows = materialize(docs.select("doc_id", (1 - F.col("quality")).alias("label"), "text", F.size(F.split("text", "\n")).alias("deletions"),
                                   X.words_per_line("text").alias("additions"), F.col("n_chars").alias("changed_line")))
    # a text is shorter than its terms, so it is shuffled to its key before it is cut into them
    terms = materialize(FT.terms_long(rows.select("doc_id", "text").repartition("doc_id"), "doc_id", "text"))
    sparse = V.sparse_rows(rows, terms, V.term_index(terms, rows.count()), "doc_id", NUMERIC)
    return sparse.select("doc_id", "label", F.aggregate(F.slice("values", -3, 3), F.lit(0.0), lambda a, v: a + v).cast("long").alias("numeric_sum"))


@query("L3_naive_bayes_predictions", with_ctes("""
, width AS (SELECT count(*) + 3 AS w FROM train_index),
 theta AS (SELECT label, index, sum(v) AS s FROM cell JOIN split_file USING (file_name) WHERE train GROUP BY ALL),
 class AS (SELECT label, count(*) AS n FROM split_file WHERE train GROUP BY label),
 mass AS (SELECT label, sum(s) AS t FROM theta GROUP BY label),
 score AS (SELECT c.file_name, k.label AS y, ln(k.n + 1) - ln((SELECT sum(n) FROM class) + 2) +
             sum(v * (ln(coalesce(t.s, 0) + 1) - ln(m.t + w))) AS p
           FROM cell c JOIN split_file f ON f.file_name = c.file_name AND NOT train, class k JOIN mass m ON m.label = k.label, width
           LEFT JOIN theta t ON t.index = c.index AND t.label = k.label GROUP BY c.file_name, k.label, k.n)
SELECT f.file_name, f.label, CAST(arg_max(y, p) AS INTEGER) AS prediction FROM score JOIN split_file f USING (file_name) GROUP BY f.file_name, f.label""",
    "cell", "split_file", "train_index").replace("\n\n,", ",").replace("\n,", ","))
def bayes_predictions(spark, d):
    s = S.study(split_files(spark, d), "file_name", "code", NUMERIC)
    return S.predict("NB", s).select("file_name", "label", "prediction")


R.CTES["bag_distance"] = (("cell", "split_file"), """
  SELECT q.file_name AS query, r.file_name AS neighbour, r.label, round(sqrt(greatest(q.s + r.s - 2 * coalesce(x.dot, 0), 0)), 9) AS distance
  FROM (SELECT file_name, sum(v * v) AS s FROM cell JOIN split_file USING (file_name) WHERE NOT train GROUP BY file_name) q,
       (SELECT file_name, label, sum(v * v) AS s FROM cell JOIN split_file USING (file_name) WHERE train GROUP BY ALL) r
  LEFT JOIN (SELECT a.file_name AS a, b.file_name AS b, sum(a.v * b.v) AS dot FROM cell a JOIN cell b USING (index)
             WHERE a.file_name IN (SELECT file_name FROM split_file WHERE NOT train) AND b.file_name IN (SELECT file_name FROM split_file WHERE train)
             GROUP BY ALL) x ON x.a = q.file_name AND x.b = r.file_name""")


@query("I6_nearest_bags", with_ctes("""
SELECT query, CAST(rank AS INTEGER) AS rank, neighbour, distance FROM (
  SELECT *, row_number() OVER (PARTITION BY query ORDER BY distance, neighbour) AS rank FROM bag_distance) WHERE rank <= 3""", "bag_distance"))
def nearest_bags(spark, d):
    s = S.study(split_files(spark, d), "file_name", "code", NUMERIC)
    return nearest_sparse(s.test, s.train, "file_name", 3).select("query", "rank", "neighbour", "distance")


@query("L6_knn_of_bags", with_ctes("""
SELECT query AS file_name, round(avg(label), 9) AS prob, CAST(avg(label) > 0.5 AS INTEGER) AS prediction FROM (
  SELECT *, row_number() OVER (PARTITION BY query ORDER BY distance, neighbour) AS rank FROM bag_distance) WHERE rank <= 3 GROUP BY query""", "bag_distance"))
def knn_of_bags(spark, d):
    s = S.study(split_files(spark, d), "file_name", "code", NUMERIC)
    return S.predict("KNN", s).select("file_name", F.round("prob", 9).alias("prob"), "prediction")


def by_project(spark, d):
    """(project, files): the languages of the documents stand for the projects."""
    files = R.file_changes(spark, d).join(table(spark, d, "documents", ["doc_id", "lang"]).withColumnRenamed("doc_id", "file_name"), "file_name")
    files = materialize(files)
    for project in sorted(p for p in class_counts(files, "lang") if p is not None):
        yield project, materialize(chronological_split(files.where(F.col("lang") == project).drop("lang"), "seq", "change_id"))


@query("L8_compare_models_by_project")
def compare_by_project(spark, d):
    """All six techniques for every project, each with a vocabulary and a split of its own."""
    out = None
    for project, files in by_project(spark, d):
        s = S.study(files, "file_name", "code", NUMERIC)
        if len(class_counts(s.train, "label")) < 2 or not s.test.head(1):
            continue        # nothing to learn or to test: the project has no rows, as no measure is defined
        for technique in L.TECHNIQUES:
            one = S.predict(technique, s).select(F.lit(technique).alias("Technique"), F.lit(project).alias("Datasets"),
                                                 "label", "prob", "prediction")
            out = one if out is None else out.unionByName(one)
    return L.evaluate(out)


# --- a forest's weights as token scores ---------------------------------------------------

_STAGES: dict[tuple, dict] = {}


def forest_stages(spark, d):
    """Stored tables from the forest to scored tokens, made once per session for the same rows.

    predictions (L1), weights (K3, K4 without stop words), lines and tokens (K5) of the explained files.
    """
    files = split_files(spark, d)
    key = (spark.sparkContext.applicationId, S.fingerprint(files))
    if key not in _STAGES:
        e = S.explain_true_positives(S.study(files, "file_name", "code", NUMERIC))
        kept = K.without_stop_words(e.weights.withColumn("language", F.lit("python")), W.stop_words(spark)).drop("language")
        weights = materialize(kept.withColumnRenamed("file_name", "fileName"))
        hits = e.predictions.where("label = 1 and prediction = 1").select(F.col("file_name").alias("fileName"))
        code = materialize(R.code_lines(spark, d).join(hits, "fileName", "left_semi"))
        tokens = materialize(K.token_scores(code, weights, ["fileName", "token"]).select(
            "dataset", "changeId", "fileName", "lineNumber", "token", "limeScore"))
        lines = materialize(R.scored_lines(spark, d).join(hits, "fileName", "left_semi"))
        _STAGES[key] = {"predictions": e.predictions, "weights": weights, "tokens": tokens, "lines": lines}
    return _STAGES[key]


@query("L1_forest_predictions")
def forest_predictions(spark, d):
    return forest_stages(spark, d)["predictions"]


@query("K3_forest_surrogate")
def forest_surrogate(spark, d):
    """Weights of the terms of every file that the forest rightly calls positive."""
    return forest_stages(spark, d)["weights"]


@query("K5_forest_token_scores")
def forest_tokens(spark, d):
    return forest_stages(spark, d)["tokens"]


def forest_sweep(stages):
    return sweep.sweep_summary(sweep.top_k_sweep_by_file(stages["lines"], stages["tokens"]), "k")


@query("N1_top_k_sweep_of_forest")
def n1_forest(spark, d):
    return rounded(forest_sweep(forest_stages(spark, d)), *AVGS)


def forest_rates(stages):
    k = sweep.best_setting(forest_sweep(stages), "k").first()
    t = sweep.best_setting(sweep.sweep_summary(sweep.score_sweep_by_file(stages["lines"]), "threshold"), "threshold").first()
    return sweep.final_comparison(stages["lines"], stages["tokens"], k["k"] if k else 0, t["threshold"] if t else 0.0)


@query("N3_final_comparison_of_forest")
def n3_forest(spark, d):
    return rounded(forest_rates(forest_stages(spark, d)).drop("tokens"), *FINAL_RATES)


@query("N4_signed_rank_of_forest")
def n4_forest(spark, d):
    rates = materialize(forest_rates(forest_stages(spark, d)))
    pairs = F.array(*[F.struct(F.lit(m).alias("measure"), F.round(f"topk_{m}", 9).alias("app"), F.round(f"ngram_{m}", 9).alias("base"))
                      for m in ("recall", "far", "d2h")])
    long = rates.select(F.explode(pairs).alias("p")).select("p.*")
    return signed_rank(long, "app", "base", ["measure"])


# --- a text surrogate into the token evaluation -----------------------------------------------

def text_stages(spark, d):
    """Stored tables from a forest over the turns to routed suggestions, made once per session for the same rows.

    A turn's label is its speaker's side; held-out turns of the positive side are explained (K2), their best
    words suggested, and routed (J6) by the forest's own prediction and the whole turn's length.
    """
    pairs = R.pairs(spark, d).join(table(spark, d, "conversations", ["conv_id", "turn", "role"]), ["conv_id", "turn"])
    rows = materialize(pairs.withColumn("label", (F.col("role") != "user").cast("int")))
    key = (spark.sparkContext.applicationId, "text", S.fingerprint(rows))
    if key not in _STAGES:
        files = materialize(holdout(rows.select("row_id", "label", "before_code"), "label", ["row_id"]))
        s = S.study(files, "row_id", "before_code")
        nodes = S.fit_forest(s, trees=50)
        predictions = predict_by_forest(s.test, nodes, "row_id")
        asked = rows.join(predictions.where("label = 1").select("row_id", "prediction"), "row_id")
        scores = materialize(S.explain_texts(asked, s, nodes, "before_code"))
        best = top_exact(scores, ["row_id"], [F.col("score").desc(), F.col("token")], 5)
        rows_in = asked.select("row_id", "before_code", "after_code", X.tokens_per_line("before_code").alias("n_tokens"),
                               F.col("prediction").alias("y_pred"))
        changed = materialize(TK.changed_tokens(asked))
        routed = materialize(TK.route_rows(rows_in, best.select("row_id", "rank", "token"), changed, more_than_n=7))
        _STAGES[key] = {"predictions": predictions, "scores": scores, "changed": changed, "rows": rows_in, "routed": routed}
    return _STAGES[key]


@query("K2_forest_text_surrogate")
def forest_text_surrogate(spark, d):
    return text_stages(spark, d)["scores"]


@query("J6_routing_of_text_surrogate")
def routing_of_text(spark, d):
    return text_stages(spark, d)["routed"].select("row_id", "k", "n_common", "n_suggested", "n_changed", "outcome")


@query("M7_token_scores_of_text_surrogate")
def scores_of_text(spark, d):
    out = TK.token_scores_at_k(text_stages(spark, d)["routed"])
    return rounded(out.select("k", "common", "changed", "suggested", "recall", "precision", "f1"), "recall", "precision", "f1")


# --- whole turns, all turns -------------------------------------------------------------------

R.CTES["routed_whole"] = (R.CTES["routed"][0], R.CTES["routed"][1].replace(
    "len(string_split(string_split(p.before_code, chr(10))[1], ' ')) - 1", "len(string_split(p.before_code, ' ')) - 1"))
WHOLE_SCORES = TOKEN_SCORES.replace("FROM routed", "FROM routed_whole")


@query("J6_outcome_routing_by_whole_turn", with_ctes("""
SELECT row_id, k, n_common, n_suggested, n_changed, outcome, CASE WHEN outcome = 'too_short' THEN 'FN' ELSE outcome END AS published FROM routed_whole""", "routed_whole"))
def routing_by_whole_turn(spark, d):
    return R.routed(spark, d, whole=True).select(
        "row_id", "k", "n_common", F.col("n_suggested").cast("long").alias("n_suggested"), F.col("n_changed").cast("long").alias("n_changed"),
        "outcome", TK.published_outcome().alias("published"))


@query("M7_token_scores_by_whole_turn", with_ctes(f"""
SELECT k, common, changed, suggested, round(recall, 6) AS recall, round(precision, 6) AS precision,
       round(2 * recall * precision / nullif(recall + precision, 0), 6) AS f1 FROM ({WHOLE_SCORES})""", "routed_whole"))
def scores_by_whole_turn(spark, d):
    out = TK.token_scores_at_k(R.routed(spark, d, whole=True))
    return rounded(out.select("k", "common", "changed", "suggested", "recall", "precision", "f1"), "recall", "precision", "f1")


@query("G7_venn_counts_by_whole_turn", with_ctes(f"""
SELECT k, changed - common AS changed_only, suggested - common AS suggested_only, common FROM ({WHOLE_SCORES})""", "routed_whole"))
def venn_by_whole_turn(spark, d):
    return TK.venn_counts(TK.token_scores_at_k(R.routed(spark, d, whole=True)))


@query("A12_read_log_folder", with_ctes("""
SELECT k, outcome, row_number() OVER (PARTITION BY k, outcome ORDER BY split_part(row_id, ':', 1)::BIGINT, split_part(row_id, ':', 2)::BIGINT) AS log_number,
       before_code AS before, after_code AS after, array_to_string(changed, '|') AS changed, array_to_string(suggested, '|') AS suggestion
FROM routed_whole WHERE outcome IN ('positive', 'negative')""", "routed_whole"))
def read_log_folder(spark, d):
    """The numbered records (A11) as a folder of log files, one per record, read back as whole files by their paths."""
    part = F.split("row_id", ":")
    rows = R.routed(spark, d, whole=True).withColumns({"conv_id": part[0].cast("long"), "turn": part[1].cast("long")})
    records = writers.numbered_records(materialize(rows), "conv_id", ["turn"])
    path = scratch_dir(spark)
    writers.logs(records, path)
    logs = readers.logs(spark, path)

    def named(key):
        return F.regexp_extract("path", f"{key}=([^/]+)/", 1)
    return logs.select(named("k").cast("int").alias("k"), named("outcome").alias("outcome"), named("log_number").cast("long").alias("log_number"),
                       "before", "after", F.array_join("changed", "|").alias("changed"), F.array_join("suggestion", "|").alias("suggestion"))


@query("J5_xml_changed_tokens_of_all_turns", with_ctes("""
SELECT DISTINCT row_id, regexp_replace(token, '[0-9]+', 'NUM', 'g') AS token FROM (SELECT row_id, unnest(gone) AS token FROM xml_word)
WHERE NOT regexp_matches(token, '[[:punct:]]')""", "xml_word"))
def xml_tokens_of_all(spark, d):
    return TK.xml_changed_tokens(diff_xml(spark, d, whole=True))


@query("B20_search_key_of_all_turns", with_ctes("""
SELECT row_id, CAST(len(gone) + len(kept) + len(added) AS INTEGER) AS n_names,
       array_to_string(list_concat(gone, kept, added), ' ') AS names FROM xml_word""", "xml_word"))
def search_key_of_all(spark, d):
    xml = diff_xml(spark, d, whole=True).withColumn("f", NS.search_key("xml", "name"))
    return xml.select("row_id", F.size("f").alias("n_names"), F.array_join("f", " ").alias("names"))


@query("B21_remove_key_of_all_turns", with_ctes("""
SELECT row_id, array_to_string(list_concat(gone, added), ' ') AS names FROM xml_word""", "xml_word"))
def remove_key_of_all(spark, d):
    return diff_xml(spark, d, whole=True).select("row_id", F.array_join(NS.texts_without("xml", "diff:common"), " ").alias("names"))


# --- p-values of the rank tests -----------------------------------------------------------------

def tail_sql(z: str) -> str:
    """P(Z > z) as in ``normal_tail``; the coefficients are fixed values of a published fit of erfc."""
    t = f"(1 / (1 + 0.5::DOUBLE * abs({z}) / sqrt(2)))"
    coefficients = (-1.26551223, 1.00002368, 0.37409196, 0.09678418, -0.18628806, 0.27886807, -1.13520398, 1.48851587, -0.82215223, 0.17087277)
    poly = f"({coefficients[-1]})::DOUBLE"
    for c in reversed(coefficients[:-1]):
        poly = f"(({c})::DOUBLE + {t} * {poly})"
    erfc = f"({t} * exp(-({z}) * ({z}) / 2 + {poly}))"
    return f"(CASE WHEN {z} >= 0 THEN {erfc} / 2 ELSE 1 - {erfc} / 2 END)"


def rank_test_sql(source: str, group: str, value: str, side: str) -> str:
    """n1, n2, w, z and the two one-sided z per group, by the normal approximation."""
    return f"""
  SELECT g, n1, n2, w, (w - m - sign(w - m) * 0.5::DOUBLE) / s AS z, (w - m - 0.5::DOUBLE) / s AS up, (w - m + 0.5::DOUBLE) / s AS down, ties FROM (
    SELECT *, n1 * n2 / 2.0::DOUBLE AS m, sqrt(n1 * n2 / 12.0::DOUBLE * ((n + 1) - ties / (n::DOUBLE * (n - 1)))) AS s FROM (
      SELECT g, count(*) FILTER (WHERE side) AS n1, count(*) FILTER (WHERE NOT side) AS n2, count(*) AS n,
        sum(CASE WHEN side THEN r ELSE 0 END) - (count(*) FILTER (WHERE side)) * (count(*) FILTER (WHERE side) + 1) / 2.0::DOUBLE AS w,
        sum(c::DOUBLE * c - 1) AS ties
      FROM (SELECT g, side, count(*) OVER (PARTITION BY g, v) AS c,
                   rank() OVER (PARTITION BY g ORDER BY v) + (count(*) OVER (PARTITION BY g, v) - 1) / 2.0::DOUBLE AS r
            FROM (SELECT {group} AS g, {value} AS v, {side} AS side FROM {source})) GROUP BY g))"""


@query("N5_mann_whitney_p_values", with_ctes(f"""
SELECT g AS dataset, n1, n2, w, round(least(2 * {tail_sql('abs(z)')}, 1), 6) AS p_two_sided, round({tail_sql('up')}, 6) AS p_greater,
       round({tail_sql('(-down)')}, 6) AS p_less, 'normal' AS method FROM ({rank_test_sql('sized', 'dataset', 'waiting', 'is_large')})""", "sized"))
def rank_sum_p_values(spark, d):
    marked = median_split(R.timing(spark, d), "size", ["dataset"], cuts=[])
    out = mann_whitney(marked, "waiting", "is_large", ["dataset"])
    return rounded(out.select("dataset", "n1", "n2", "w", "p_two_sided", "p_greater", "p_less", "method"), "p_two_sided", "p_greater", "p_less")


# orders of one customer by status: samples of a few rows whose prices do not repeat, so the exact rule decides
R.CTES["small_sample"] = ((), """
  SELECT o_custkey AS g, o_totalprice AS v, o_orderstatus = 'F' AS side FROM orders""")
R.CTES["small_rank"] = (("small_sample",), """
  SELECT g, side, rank() OVER (PARTITION BY g ORDER BY v) AS r, count(*) OVER (PARTITION BY g, v) AS c, count(*) OVER (PARTITION BY g) AS n,
         count(*) FILTER (WHERE side) OVER (PARTITION BY g) AS n1 FROM small_sample""")


@query("N5_mann_whitney_exact", with_ctes("""
, sizes AS (SELECT DISTINCT CAST(n1 AS INTEGER) AS n1, CAST(n - n1 AS INTEGER) AS n2 FROM small_rank WHERE n1 > 0 AND n1 < n AND n <= 12),
 subset AS (SELECT n1, n2, n1 * n2 AS top, unnest(range(0, (1 << (n1 + n2))::BIGINT)) AS mask FROM sizes),
 draw AS (SELECT n1, n2, list_sum(list_transform(range(0, n1 + n2), lambda i: CASE WHEN (mask >> i) & 1 = 1 THEN i + 1 ELSE 0 END)) - n1 * (n1 + 1) / 2 AS u
          FROM subset WHERE bit_count(mask) = n1),
 freq AS (SELECT n1, n2, CAST(u AS BIGINT) AS u, count(*) AS c FROM draw GROUP BY ALL),
 asked AS (SELECT g, CAST(max(n1) AS INTEGER) AS n1, CAST(max(n) - max(n1) AS INTEGER) AS n2, CAST(sum(CASE WHEN side THEN r ELSE 0 END) - max(n1) * (max(n1) + 1) / 2 AS BIGINT) AS w
           FROM small_rank GROUP BY g HAVING max(c) = 1 AND max(n1) > 0 AND max(n1) < max(n) AND max(n) <= 12)
SELECT g AS customer, a.n1::BIGINT AS n1, a.n2::BIGINT AS n2, a.w::DOUBLE AS w,
       round(least(2 * least(sum(c) FILTER (WHERE u <= w), sum(c) FILTER (WHERE u >= w))::DOUBLE / sum(c), 1), 9) AS p_two_sided,
       round((sum(c) FILTER (WHERE u >= w))::DOUBLE / sum(c), 9) AS p_greater, round((sum(c) FILTER (WHERE u <= w))::DOUBLE / sum(c), 9) AS p_less
FROM asked a JOIN freq f USING (n1, n2) GROUP BY ALL""", "small_rank").replace("\n\n,", ",").replace("\n,", ","))
def exact_rank_sum(spark, d):
    """The exact tests of customers with at most twelve orders; the SQL draws every subset, which is why it stops there."""
    o = table(spark, d, "orders", ["o_custkey", "o_totalprice", "o_orderstatus"]).withColumn("side", F.col("o_orderstatus") == "F")
    out = mann_whitney(o, "o_totalprice", "side", ["o_custkey"]).where("method = 'exact' and n1 + n2 <= 12")
    return rounded(out.select(F.col("o_custkey").alias("customer"), "n1", "n2", "w", "p_two_sided", "p_greater", "p_less"),
                   "p_two_sided", "p_greater", "p_less", digits=9)


@query("N4_signed_rank_p_values", f"""
SELECT n, n_used, w_plus, round(least(2 * {tail_sql('abs(z)')}, 1), 6) AS p_two_sided, round({tail_sql('z')}, 6) AS p_greater, round({tail_sql('(-z)')}, 6) AS p_less
FROM ({{signed}})""".replace("{signed}", _signed_sql("o_totalprice", "150000.0::DOUBLE", "orders", 15)))
def signed_rank_p_values(spark, d):
    o = table(spark, d, "orders", ["o_totalprice"]).withColumn("baseline", F.lit(150000.0))
    out = signed_rank(o, "o_totalprice", "baseline")
    return rounded(out.select("n", "n_used", "w_plus", "p_two_sided", "p_greater", "p_less"), "p_two_sided", "p_greater", "p_less")
