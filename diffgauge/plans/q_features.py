"""Attribution and features (K), models (L)."""

from __future__ import annotations

from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import functions as F

from diffgauge.functions import words as W
from diffgauge.operators import attribution as K, features as FT, file_study as S, models as L, ngrams, surrogate
from diffgauge.operators.sampling import chronological_split, holdout
from diffgauge.operators.tokens import clean_scores, merge_subwords
from diffgauge.operators.topk import top_exact
from diffgauge.plans import roles as R
from diffgauge.plans.q_aggregates import LENGTHS
from diffgauge.plans.q_joins import labelled_lines, train_files
from diffgauge.plans.q_text import word_rows
from diffgauge.plans.registry import query
from diffgauge.plans.roles import with_ctes
from diffgauge.session import materialize, scratch_dir
from diffgauge.sources.readers import table

NUMERIC = ["deletions", "additions", "changed_line"]


@query("K1_attention_scores", with_ctes("""
SELECT row_id, token, score, CAST(rank AS INTEGER) AS rank FROM suggestion WHERE rank <= 3""", "suggestion"))
def attention_scores(spark, d):
    """Scores arrive as a table of pieces; words, cleaning and top 3 follow."""
    words = clean_scores(merge_subwords(R.pieces(spark, d)))
    return top_exact(words, ["row_id"], [F.col("score").desc(), F.col("pos")], 3).select("row_id", "token", "score", "rank")


def split_files(spark, d):
    files = R.file_changes(spark, d)
    return materialize(chronological_split(files, "seq", "change_id"))


def featured(spark, d):
    """Train and test rows of the file study with their feature vectors."""
    files = split_files(spark, d)
    train = files.where(F.col("split") == "train")
    stages = FT.feature_pipeline("code", NUMERIC).fit(train)
    rows = materialize(FT.plain_vectors(stages.transform(files)).select("label", "file_name", "split", "features"))
    return rows.where(F.col("split") == "train").drop("split"), rows.where(F.col("split") == "test").drop("split")


@query("K2_text_surrogate")
def text_surrogate(spark, d):
    """Words that push a held-out positive file's lines to positive: weighted
    logistic regression on the training files, 10,000 perturbations per line."""
    files = materialize(holdout(R.file_changes(spark, d), "label", ["file_name"]))
    train = files.where(F.col("split") == "train")
    stages = FT.feature_pipeline("code", [])
    model = L.text_model(L.balanced_weights(train.select("label", "code")), stages, "weight")
    coefficients = model.stages[-1].coefficients.toArray()
    terms = spark.createDataFrame(
        [(t, float(c)) for t, c in zip(model.stages[1].vocabulary, coefficients)], "token string, coefficient double")
    test = files.where((F.col("split") == "test") & (F.col("label") == 1))
    lines = test.select("file_name", F.posexplode(F.split("code", "\n")).alias("i", "line"))
    counted = FT.terms_long(lines.withColumn("row_id", R.joined_id("file_name", "i")), "row_id", "line")
    effects = (counted.withColumnRenamed("term", "token").join(terms, "token", "left")
               .select("row_id", "token", (F.coalesce("coefficient", F.lit(0.0)) * F.col("n")).alias("effect")))
    return surrogate.explain_text(effects, "row_id", float(model.stages[-1].intercept))


@query("K3_row_surrogate")
def row_surrogate(spark, d):
    """Per true-positive vector the weight of every coordinate."""
    e = table(spark, d, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("x"),
                                             (F.col("label") >= 8).cast("int").alias("label"))
    rows = e.withColumn("features", array_to_vector("x"))
    model = L.logistic(rows.count(), weight="weight").fit(L.balanced_weights(rows))
    stats = rows.select(Summarizer.metrics("mean", "std").summary(F.col("features")).alias("s")).select("s.mean", "s.std").first()
    hits = L.scored(model.transform(rows), "vec_id").where("prediction = 1 AND label = 1").select("vec_id")
    return surrogate.explain_rows(rows.join(hits, "vec_id", "left_semi"), "vec_id", "x", model,
                                  stats["mean"].toArray(), stats["std"].toArray())


@query("K4_attribution_without_stop_words", with_ctes(f"""
SELECT token, round(weight, 9) AS weight FROM token_weight
WHERE token NOT IN (SELECT stop.token FROM {word_rows()} WHERE stop.language = 'python')""", "token_weight"))
def attribution(spark, d):
    weights = R.token_weights(spark, d).withColumn("language", F.lit("python"))
    return K.without_stop_words(weights, W.stop_words(spark)).select("token", F.round("weight", 9).alias("weight"))


@query("K5_token_scores", with_ctes("""
SELECT dataset, changeId, fileName, lineNumber, token, round(limeScore, 9) AS limeScore FROM token_score""", "token_score"))
def token_scores(spark, d):
    return R.scored_tokens(spark, d).withColumn("limeScore", F.round("limeScore", 9))


R.CTES["term"] = (("file_change",), """
  SELECT file_name, term, count(*) AS n FROM (
    SELECT file_name, unnest(regexp_extract_all(lower(code), '([\\p{L}\\p{N}_]{2,})', 1)) AS term FROM file_change) GROUP BY ALL""")
R.CTES["vocabulary"] = (("term", "file_change"), """
  SELECT term, count(*) AS df FROM term GROUP BY term
  HAVING count(*) >= 2 AND count(*) <= 0.5::DOUBLE * (SELECT count(*) FROM file_change)""")


@query("K6_vocabulary", with_ctes("SELECT term, df FROM vocabulary", "vocabulary"))
def vocabulary(spark, d):
    files = R.file_changes(spark, d)
    return FT.vocabulary(FT.terms_long(files, "file_name", "code"), files.count())


@query("K6_bag_of_words", with_ctes("""
SELECT file_name, count(*) AS n_terms, CAST(sum(n) AS BIGINT) AS n_words FROM term JOIN vocabulary USING (term) GROUP BY file_name""", "term", "vocabulary"))
def bag_of_words(spark, d):
    files = R.file_changes(spark, d)
    terms = FT.terms_long(files, "file_name", "code")
    bag = FT.bag_of_words(terms, FT.vocabulary(terms, files.count()))
    return bag.groupBy("file_name").agg(F.count(F.lit(1)).alias("n_terms"), F.sum("n").alias("n_words"))


@query("K7_numeric_columns", with_ctes("""
SELECT file_name, label, deletions + additions + changed_line AS numeric_sum FROM file_change""", "file_change"))
def numeric_columns(spark, d):
    files = materialize(R.file_changes(spark, d))       # read for the vocabulary, the vectors' size and the vectors
    model = FT.feature_pipeline("code", NUMERIC).fit(files)
    tail = vector_to_array(FT.TAIL)
    return FT.with_tail(model.transform(files), len(NUMERIC)).select("file_name", "label", F.aggregate(tail, F.lit(0.0), lambda a, v: a + v).cast("long").alias("numeric_sum"))


R.CTES["bench_line"] = ((), """
  SELECT item_id || ':' || i AS line_id, text FROM (
    SELECT item_id, generate_subscripts(string_split(text, chr(10)), 1) AS i, unnest(string_split(text, chr(10))) AS text FROM benchmark)""")
ENTROPY = f"""
WITH {{ctes}},
 train AS (SELECT DISTINCT code AS text FROM code_line WHERE code NOT IN (SELECT {R.STRIP.format('text')} FROM bench_line)),
 tw AS (SELECT text, {R.words_sql('text')} AS w FROM train),
 occ AS (SELECT i, list_concat(['<s>', '<s>'], w)[i : i + 2] AS g FROM (SELECT w, unnest(range(1, len(w) + 1)) AS i FROM tw)),
 c0 AS (SELECT g[3] AS a, count(*) AS c FROM occ GROUP BY 1), c1 AS (SELECT g[2:3] AS a, count(*) AS c FROM occ GROUP BY 1),
 c2 AS (SELECT g AS a, count(*) AS c FROM occ GROUP BY 1), h1 AS (SELECT g[2] AS a, count(*) AS c FROM occ GROUP BY 1),
 h2 AS (SELECT g[1:2] AS a, count(*) AS c FROM occ GROUP BY 1),
 size AS (SELECT (SELECT sum(c) FROM c0)::DOUBLE AS n, (SELECT count(*) + 1 FROM c0)::DOUBLE AS v),
 tl AS (SELECT line_id, {R.words_sql('text')} AS w FROM bench_line),
 q AS (SELECT line_id, list_concat(['<s>', '<s>'], w)[i : i + 2] AS g FROM (SELECT line_id, w, unnest(range(1, len(w) + 1)) AS i FROM tl)),
 p0 AS (SELECT line_id, g, 0.5::DOUBLE * coalesce(c0.c, 0) / n + 0.5::DOUBLE / v AS p FROM q LEFT JOIN c0 ON c0.a = g[3], size),
 p1 AS (SELECT line_id, g, CASE WHEN h1.c IS NULL THEN p ELSE 0.5::DOUBLE * coalesce(c1.c, 0) / h1.c + 0.5::DOUBLE * p END AS p
        FROM p0 LEFT JOIN h1 ON h1.a = g[2] LEFT JOIN c1 ON c1.a = g[2:3]),
 p2 AS (SELECT line_id, CASE WHEN h2.c IS NULL THEN p ELSE 0.5::DOUBLE * coalesce(c2.c, 0) / h2.c + 0.5::DOUBLE * p END AS p
        FROM p1 LEFT JOIN h2 ON h2.a = g[1:2] LEFT JOIN c2 ON c2.a = g)
SELECT line_id, round(entropy, 6) AS entropy FROM bench_line LEFT JOIN (SELECT line_id, avg(-log2(p)) AS entropy FROM p2 GROUP BY line_id) USING (line_id)"""


@query("K8_line_entropy", ENTROPY.replace("{ctes}", with_ctes("", "code_line", "bench_line").removeprefix("WITH ").rstrip()))
def line_entropy(spark, d):
    b = table(spark, d, "benchmark").select("item_id", F.posexplode(F.split("text", "\n")).alias("i", "text"))
    test = b.select(R.joined_id("item_id", F.col("i") + 1).alias("line_id"), "text")
    corpus = R.code_lines(spark, d).select(F.col("code").alias("text"))
    train = ngrams.corpus_without(corpus, test)
    return ngrams.line_entropy(train, test).withColumn("entropy", F.round("entropy", 6))


@query("K9_length_score", with_ctes(f"""
SELECT fileName, lineNumber, round(coalesce(length_score, 0), 9) AS length_score FROM (
  SELECT fileName, lineNumber, CAST(len({R.words_sql('code')}) AS INTEGER) AS length FROM code_line) LEFT JOIN ({LENGTHS}) USING (length)""", "code_line", "labelled_line", "train_file"))
def length_score(spark, d):
    spread_of = K.length_distribution(K.commented_lines(labelled_lines(spark, d), train_files(spark, d)))
    out = K.with_length_score(R.code_lines(spark, d), spread_of)
    return out.select("fileName", "lineNumber", F.round("length_score", 9).alias("length_score"))


# --- L: models -----------------------------------------------------------------------------

def sparse_metrics_of(*techniques: str):
    """The metric table on sparse rows, whose vocabulary is a table."""
    def plan(spark, d):
        return S.compare(S.study(split_files(spark, d), "file_name", "code", NUMERIC, by_row=True), "all", techniques)
    return plan


@query("L2_logistic_regression")
def logistic_metrics(spark, d):
    train, test = featured(spark, d)
    return L.compare(train, test, "file_name", "all", ["LG"])


query("L1_random_forest")(sparse_metrics_of("RF"))
query("L3_naive_bayes")(sparse_metrics_of("NB"))
query("L4_decision_tree")(sparse_metrics_of("DT"))


@query("L5_random_guess", with_ctes("""
, edge AS (SELECT seq AS e FROM (SELECT seq, row_number() OVER (ORDER BY seq) AS r, count(*) OVER () AS n FROM file_change) WHERE r = n // 5 + n * 3 // 5),
 cut AS (SELECT change_id FROM file_change, edge GROUP BY change_id HAVING min(seq) <= max(e) AND max(seq) > max(e)),
 parts AS (SELECT file_name, label, seq <= e OR change_id IN (SELECT change_id FROM cut) AS train FROM file_change, edge)
SELECT file_name, label, CAST(('0x' || substr(md5(file_name || ':2'), 1, 8))::BIGINT / 4294967296.0::DOUBLE < (SELECT avg(label) FROM parts WHERE train) AS INTEGER) AS prediction
FROM parts WHERE NOT train""", "file_change").replace("\n\n,", ",").replace("\n,", ","))
def random_guess(spark, d):
    files = chronological_split(R.file_changes(spark, d).drop("code"), "seq", "change_id")
    train, test = files.where("split = 'train'"), files.where("split = 'test'")
    return L.random_guess(test, train, "file_name").select("file_name", "label", "prediction")


@query("L6_knn_classifier", """
WITH e AS (SELECT vec_id, CAST(label >= 5 AS INTEGER) AS y, embedding::DOUBLE[] AS x FROM embeddings),
 s AS (SELECT *, row_number() OVER (PARTITION BY y ORDER BY md5(vec_id || ':1000')) <= (count(*) OVER (PARTITION BY y) + 9) // 10 AS test FROM e),
 near AS (SELECT * FROM (
   SELECT a.vec_id, a.y AS label, b.y, row_number() OVER (PARTITION BY a.vec_id ORDER BY round(list_distance(a.x, b.x), 9), b.vec_id) AS rank
   FROM s a JOIN s b ON a.test AND NOT b.test) WHERE rank <= 3)
SELECT vec_id, label, round(avg(y), 6) AS prob, CAST(avg(y) > 0.5 AS INTEGER) AS prediction FROM near GROUP BY ALL""")
def knn(spark, d):
    e = table(spark, d, "embeddings").select("vec_id", (F.col("label") >= 5).cast("int").alias("label"),
                                             array_to_vector(F.col("embedding").cast("array<double>")).alias("features"))
    parts = holdout(e, "label", ["vec_id"])
    out = L.knn_classifier(parts.where("split = 'train'"), parts.where("split = 'test'"), "vec_id")
    return out.select("vec_id", "label", F.round("prob", 6).alias("prob"), "prediction")


@query("L7_line_classifier")
def line_classifier(spark, d):
    """Weighted logistic regression over bag of words, scored on the held-out rows."""
    files = materialize(holdout(R.file_changes(spark, d), "label", ["file_name"]).select("label", "file_name", "code", "split"))
    train = L.balanced_weights(files.where(F.col("split") == "train"))
    model = S.text_model(spark, f"{scratch_dir(spark)}/line", S.Bags.of(train, "code"), "weight")
    test = files.where(F.col("split") == "test").select("label", "file_name", "code")
    scored = L.scored(model.transform(S.Bags.of(test, "code")), "file_name")
    return L.evaluate(scored.withColumn("Technique", F.lit("line")).withColumn("Datasets", F.lit("all")))


query("L8_compare_models")(sparse_metrics_of(*L.TECHNIQUES))
