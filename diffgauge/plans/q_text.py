"""Sources and sinks (A), scalar functions (B), predicates (C)."""

from __future__ import annotations

from pyspark.sql import functions as F, types as T


from diffgauge.functions import nested as S, numbers as N, text as X, words as W
from diffgauge.operators import attribution as K, changes as J, file_study as FS, models as L, tokens as TK
from diffgauge.operators.ranks import number_rows
from diffgauge.plans import roles as R
from diffgauge.plans.registry import query
from diffgauge.plans.roles import with_ctes
from diffgauge.session import materialize, scratch_dir
from diffgauge.sources import readers, writers
from diffgauge.sources.readers import table

TALK = T.StructType([T.StructField("conv_id", T.LongType()), T.StructField("turn", T.LongType()),
                     T.StructField("role", T.StringType()), T.StructField("text", T.StringType())])


# --- A: sources and sinks ------------------------------------------------------

@query("A1_csv_scan", "SELECT conv_id, turn, role, text FROM conversations")
def csv_scan(spark, d):
    path = scratch_dir(spark)
    writers.csv(table(spark, d, "conversations", TALK.names), path)
    return readers.csv(spark, path, TALK)


@query("A2_csv_projection", "SELECT conv_id, role FROM conversations")
def csv_projection(spark, d):
    path = scratch_dir(spark)
    writers.csv(table(spark, d, "conversations", TALK.names), path)
    return readers.csv(spark, path, TALK, ["conv_id", "role"])      # the texts beside them hold newlines


@query("A3_headerless_csv", "SELECT event_id AS line_id, value AS entropy FROM events")
def headerless(spark, d):
    path = scratch_dir(spark)
    table(spark, d, "events", ["event_id", "value"]).write.csv(path)
    return readers.entropies(spark, path)


@query("A4_csv_rows_by_position", with_ctes("""
SELECT row_id, label, change_id, raw_code, ref FROM review_raw""", "review_raw"))
def rows_by_position(spark, d):
    path = scratch_dir(spark)
    raw = R.review_raw(spark, d).select("row_id", "label", "change_id", "raw_code", "ref")
    writers.csv(raw, path)
    back = readers.csv(spark, path, raw.schema, newlines=False)     # a line of code each
    # an empty field reads back as null
    return back.withColumn("raw_code", F.coalesce("raw_code", F.lit("")))


LOOKUP_SQL = """
SELECT row_id, r.change_id, r.file_dir, patch_set AS base_patch, CAST(min(found) AS INTEGER) AS found_patch
FROM (SELECT *, CAST(string_split(ref, '/')[5] AS INTEGER) AS patch_set FROM review_raw WHERE label <> 0) r
LEFT JOIN (SELECT DISTINCT change_id, file_dir, base_patch, patch_set AS found FROM diff_side) x
  ON x.change_id = r.change_id AND x.file_dir = r.file_dir AND x.base_patch = r.patch_set
 AND x.found BETWEEN r.patch_set + 1 AND r.patch_set + 3
GROUP BY ALL"""


@query("A5_diff_lookup", with_ctes(LOOKUP_SQL, "review_raw", "diff_side"))
def diff_lookup(spark, d):
    rows = J.parse_raw(R.review_raw(spark, d)).where(F.col("label") != 0)
    return J.lookup(rows, R.review_diffs(spark, d)).select(
        "row_id", "change_id", "file_dir", "base_patch", "found_patch")


@query("A6_range_buckets", """
SELECT o_orderkey, big_lo, big_lo + 9999 AS big_hi, small_lo, small_lo + 199 AS small_hi
FROM (SELECT o_orderkey, CAST(floor((o_orderkey - 1)::DOUBLE / 10000) * 10000 + 1 AS BIGINT) AS big_lo,
             CAST(floor((o_orderkey - 1)::DOUBLE / 200) * 200 + 1 AS BIGINT) AS small_lo FROM orders)""")
def range_buckets(spark, d):
    o = table(spark, d, "orders", ["o_orderkey"])
    big = X.range_bucket("o_orderkey", writers.BIG_STEP)
    small = X.range_bucket("o_orderkey", writers.SMALL_STEP)
    return o.select("o_orderkey", big["lo"].alias("big_lo"), big["hi"].alias("big_hi"),
                    small["lo"].alias("small_lo"), small["hi"].alias("small_hi"))


@query("A6_diffs_of_asked_changes", """
SELECT o_orderkey AS change_num, o_custkey, CAST(floor((o_orderkey - 1)::DOUBLE / 200) * 200 + 1 AS BIGINT) AS small_lo
FROM orders WHERE o_orderkey >= 1 AND o_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_quantity >= 49 AND l_tax = 0 AND l_discount = 0)""")
def diffs_of_asked(spark, d):
    """All orders under their range buckets; those that big lines without tax and discount name, from the buckets they lie in."""
    path = scratch_dir(spark)
    writers.diffs_by_range(table(spark, d, "orders", ["o_orderkey", "o_custkey"]).withColumnRenamed("o_orderkey", "change_num"), path)
    asked = table(spark, d, "lineitem", ["l_orderkey", "l_quantity", "l_tax", "l_discount"]).where(
        (F.col("l_quantity") >= 49) & (F.col("l_tax") == 0) & (F.col("l_discount") == 0))
    return readers.diffs_of(spark, path, asked.select(F.col("l_orderkey").alias("change_num"))).select(
        "change_num", "o_custkey", "small_lo")


@query("A7_nested_diff_json", with_ctes("""
SELECT change_id, CAST(base_patch AS INTEGER) AS base_patch, CAST(chunk AS INTEGER) AS chunk, side, len(lines) AS n_lines, block
FROM diff_side""", "diff_side"))
def nested_json(spark, d):
    path = scratch_dir(spark)
    R.review_diffs(spark, d).write.json(path)
    sides = J.chunk_sides(readers.review_diffs(spark, path))
    return sides.select("change_id", "base_patch", "chunk", "side", F.size("lines").cast("long").alias("n_lines"), "block")


@query("A8_csv_append", "SELECT o_orderkey, o_orderstatus, o_totalprice FROM orders")
def csv_append(spark, d):
    path = scratch_dir(spark)
    o = table(spark, d, "orders", ["o_orderkey", "o_orderstatus", "o_totalprice"])
    writers.csv(o.where(F.col("o_orderstatus") == "F"), path)
    writers.csv(o.where(F.col("o_orderstatus") != "F"), path)
    return readers.csv(spark, path, o.schema, newlines=False)


@query("A9_unquoted_csv", """
SELECT p_partkey, p_name || ',' || p_type || ';' || p_brand AS label, p_retailprice FROM part""")
def unquoted(spark, d):
    path = scratch_dir(spark)
    p = table(spark, d, "part").select(
        "p_partkey", F.concat("p_name", F.lit(","), "p_type", F.lit(";"), "p_brand").alias("label"), "p_retailprice")
    writers.plain_csv(p, path)
    return readers.plain_csv(spark, path, p.schema)


# --- J1/A10 share the labelled table -------------------------------------------

JOINED = """
located AS (
  SELECT r.row_id, x.chunk, x.side, x.lines, x.new_lines, r.needle,
         coalesce(list_position(list_transform(x.lines, lambda l: contains(l, r.needle)), true), 0) AS place
  FROM live r JOIN diff_side x ON x.change_id = r.change_id AND x.file_dir = r.file_dir
   AND x.base_patch = r.patch_set AND x.patch_set <= r.patch_set + 3 AND contains(x.block, r.needle)),
ctx AS (
  SELECT *, CASE WHEN side = 'a' AND place >= 1 AND (new_lines IS NULL OR new_lines[place] IS NOT NULL) THEN
      (CASE WHEN place = 1 THEN '' ELSE coalesce(new_lines[place - 1], '') END) || '\\n' ||
      (CASE WHEN new_lines IS NULL THEN '' ELSE new_lines[place] END) || '\\n' || coalesce(new_lines[place + 1], '') END AS after,
    CASE WHEN side = 'a' AND place >= 1 THEN lines[place] END AS old_line
  FROM located),
hit0 AS (SELECT *, side = 'a' AND after IS NULL AS broken FROM ctx),
hits AS (SELECT * FROM (SELECT *, bool_or(broken) OVER (PARTITION BY row_id, chunk) AS stop FROM hit0)
         WHERE NOT (stop AND side = 'b')),
result AS (
  SELECT row_id, 0 AS label, 0 AS status, raw_code AS before_code, NULL AS after_code, 'ok' AS outcome
  FROM review_raw WHERE label = 0
  UNION ALL
  SELECT row_id, NULL, NULL, raw_code, NULL, CASE WHEN needle = '' THEN 'empty_needle' ELSE 'missed_diff' END
  FROM wanted WHERE needle = '' OR NOT found
  UNION ALL
  SELECT h.row_id, CASE WHEN broken THEN NULL WHEN side = 'a' THEN 1 ELSE 0 END,
         CASE WHEN broken THEN NULL WHEN side = 'a' THEN 1 ELSE 2 END,
         coalesce(old_line, raw_code), after, CASE WHEN broken THEN 'not_found' ELSE 'ok' END
  FROM hits h JOIN live USING (row_id)
  UNION ALL
  SELECT row_id, NULL, NULL, raw_code, NULL,
         CASE WHEN any_new IS NULL THEN 'no_match' ELSE 'double' END
  FROM live LEFT JOIN (SELECT row_id, bool_or(side <> 'a') AS any_new, bool_or(side = 'a' AND NOT broken) AS good_old
                       FROM hits GROUP BY row_id) USING (row_id)
  WHERE any_new IS NULL OR (any_new AND good_old))
"""
LIVE = """
wanted AS (
  SELECT w.*, EXISTS (SELECT 1 FROM diff_side x WHERE x.change_id = w.change_id AND x.file_dir = w.file_dir
     AND x.base_patch = w.patch_set AND x.patch_set BETWEEN w.patch_set + 1 AND w.patch_set + 3) AS found
  FROM (SELECT *, CAST(string_split(ref, '/')[5] AS INTEGER) AS patch_set,
               regexp_replace(raw_code, '^\\++', '') AS needle FROM review_raw WHERE label <> 0) w),
live AS (SELECT * FROM wanted WHERE found AND needle <> ''),"""


def classified_sql(body: str) -> str:
    return with_ctes("", "review_raw", "diff_side").rstrip() + "," + LIVE + JOINED + body


@query("A10_quarantine_sink", classified_sql("SELECT outcome, count(*) AS n FROM result GROUP BY outcome"))
def quarantine(spark, d):
    path = scratch_dir(spark)
    writers.by_outcome(J.classify(R.review_raw(spark, d), R.review_diffs(spark, d)), path)
    return spark.read.parquet(path).groupBy("outcome").agg(F.count(F.lit(1)).alias("n"))


@query("A11_outcome_records", with_ctes("""
SELECT k, outcome, row_id, row_number() OVER (PARTITION BY k, outcome ORDER BY split_part(row_id, ':', 1)::BIGINT, split_part(row_id, ':', 2)::BIGINT) AS log_number, n_common
FROM routed WHERE outcome IN ('positive', 'negative')""", "routed"))
def outcome_records(spark, d):
    part = F.split("row_id", ":")
    rows = R.routed(spark, d).withColumns({"conv_id": part[0].cast("long"), "turn": part[1].cast("long")})
    numbered = writers.numbered_records(materialize(rows), "conv_id", ["turn"])
    return numbered.select("k", "outcome", "row_id", "log_number", "n_common")


@query("A12_log_corpus", with_ctes("""
SELECT row_id, k, before_code AS before, after_code AS after, array_to_string(changed, '|') AS changed,
       array_to_string(suggested, '|') AS suggestion
FROM routed WHERE outcome IN ('positive', 'negative')""", "routed"))
def log_corpus(spark, d):
    routed = R.routed(spark, d).where(F.col("outcome").isin("positive", "negative"))
    text = routed.select("row_id", "k", X.log_record("before_code", "after_code", "changed", "suggestion").alias("log"))
    parts = readers.parse_log(F.col("log"))
    return text.select("row_id", "k", parts["before"].alias("before"), parts["after"].alias("after"),
                       F.array_join(parts["changed"], "|").alias("changed"),
                       F.array_join(parts["suggestion"], "|").alias("suggestion"))


TOKEN_SCORES = """
SELECT k, common, changed, suggested, common::DOUBLE / nullif(changed, 0) AS recall, common::DOUBLE / nullif(suggested, 0) AS precision
FROM (SELECT k, CAST(sum(n_common) FILTER (WHERE outcome IN ('positive', 'negative')) AS BIGINT) AS common,
             CAST(sum(n_changed) FILTER (WHERE outcome IN ('positive', 'negative')) AS BIGINT) AS changed,
             CAST(sum(n_suggested) AS BIGINT) AS suggested FROM routed GROUP BY k)"""


@query("A13_score_text", with_ctes(f"""
SELECT k, unnest(['top_' || k || '_recall : ' || printf('%.3f', recall),
                  'top_' || k || '_precision : ' || printf('%.3f', precision),
                  'top_' || k || '_F1_Score : ' || printf('%.3f', 2 * recall * precision / (recall + precision))]) AS text
FROM ({TOKEN_SCORES})""", "routed"))
def score_text(spark, d):
    return writers.scores_text(TK.token_scores_at_k(R.routed(spark, d)))


@query("A14_model_cache")
def model_cache(spark, d):
    bags = FS.Bags.of(R.file_changes(spark, d), "code", ["deletions", "additions", "changed_line"])
    path = f"{scratch_dir(spark)}/lg-demo-2-0"
    FS.text_model(spark, path, bags)
    model = FS.text_model(spark, path, bags)     # the second call loads
    return L.scored(model.transform(bags), "file_name").select(
        "file_name", "label", F.round("prob", 4).alias("prob"), "prediction")


# --- B: scalar functions --------------------------------------------------------

@query("B1_ref_parse", with_ctes("""
SELECT row_id, CAST(string_split(ref, '/')[4] AS INTEGER) AS change_num, CAST(string_split(ref, '/')[5] AS INTEGER) AS patch_set
FROM review_raw""", "review_raw"))
def ref_parse(spark, d):
    return J.parse_raw(R.review_raw(spark, d)).select("row_id", "change_num", "patch_set")


@query("B2_strip_plus", with_ctes(
    r"SELECT row_id, regexp_replace(raw_code, '^\++', '') AS needle FROM review_raw", "review_raw"))
def strip_plus(spark, d):
    return R.review_raw(spark, d).select("row_id", X.strip_plus("raw_code").alias("needle"))


@query("B3_percent_encode", "SELECT page_id, url_encode(url || ' ~*' || html) AS encoded FROM pages")
def percent_encode(spark, d):
    return table(spark, d, "pages").select("page_id", X.percent_encode(F.concat("url", F.lit(" ~*"), "html")).alias("encoded"))


PLACED = "regexp_replace(code, '[0-9]+', '<NUMBER>', 'g')"


def _placed():
    return F.regexp_replace("code", "[0-9]+", X.NUMBER_PLACEHOLDER)


@query("B4_sequence_markers", with_ctes(f"""
SELECT fileName, lineNumber, '<s> ' || replace({PLACED}, '<NUMBER>', 'NUM') || ' </s>' AS train_form,
       '<s> ' || replace({PLACED}, '<NUMBER>', 'NUM') || '</s>' AS score_form
FROM code_line""", "code_line"))
def sequence_markers(spark, d):
    return R.code_lines(spark, d).select("fileName", "lineNumber", X.with_markers(_placed()).alias("train_form"),
                                         X.with_markers(_placed(), spaced_end=False).alias("score_form"))


@query("B5_digit_mask", with_ctes(
    "SELECT row_id, regexp_replace(before_code, '[0-9]+', 'NUM', 'g') AS masked FROM pair", "pair"))
def digit_mask(spark, d):
    return R.pairs(spark, d).select("row_id", X.mask_digits("before_code").alias("masked"))


@query("B6_drop_placeholder", with_ctes(
    f"SELECT fileName, lineNumber, replace({PLACED}, '<NUMBER>', '') AS code FROM code_line", "code_line"))
def drop_placeholder(spark, d):
    return R.code_lines(spark, d).select("fileName", "lineNumber", X.drop_placeholder(_placed()).alias("code"))


@query("B7_tokens_per_line", with_ctes(
    "SELECT fileName, lineNumber, CAST(len(string_split(code, ' ')) - 1 AS INTEGER) AS n_tokens FROM code_line", "code_line"))
def tokens_per_line(spark, d):
    return R.code_lines(spark, d).select("fileName", "lineNumber", X.tokens_per_line("code").alias("n_tokens"))


@query("B8_words_per_line", with_ctes(
    f"SELECT fileName, lineNumber, CAST(len({R.words_sql('code')}) AS INTEGER) AS n_words FROM code_line", "code_line"))
def words_per_line(spark, d):
    return R.code_lines(spark, d).select("fileName", "lineNumber", X.words_per_line("code").alias("n_words"))


@query("B9_unescape_newlines", """
SELECT conv_id, turn, replace(replace(text, chr(10), '\\n'), '\\n', chr(10)) AS text FROM conversations""")
def unescape(spark, d):
    escaped = F.replace(F.col("text"), F.lit("\n"), F.lit("\\n"))
    return table(spark, d, "conversations").select("conv_id", "turn", X.unescape_newlines(escaped).alias("text"))


@query("B10_label_recode", "SELECT doc_id, quality <> 0 AS good, toxic <> 0 AS toxic FROM labels")
def label_recode(spark, d):
    return table(spark, d, "labels").select("doc_id", X.label_flag("quality").alias("good"), X.label_flag("toxic").alias("toxic"))


@query("B11_line_tokens", with_ctes(
    "SELECT fileName, lineNumber, count(*) AS n, min(token) AS first, max(token) AS last FROM line_token GROUP BY ALL", "line_token"))
def line_tokens(spark, d):
    return (R.code_lines(spark, d).withColumn("t", X.line_tokens("code")).where(F.size("t") > 0)
            .select("fileName", "lineNumber", F.size("t").cast("long").alias("n"),
                    F.array_min("t").alias("first"), F.array_max("t").alias("last")))


@query("B12_punctuation_break", with_ctes("""
SELECT row_id, CAST(pos AS INTEGER) AS pos, CASE WHEN cut THEN 'Ġ' || piece ELSE piece END AS piece FROM (
  SELECT *, coalesce(lag(punct) OVER (PARTITION BY row_id ORDER BY pos), false) AS cut FROM (
    SELECT *, regexp_full_match(piece, '[[:punct:]]*') AS punct FROM piece WHERE piece <> 'Ġ'))
WHERE NOT punct""", "piece"))
def punctuation_break(spark, d):
    return TK.break_after_punctuation(R.pieces(spark, d)).select("row_id", "pos", "piece")


@query("B13_drop_punctuated", with_ctes(
    "SELECT fileName, lineNumber, token FROM line_token WHERE NOT regexp_matches(token, '[[:punct:]]')", "line_token"))
def drop_punctuated(spark, d):
    return R.line_tokens(spark, d).where(~X.has_punctuation("token")).select("fileName", "lineNumber", "token")


@query("B14_merge_subwords", with_ctes("SELECT row_id, CAST(pos AS INTEGER) AS pos, token, score FROM merged_word", "merged_word"))
def merge_subwords(spark, d):
    return TK.merge_subwords(R.pieces(spark, d))


@query("B15_clean_scores", with_ctes("SELECT row_id, token, score, CAST(pos AS INTEGER) AS pos FROM clean_word", "clean_word"))
def clean_scores(spark, d):
    return TK.clean_scores(TK.merge_subwords(R.pieces(spark, d)))


@query("B16_strip_quotes", "SELECT page_id, translate(html, '\"''', '') AS html FROM pages")
def strip_quotes(spark, d):
    return table(spark, d, "pages").select("page_id", X.strip_quotes("html").alias("html"))


@query("B17_fixed_window", with_ctes(f"""
SELECT fileName, lineNumber, least(n, 128) AS used, greatest(128 - n, 0) AS padded,
       list_sum(list_transform(w[1:128], lambda x: length(x)))::BIGINT + greatest(128 - n, 0) AS id_sum
FROM (SELECT fileName, lineNumber, {R.words_sql('code')} AS w, len({R.words_sql('code')}) AS n FROM code_line) WHERE n > 0""", "code_line"))
def fixed_window(spark, d):
    ids = F.transform(X.line_words("code"), lambda w: F.length(w))
    w = R.code_lines(spark, d).withColumn("ids", ids).where(F.size("ids") > 0).withColumn("w", X.fixed_window("ids"))
    total = lambda c: F.aggregate(c, F.lit(0).cast("long"), lambda a, x: a + x)
    return w.select("fileName", "lineNumber", total("w.attention_mask").alias("used"),
                    (F.size("w.input_ids") - total("w.attention_mask")).alias("padded"), total("w.input_ids").alias("id_sum"))


@query("B18_sigmoid_threshold", """
SELECT event_id, round(1 / (1 + exp(-(value - 50) / 10)), 6) AS p, CAST(1 / (1 + exp(-(value - 50) / 10)) > 0.5 AS INTEGER) AS y FROM events""")
def sigmoid(spark, d):
    p = N.sigmoid((F.col("value") - 50) / 10)
    return table(spark, d, "events", ["event_id", "value"]).select("event_id", F.round(p, 6).alias("p"), N.above(p).alias("y"))


@query("B19_two_columns", with_ctes(
    "SELECT epoch, row_id, round(1 - prob, 9) AS p0, round(prob, 9) AS p1 FROM prediction", "prediction"))
def two_columns(spark, d):
    return (R.predictions(spark, d).withColumn("p", N.two_columns("prob"))
            .select("epoch", "row_id", F.round("p.p0", 9).alias("p0"), F.round("p.p1", 9).alias("p1")))


def _escape_xml(c):
    return F.replace(F.replace(c, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;"))


def _tags(lines, name):
    body = F.transform(lines, lambda x: F.concat(F.lit(f"<{name}>"), _escape_xml(x), F.lit(f"</{name}>")))
    return F.array_join(body, "")


def diff_xml(spark, d, whole=False):
    """row_id, xml: the old lines as deleted names, kept words as common names.

    One turn in seven is left broken on purpose, for the queries that sort broken rows out; ``whole`` breaks none.
    """
    p = R.pairs(spark, d)
    old, new = F.split("before_code", r"\s+"), F.split("after_code", r"\s+")
    words = p.select("row_id", (F.expr(R.TURN_NUMBER) % 7 == 3).alias("broken"), old.alias("o"), new.alias("n"))
    gone = F.filter("o", lambda x: (x != "") & ~F.array_contains(F.col("n"), x))
    kept = F.filter("o", lambda x: (x != "") & F.array_contains(F.col("n"), x))
    added = F.filter("n", lambda x: (x != "") & ~F.array_contains(F.col("o"), x))
    tail = F.lit("</unit>") if whole else F.when(F.col("broken"), "</unit").otherwise("</unit>")
    return words.select("row_id", F.concat(
        F.lit('<unit xmlns:diff="urn:d"><diff:delete>'), _tags(gone, "name"),
        F.lit("<diff:common>"), _tags(kept, "name"), F.lit("</diff:common></diff:delete><diff:insert>"),
        _tags(added, "name"), F.lit("</diff:insert>"), tail).alias("xml"))


R.CTES["xml_word"] = (("pair",), f"""
  SELECT row_id, broken, list_filter(o, lambda x: x <> '' AND NOT list_contains(n, x)) AS gone,
         list_filter(o, lambda x: x <> '' AND list_contains(n, x)) AS kept,
         list_filter(n, lambda x: x <> '' AND NOT list_contains(o, x)) AS added
  FROM (SELECT row_id, ({R.TURN_NUMBER}) % 7 = 3 AS broken, string_split_regex(before_code, '\\s+') AS o, string_split_regex(after_code, '\\s+') AS n
        FROM pair)""")


@query("B20_search_key", with_ctes("""
SELECT row_id, CAST(len(gone) + len(kept) + len(added) AS INTEGER) AS n_names,
       array_to_string(list_concat(gone, kept, added), ' ') AS names
FROM xml_word WHERE NOT broken""", "xml_word"))
def search_key(spark, d):
    xml = diff_xml(spark, d).where(S.is_wellformed("xml"))
    return xml.withColumn("f", S.search_key("xml", "name")).select(
        "row_id", F.size("f").alias("n_names"), F.array_join("f", " ").alias("names"))


@query("B21_remove_key", with_ctes("""
SELECT row_id, array_to_string(list_concat(gone, added), ' ') AS names
FROM xml_word WHERE NOT broken""", "xml_word"))
def remove_key(spark, d):
    xml = diff_xml(spark, d).where(S.is_wellformed("xml"))
    return xml.select("row_id", F.array_join(S.texts_without("xml", "diff:common"), " ").alias("names"))


@query("B22_flatten_lists", """
SELECT conv_id, turn, len(flatten(list_transform(string_split(text, chr(10)), lambda l: string_split(l, ' ')))) AS n,
       array_to_string(flatten(list_transform(string_split(text, chr(10)), lambda l: string_split(l, ' '))), '|') AS flat
FROM conversations""")
def flatten_lists(spark, d):
    nested = F.transform(F.split("text", "\n"), lambda line: F.split(line, " "))
    flat = S.flatten_levels(nested, 1)
    return table(spark, d, "conversations").select("conv_id", "turn", F.size(flat).cast("long").alias("n"),
                                                   F.array_join(flat, "|").alias("flat"))


def uneven_lists(spark, d):
    """conv_id, turn, depth, nested: the words of a turn as a JSON list, its i-th line i % 6 levels deeper than a flat one."""
    def line(words, i):
        more = (i % 6).cast("int")
        return F.concat(F.repeat(F.lit("["), more), F.to_json(F.split(words, " ")), F.repeat(F.lit("]"), more))
    lines = F.transform(F.split("text", "\n"), line)
    return table(spark, d, "conversations").select(
        "conv_id", "turn", (F.least(F.size(lines), F.lit(6)) + 1).alias("depth"),
        F.concat(F.lit("["), F.array_join(lines, ", "), F.lit("]")).alias("nested"))


@query("B22_flatten_any_depth", """
SELECT conv_id, turn, CAST(least(len(lines), 6) + 1 AS INTEGER) AS depth, len(flatten(list_transform(lines, lambda l: string_split(l, ' ')))) AS n,
       array_to_string(flatten(list_transform(lines, lambda l: string_split(l, ' '))), '|') AS flat
FROM (SELECT conv_id, turn, string_split(text, chr(10)) AS lines FROM conversations)""")
def flatten_any_depth(spark, d):
    flat = S.flatten_all("nested")
    return uneven_lists(spark, d).select("conv_id", "turn", "depth", F.size(flat).cast("long").alias("n"),
                                         F.array_join(flat, "|").alias("flat"))


# the factor table has a fixed number of levels (nations), whatever the data size
@query("B23_factor_recode", """
SELECT c_custkey, n_name AS factor, n_regionkey AS ord FROM customer JOIN nation ON c_nationkey = n_nationkey""")
def factor_recode(spark, d):
    levels = table(spark, d, "nation").select(F.col("n_nationkey").alias("c_nationkey"), F.col("n_name").alias("factor"),
                                              F.col("n_regionkey").alias("ord"))
    return table(spark, d, "customer", ["c_custkey", "c_nationkey"]).join(F.broadcast(levels), "c_nationkey").select("c_custkey", "factor", "ord")


@query("B24_round_half_even", """
SELECT o_orderkey, CAST(round_even(CAST(o_totalprice AS DECIMAL(18, 2)) / 7, 2) AS DOUBLE) AS share,
       printf('%.1f%%', round_even(o_totalprice / 7000, 1)) AS percent FROM orders""")
def round_half_even(spark, d):
    share = F.col("o_totalprice") / 7
    return table(spark, d, "orders", ["o_orderkey", "o_totalprice"]).select(
        "o_orderkey", F.bround(share, 2).alias("share"),
        F.format_string("%.1f%%", F.bround(F.col("o_totalprice") / 7000, 1)).alias("percent"))


@query("B25_null_fill", """
SELECT o_custkey, coalesce(sum(CASE WHEN o_orderstatus = 'F' THEN o_totalprice END)::DOUBLE * 0 + round(sum(CASE WHEN o_orderstatus = 'F' THEN o_totalprice END), 2), 0.0) AS f_total,
       coalesce((count(*) FILTER (WHERE o_orderstatus = 'F'))::DOUBLE / nullif(count(*) FILTER (WHERE o_orderstatus = 'P'), 0), 0.0) AS f_per_p
FROM orders GROUP BY o_custkey""")
def null_fill(spark, d):
    o = table(spark, d, "orders", ["o_custkey", "o_orderstatus", "o_totalprice"])
    done = F.col("o_orderstatus") == "F"
    return o.groupBy("o_custkey").agg(
        N.fill(F.round(F.sum(F.when(done, F.col("o_totalprice"))), 2)).alias("f_total"),
        N.ratio_or_zero(F.count_if(done), F.count_if(F.col("o_orderstatus") == "P")).alias("f_per_p"))


@query("B27_split_composite", """
SELECT l_orderkey, l_linenumber, l_partkey, string_split(l_returnflag || '.' || l_linestatus, '.')[1] AS technique,
       string_split(l_returnflag || '.' || l_linestatus, '.')[2] AS measure FROM lineitem""")
def split_composite(spark, d):
    li = table(spark, d, "lineitem").withColumn("variable", F.concat_ws(".", "l_returnflag", "l_linestatus"))
    parts = F.split("variable", r"\.")
    return li.select("l_orderkey", "l_linenumber", "l_partkey", parts[0].alias("technique"), parts[1].alias("measure"))


@query("B28_columns_by_suffix", "SELECT l_orderkey, l_partkey, l_suppkey FROM lineitem")
def columns_by_suffix(spark, d):
    li = table(spark, d, "lineitem")
    return li.select([c for c in li.columns if c.endswith("key")])


@query("B29_percent_change", """
SELECT o_orderkey, round((o_totalprice - b) * 100 / b, 6) AS change
FROM (SELECT o_orderkey, o_totalprice, CASE WHEN o_custkey % 100 = 0 THEN 1.0::DOUBLE ELSE o_custkey % 100 END AS b FROM orders)""")
def percent_change(spark, d):
    base = (F.col("o_custkey") % 100).cast("double")
    return table(spark, d, "orders").select("o_orderkey", F.round(N.percent_change("o_totalprice", base), 6).alias("change"))


def _shown_sql(tokens: str) -> str:
    safe = r"replace(t, '\', '\\')"
    return (f"'[' || array_to_string(list_transform({tokens}, lambda t: "
            f"CASE WHEN contains(t, '''') AND NOT contains(t, '\"') THEN '\"' || {safe} || '\"' "
            f"ELSE '''' || replace({safe}, '''', '\\''') || '''' END), ', ') || ']'")


@query("B30_log_record", with_ctes(f"""
SELECT row_id, k, before_code || chr(10) || '#################################' || chr(10) || after_code || chr(10)
  || 'changed_token:' || {_shown_sql('changed')} || chr(10) || 'suggestion:' || {_shown_sql('suggested')} AS log
FROM routed""", "routed"))
def log_record(spark, d):
    return R.routed(spark, d).select("row_id", "k", X.log_record("before_code", "after_code", "changed", "suggestion").alias("log"))


@query("B31_select_rename", """
SELECT event_type AS dataset, value AS initial_feedback_time, user_id AS changed_line FROM events""")
def select_rename(spark, d):
    return table(spark, d, "events").select("event_type", "value", "user_id").withColumnsRenamed(
        {"event_type": "dataset", "value": "initial_feedback_time", "user_id": "changed_line"})


@query("B32_trim_capitalise", """
SELECT r_regionkey, upper(substr(trim(r_name), 1, 1)) || lower(substr(trim(r_name), 2)) AS name FROM region""")
def trim_capitalise(spark, d):
    return table(spark, d, "region").select("r_regionkey", X.capitalise(F.trim("r_name")).alias("name"))


@query("B33_word_codes", with_ctes("""
SELECT token, row_number() OVER (ORDER BY met, token) AS code
FROM (SELECT token, min({'f': fileName, 'l': lineNumber}) AS met FROM line_token GROUP BY token)""", "line_token"))
def word_codes(spark, d):
    """Codes 1.. in the order the words are first met, numbered per range of lines."""
    met = F.min(F.struct("fileName", "lineNumber")).alias("met")
    words = materialize(R.line_tokens(spark, d).groupBy("token").agg(met).select("token", "met.*"))
    return number_rows(words, "fileName", out="code", ties=["lineNumber", "token"]).select("token", F.col("code").cast("long").alias("code"))


# --- C: predicates ---------------------------------------------------------------

@query("C1_label_filter", "SELECT doc_id, toxic FROM labels WHERE quality = 1")
def label_filter(spark, d):
    return table(spark, d, "labels").where(F.col("quality") == 1).select("doc_id", "toxic")


@query("C2_predicted_and_long", with_ctes("""
SELECT fileName, lineNumber, n, n > 7 AS in_summary FROM (
  SELECT fileName, lineNumber, CAST(len(string_split(code, ' ')) - 1 AS INTEGER) AS n, length(code) % 2 AS pred FROM code_line)
WHERE pred = 1 AND n >= 7""", "code_line"))
def predicted_and_long(spark, d):
    lines = R.code_lines(spark, d).select("fileName", "lineNumber", X.tokens_per_line("code").alias("n"),
                                          (F.length("code") % 2).alias("pred"))
    return lines.where((F.col("pred") == 1) & (F.col("n") >= 7)).select("fileName", "lineNumber", "n", (F.col("n") > 7).alias("in_summary"))


@query("C3_true_positives", with_ctes(
    "SELECT epoch, row_id FROM prediction WHERE label = 1 AND prob > 0.5", "prediction"))
def true_positives(spark, d):
    p = R.predictions(spark, d).withColumn("pred", N.above("prob"))
    return p.where((F.col("pred") == F.col("label")) & (F.col("label") == 1)).select("epoch", "row_id")


@query("C4_positive_scores", with_ctes("""
SELECT fileName, lineNumber, token, round(limeScore, 9) AS limeScore FROM token_score WHERE limeScore > 0""", "token_score"))
def positive_scores(spark, d):
    return (R.scored_tokens(spark, d).where("limeScore > 0")
            .select("fileName", "lineNumber", "token", F.round("limeScore", 9).alias("limeScore")))


@query("C5_membership", "SELECT event_id, event_type FROM events WHERE event_type IN ('click', 'error')")
def membership(spark, d):
    return table(spark, d, "events", ["event_id", "event_type"]).where(F.col("event_type").isin("click", "error"))


def word_rows() -> str:
    values = []
    for lang, words in W.KEYWORDS.items():
        for w in dict.fromkeys([*W.NUMERIC_FEATURES, *W.ENGLISH, *words]):
            values.append(f"('{lang}', '{w}')")
    return "(VALUES " + ", ".join(values) + ") AS stop(language, token)"


@query("C6_stop_words", with_ctes(f"""
SELECT DISTINCT fileName, token FROM (
  SELECT fileName, token, CASE WHEN dataset = 'en' THEN 'python' ELSE 'c' END AS language FROM line_token) t
WHERE NOT EXISTS (SELECT 1 FROM {word_rows()} WHERE stop.language = t.language AND stop.token = t.token)""", "line_token"))
def stop_words(spark, d):
    tokens = R.line_tokens(spark, d).select(
        "fileName", "token", F.when(F.col("dataset") == "en", "python").otherwise("c").alias("language")).distinct()
    return K.without_stop_words(tokens, W.stop_words(spark)).select("fileName", "token")


R.CTES["needle"] = ((), """
  SELECT conv_id, turn, parts, string_split(parts[len(parts)], ' ')[1] AS needle
  FROM (SELECT conv_id, turn, string_split(text, chr(10)) AS parts FROM conversations)""")


def _needles(spark, d):
    c = table(spark, d, "conversations").withColumn("parts", F.split("text", "\n"))
    return c.withColumn("needle", F.split(F.element_at("parts", -1), " ")[0])


@query("C7_block_contains", with_ctes("""
SELECT conv_id, turn, contains(array_to_string(parts, ''), needle) AS inside,
       contains(array_to_string(parts[2:], ''), 'e' || needle) AS glued FROM needle""", "needle"))
def block_contains(spark, d):
    rest = F.slice("parts", F.lit(2), F.size("parts"))
    return _needles(spark, d).select("conv_id", "turn", X.block_contains("parts", "needle").alias("inside"),
                                     X.block_contains(rest, F.concat(F.lit("e"), "needle")).alias("glued"))


@query("C8_first_line_with", with_ctes("""
SELECT conv_id, turn, CAST(coalesce(list_position(list_transform(parts, lambda l: contains(l, needle)), true), 0) AS INTEGER) AS at
FROM needle""", "needle"))
def first_line_with(spark, d):
    return _needles(spark, d).select("conv_id", "turn", X.first_line_with("parts", "needle").alias("at"))


@query("C9_drop_empty", with_ctes("""
SELECT fileName, lineNumber, count(*) AS n FROM (
  SELECT fileName, lineNumber, unnest(string_split(code, ' ')) AS token FROM code_line) WHERE token <> '' GROUP BY ALL""", "code_line"))
def drop_empty(spark, d):
    tokens = F.filter(F.split("code", " "), lambda t: t.isNotNull() & (t != ""))
    return (R.code_lines(spark, d).select("fileName", "lineNumber", F.size(tokens).cast("long").alias("n"))
            .where("n > 0"))


@query("C10_per_project", with_ctes("SELECT dataset, fileName, lineNumber FROM code_line WHERE dataset = 'fr'", "code_line"))
def per_project(spark, d):
    return R.code_lines(spark, d).where(F.col("dataset") == "fr").select("dataset", "fileName", "lineNumber")
