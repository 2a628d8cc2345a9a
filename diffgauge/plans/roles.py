"""The given tables in the roles of the review data, for Spark and as SQL CTEs.

Each role has a function (DataFrame) and an entry in ``CTES`` (the same rows as
DuckDB SQL, for the oracles).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from diffgauge.functions import text as X
from diffgauge.operators import sweep
from diffgauge.operators.attribution import explode_tokens, token_scores
from diffgauge.operators.joins import measured_lookup
from diffgauge.operators.sampling import class_counts
from diffgauge.session import materialize, spread
from diffgauge.sources.readers import table

CTES: dict[str, tuple[tuple[str, ...], str]] = {}
FILE = ["dataset", "changeId", "fileName"]


def with_ctes(body: str, *names: str) -> str:
    """Prefix a SELECT with the named CTEs and all they depend on."""
    order: list[str] = []

    def add(name: str) -> None:
        if name in order:
            return
        for need in CTES[name][0]:
            add(need)
        order.append(name)
    for n in names:
        add(n)
    return "WITH " + ",\n".join(f"{n} AS ({CTES[n][1]})" for n in order) + "\n" + body


STRIP = "regexp_replace({0}, '^\\s+|\\s+$', '', 'g')"


def words_sql(c: str) -> str:
    body = STRIP.format(c)
    return f"(CASE WHEN {body} = '' THEN [] ELSE string_split_regex({body}, '\\s+') END)"


# --- lines of the documents ------------------------------------------------

def code_files(spark: SparkSession, d: str) -> DataFrame:
    """dataset, changeId, fileName, code: every text."""
    docs = spread(table(spark, d, "documents", ["doc_id", "lang", "source", "text"]))
    return docs.select(F.col("lang").alias("dataset"), F.col("source").alias("changeId"),
                       F.col("doc_id").alias("fileName"), F.col("text").alias("code"))


def lines_of(files: DataFrame) -> DataFrame:
    """``files`` by line: lineNumber and code instead of the whole code."""
    keep = [c for c in files.columns if c not in (*FILE, "code")]
    return files.select(*FILE, *keep, F.posexplode(F.split("code", "\n")).alias("_i", "code")) \
        .select(*FILE, *keep, (F.col("_i") + 1).alias("lineNumber"), "code")


def code_lines(spark: SparkSession, d: str) -> DataFrame:
    """dataset, changeId, fileName, lineNumber, code: every line of every text."""
    return lines_of(code_files(spark, d))


CTES["code_line"] = ((), """
  SELECT lang AS dataset, source AS changeId, doc_id AS fileName,
         CAST(generate_subscripts(string_split(text, chr(10)), 1) AS INTEGER) AS lineNumber,
         unnest(string_split(text, chr(10))) AS code
  FROM documents""")

CTES["line_token"] = (("code_line",), f"""
  SELECT dataset, changeId, fileName, lineNumber, unnest(list_distinct({words_sql('lower(code)')})) AS token
  FROM code_line""")


def line_tokens(spark: SparkSession, d: str) -> DataFrame:
    return explode_tokens(code_lines(spark, d))


def token_weights(spark: SparkSession, d: str) -> DataFrame:
    """(token, weight): share of the good labelled files with the token minus its
    share of the other labelled files."""
    labels = table(spark, d, "labels", ["doc_id", "quality"])
    docs = spread(table(spark, d, "documents", ["doc_id", "text"]))
    words = F.array_distinct(X.line_words(F.lower("text")))
    # two numbers a row: below the bound the texts stay where they are
    known = measured_lookup(docs, labels, ["doc_id"], "inner", most_rows=2_000_000).select("quality", F.explode(words).alias("token"))
    per = known.groupBy("token").agg(F.count_if(F.col("quality") == 1).alias("n1"),
                                     F.count_if(F.col("quality") == 0).alias("n0"))
    # the two class sizes are plain numbers
    totals = class_counts(labels.join(table(spark, d, "documents", ["doc_id"]), "doc_id", "left_semi"), "quality")
    good, bad = float(totals.get(1, 0)), float(totals.get(0, 0))
    return per.select("token", (F.col("n1") / F.lit(good) - F.col("n0") / F.lit(bad)).alias("weight"))


CTES["token_weight"] = ((), f"""
  SELECT token, (count(*) FILTER (WHERE quality = 1))::DOUBLE / max(t1)
              - (count(*) FILTER (WHERE quality = 0))::DOUBLE / max(t0) AS weight
  FROM (SELECT quality, unnest(list_distinct({words_sql('lower(text)')})) AS token
        FROM documents JOIN labels USING (doc_id)),
       (SELECT count(*) FILTER (WHERE quality = 1) AS t1, count(*) FILTER (WHERE quality = 0) AS t0
        FROM labels WHERE doc_id IN (SELECT doc_id FROM documents))
  GROUP BY token""")


def scored_tokens(spark: SparkSession, d: str) -> DataFrame:
    """dataset, changeId, fileName, lineNumber, token, limeScore."""
    return token_scores(code_lines(spark, d), token_weights(spark, d), ["token"]) \
        .select("dataset", "changeId", "fileName", "lineNumber", "token", "limeScore")


def top_files(spark: SparkSession, d: str, k: int) -> DataFrame:
    """FILE, tops, top: the files' top k tokens by level and in one list. Stored.

    A line's tokens are tokens of its file and their score is the same, so files are scored, not lines, and of
    the scores only the positive ones, which alone can be top.
    """
    weights = token_weights(spark, d).where("weight > 0")
    scored = token_scores(code_files(spark, d), weights, ["token"]).where("limeScore > 0")
    return materialize(sweep.top_levels(scored, k))


def lines_with_tops(spark: SparkSession, d: str, tops: DataFrame) -> DataFrame:
    """FILE, lineNumber, code, tokens and held top tokens of every line, its file's levels: a text meets them before it
    is cut into lines."""
    lines = lines_of(code_files(spark, d).join(tops, FILE, "left"))
    return sweep.with_held(lines.withColumn("tokens", X.line_tokens("code"))).drop("top")


CTES["token_score"] = (("line_token", "token_weight"), """
  SELECT dataset, changeId, fileName, lineNumber, token, coalesce(weight, 0.0) AS limeScore
  FROM line_token LEFT JOIN token_weight USING (token)""")


def scored_lines(spark: SparkSession, d: str) -> DataFrame:
    """The lines with a truth flag and a line score of their own."""
    return code_lines(spark, d).select("dataset", "changeId", "fileName", "lineNumber", *line_score())


def line_score() -> tuple[Column, Column]:
    words = X.words_per_line("code")
    return ((F.length("code") % 3 == 0).cast("int").alias("groundTruth"),
            (F.length("code") / (words + 1) / 2.0).alias("ngramScore"))


CTES["line_score"] = (("code_line",), f"""
  SELECT dataset, changeId, fileName, lineNumber,
         CAST(length(code) % 3 = 0 AS INTEGER) AS groundTruth,
         length(code)::DOUBLE / (len({words_sql('code')}) + 1) / 2.0::DOUBLE AS ngramScore
  FROM code_line""")


# --- lineitem as scored lines ----------------------------------------------

def item_lines(spark: SparkSession, d: str) -> DataFrame:
    """Scored lines at scale: 18 files per supplier, score steps of 0.3."""
    li = table(spark, d, "lineitem", ["l_suppkey", "l_orderkey", "l_linenumber", "l_linestatus",
                                      "l_tax", "l_discount", "l_returnflag"])
    return li.select(F.col("l_linestatus").alias("dataset"), F.col("l_suppkey").alias("changeId"),
                     F.round(F.col("l_tax") * 100).cast("int").alias("fileName"),
                     (F.col("l_discount") * 30).alias("ngramScore"),
                     (F.col("l_returnflag") == "R").cast("int").alias("groundTruth"))


CTES["item_line"] = ((), """
  SELECT l_linestatus AS dataset, l_suppkey AS changeId, CAST(round(l_tax * 100) AS INTEGER) AS fileName,
         l_discount * 30 AS ngramScore, CAST(l_returnflag = 'R' AS INTEGER) AS groundTruth
  FROM lineitem""")


# --- predictions ------------------------------------------------------------

def predictions(spark: SparkSession, d: str) -> DataFrame:
    """epoch, row_id, label, prob: 19 checkpoints over the labelled documents."""
    docs = table(spark, d, "documents", ["doc_id", "n_chars"])
    labels = table(spark, d, "labels", ["doc_id", "quality"])
    return (docs.join(labels, "doc_id")
            .select(F.col("doc_id").alias("row_id"), (1 - F.col("quality")).alias("label"), "n_chars",
                    F.explode(F.sequence(F.lit(0), F.lit(18))).alias("epoch"))
            .select("epoch", "row_id", "label",
                    (F.pmod(F.col("n_chars") * (F.col("epoch") + 7), F.lit(1009)) / 1009.0).alias("prob")))


CTES["prediction"] = ((), """
  SELECT CAST(epoch AS INTEGER) AS epoch, doc_id AS row_id, 1 - quality AS label,
         ((n_chars * (epoch + 7)) % 1009)::DOUBLE / 1009.0::DOUBLE AS prob
  FROM documents JOIN labels USING (doc_id), range(0, 19) AS r(epoch)""")


# --- row ids -----------------------------------------------------------------

def joined_id(*parts) -> Column:
    """One id out of several key columns, as text: any number of turns, lines or documents stays apart."""
    return F.concat_ws(":", *[F.coalesce((F.col(p) if isinstance(p, str) else p).cast("string"), F.lit("")) for p in parts])


# an invented number per turn, for made-up scores and predictions only: it identifies nothing
TURN_NUMBER = "conv_id * 1000 + turn"


# --- before/after pairs out of the conversations ---------------------------

def pairs(spark: SparkSession, d: str) -> DataFrame:
    """row_id, before_code, after_code: each turn and the next one.

    The next turn comes by an equi join on (conversation, turn + 1), so a long
    conversation is not ordered in one task.
    """
    c = table(spark, d, "conversations")
    nxt = c.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("after_code"))
    return (c.join(nxt, ["conv_id", "turn"])
            .select(joined_id("conv_id", "turn").alias("row_id"), "conv_id", "turn",
                    F.col("text").alias("before_code"), "after_code"))


CTES["pair"] = ((), """
  SELECT c.conv_id || ':' || c.turn AS row_id, c.conv_id, c.turn, c.text AS before_code, n.text AS after_code
  FROM conversations c JOIN conversations n ON n.conv_id = c.conv_id AND n.turn = c.turn + 1""")


def review_raw(spark: SparkSession, d: str) -> DataFrame:
    """Raw review lines: every line of every turn, user lines without comment."""
    c = spread(table(spark, d, "conversations"))
    lines = c.select("*", F.posexplode(F.split("text", "\n")).alias("i", "body"))
    plus = F.when(F.col("i") % 5 == 0, "++").when(F.col("i") % 5 == 1, "").otherwise("+")
    return lines.select(
        joined_id("conv_id", "turn", "i").alias("row_id"),
        F.when(F.col("role") == "user", 0).otherwise(1).alias("label"),
        F.concat(F.lit("talk/"), "conv_id", F.lit(" a.txt")).alias("file_dir"),
        F.concat(F.lit("I"), "conv_id").alias("change_id"),
        F.trim("body").alias("code"), F.concat(plus, "body").alias("raw_code"),
        (F.col("i") + 1).alias("line"),
        F.concat(F.lit("refs/changes/"), F.lpad((F.col("conv_id") % 100).cast("string"), 2, "0"), F.lit("/"),
                 "conv_id", F.lit("/"), F.col("turn") + 1).alias("ref"))


CTES["review_raw"] = ((), """
  SELECT conv_id || ':' || turn || ':' || i AS row_id,
         CASE WHEN role = 'user' THEN 0 ELSE 1 END AS label,
         'talk/' || conv_id || ' a.txt' AS file_dir, 'I' || conv_id AS change_id, trim(body) AS code,
         (CASE WHEN i % 5 = 0 THEN '++' WHEN i % 5 = 1 THEN '' ELSE '+' END) || body AS raw_code,
         i + 1 AS line,
         'refs/changes/' || lpad((conv_id % 100)::VARCHAR, 2, '0') || '/' || conv_id || '/' || (turn + 1) AS ref
  FROM (SELECT conv_id, turn, role, CAST(generate_subscripts(string_split(text, chr(10)), 1) - 1 AS INTEGER) AS i,
               unnest(string_split(text, chr(10))) AS body FROM conversations)""")


def review_diffs(spark: SparkSession, d: str) -> DataFrame:
    """Nested diffs between a turn and a later text that keeps every other line.

    Every third diff has no new side; the patch set lies 1..4 ahead.
    """
    p = pairs(spark, d)
    old = F.split("before_code", "\n")
    kept = F.filter(old, lambda x, i: i % 2 == 1)
    new = F.concat(kept, F.split("after_code", "\n"))
    texts = p.select("conv_id", "turn", old.alias("o"), new.alias("n"))
    none = F.lit(None).cast("array<string>")
    first = F.struct(none.alias("a"), none.alias("b"),
                     F.filter("o", lambda x: F.array_contains(F.col("n"), x)).alias("ab"))
    b = F.filter("n", lambda x: ~F.array_contains(F.col("o"), x))
    second = F.struct(F.filter("o", lambda x: ~F.array_contains(F.col("n"), x)).alias("a"),
                      F.when(F.col("turn") % 3 != 2, b).alias("b"), none.alias("ab"))
    return texts.select(
        F.concat(F.lit("I"), "conv_id").alias("change_id"),
        F.concat(F.lit("talk/"), "conv_id", F.lit(" a.txt")).alias("file_dir"),
        (F.col("turn") + 1).cast("int").alias("base_patch"),
        (F.col("turn") + 2 + F.col("turn") % 4).cast("int").alias("patch_set"),
        F.array(first, second).alias("content"))


CTES["diff_side"] = (("pair",), """
  SELECT 'I' || conv_id AS change_id, 'talk/' || conv_id || ' a.txt' AS file_dir,
         turn + 1 AS base_patch, turn + 2 + turn % 4 AS patch_set, chunk, side, lines,
         CASE WHEN side = 'a' AND turn % 3 <> 2 THEN b END AS new_lines, array_to_string(lines, '') AS block
  FROM (SELECT conv_id, turn, b, unnest([0, 1, 1]) AS chunk, unnest(['ab', 'a', 'b']) AS side,
               unnest([ab, a, CASE WHEN turn % 3 <> 2 THEN b END]) AS lines
        FROM (SELECT conv_id, turn, list_filter(o, lambda x: list_contains(n, x)) AS ab,
                     list_filter(o, lambda x: NOT list_contains(n, x)) AS a,
                     list_filter(n, lambda x: NOT list_contains(o, x)) AS b
              FROM (SELECT conv_id, turn, string_split(before_code, chr(10)) AS o,
                           list_concat(list_filter(string_split(before_code, chr(10)), lambda x, i: i % 2 = 0),
                                       string_split(after_code, chr(10))) AS n
                    FROM pair)))
  WHERE lines IS NOT NULL""")


# --- sub-word pieces ---------------------------------------------------------

PIECE = r"( ?[\p{L}\p{N}]{1,4}| ?[^\s\p{L}\p{N}])"


def pieces(spark: SparkSession, d: str) -> DataFrame:
    """row_id, pos, piece, score: each turn as scored sub-word pieces."""
    from diffgauge.operators.tokens import explode_scored
    c = spread(table(spark, d, "conversations"))
    flat = F.concat(F.lit(" "), F.replace(F.col("text"), F.lit("\n"), F.lit(" ")))
    cut = F.transform(F.regexp_extract_all(flat, F.lit(PIECE), 1),
                      lambda p: F.replace(p, F.lit(" "), F.lit(X.WORD_START)))
    rows = c.select(joined_id("conv_id", "turn").alias("row_id"), F.expr(TURN_NUMBER).alias("number"), cut.alias("pieces"))
    scores = F.transform("pieces", lambda p, i: ((F.col("number") + i.cast("long") * 37) % 101) / 100.0)
    return explode_scored(rows.withColumn("scores", scores), "row_id", "pieces", "scores")


CTES["piece"] = ((), f"""
  SELECT row_id, pos, piece, ((number + pos * 37) % 101)::DOUBLE / 100.0::DOUBLE AS score
  FROM (SELECT conv_id || ':' || turn AS row_id, {TURN_NUMBER} AS number, generate_subscripts(p, 1) - 1 AS pos,
               replace(unnest(p), ' ', 'Ġ') AS piece
        FROM (SELECT conv_id, turn, regexp_extract_all(' ' || replace(text, chr(10), ' '), '{PIECE}', 1) AS p
              FROM conversations))""")

CTES["merged_word"] = (("piece",), """
  SELECT row_id, min(pos) AS pos, string_agg(piece, '' ORDER BY pos) AS token, max(score) AS score
  FROM (SELECT *, sum(CASE WHEN starts_with(piece, 'Ġ') OR pos = 0 THEN 1 ELSE 0 END)
                    OVER (PARTITION BY row_id ORDER BY pos) AS w FROM piece)
  GROUP BY row_id, w""")

CTES["clean_word"] = (("merged_word",), """
  SELECT row_id, bare AS token, arg_max(score, pos) AS score, min(pos) AS pos
  FROM (SELECT row_id, pos, score, replace(token, 'Ġ', '') AS bare FROM merged_word
        WHERE token NOT IN ('<s>', '</s>', 'Ġ'))
  GROUP BY row_id, bare""")

CTES["suggestion"] = (("clean_word",), """
  SELECT row_id, token, score, rank FROM (
    SELECT *, row_number() OVER (PARTITION BY row_id ORDER BY score DESC, pos) AS rank FROM clean_word)
  WHERE rank <= 5""")

CTES["changed_token"] = (("pair",), """
  SELECT DISTINCT row_id, regexp_replace(token, '[0-9]+', 'NUM', 'g') AS token FROM (
    SELECT row_id, token, sum(s) AS s FROM (
      SELECT row_id, 1 AS s, unnest(regexp_extract_all(before_code, '([\\p{L}\\p{N}]+)', 1)) AS token FROM pair
      UNION ALL
      SELECT row_id, -1 AS s, unnest(regexp_extract_all(after_code, '([\\p{L}\\p{N}]+)', 1)) AS token FROM pair)
    GROUP BY row_id, token)
  WHERE s > 0""")


def routed(spark: SparkSession, d: str, more_than_n: int = 7, whole: bool = False) -> DataFrame:
    """The token evaluation from pieces and pairs to one outcome per (row, k).

    The length that sets short turns aside is that of the first line, the narrow form, or of the ``whole`` turn.
    """
    from diffgauge.operators import tokens as T
    p = pairs(spark, d)
    rows = p.select("row_id", "before_code", "after_code",
                    X.tokens_per_line("before_code" if whole else F.element_at(F.split("before_code", "\n"), 1)).alias("n_tokens"),
                    (F.col("turn") % 5 != 0).cast("int").alias("y_pred"))
    best = T.suggestions(T.clean_scores(T.merge_subwords(pieces(spark, d))), 5)
    return T.route_rows(rows, best, T.changed_tokens(p), more_than_n=more_than_n)


CTES["routed"] = (("pair", "suggestion", "changed_token"), """
  SELECT row_id, before_code, after_code, k, n_common, n_suggested, n_changed,
         CASE WHEN turn % 5 = 0 THEN 'FN' WHEN n_tokens < 7 THEN 'too_short'
              WHEN n_common > 0 THEN 'positive' ELSE 'negative' END AS outcome, suggested, changed
  FROM (SELECT p.row_id, p.turn, p.before_code, p.after_code, k,
               len(string_split(string_split(p.before_code, chr(10))[1], ' ')) - 1 AS n_tokens,
               coalesce(CAST((SELECT sum(h) FROM hit WHERE hit.row_id = p.row_id AND hit.rank <= k) AS BIGINT), 0) AS n_common,
               (SELECT count(*) FROM suggestion s WHERE s.row_id = p.row_id AND s.rank <= k) AS n_suggested,
               coalesce((SELECT list(token ORDER BY rank) FROM suggestion s WHERE s.row_id = p.row_id AND s.rank <= k), []) AS suggested,
               (SELECT count(*) FROM changed_token c WHERE c.row_id = p.row_id) AS n_changed,
               coalesce((SELECT list(token ORDER BY token) FROM changed_token c WHERE c.row_id = p.row_id), []) AS changed
        FROM pair p, (SELECT unnest([1, 3, 5]) AS k))""")
CTES["hit"] = (("suggestion", "changed_token"), """
  SELECT s.row_id, s.rank, s.token, count(c.token) AS h
  FROM suggestion s LEFT JOIN changed_token c ON c.row_id = s.row_id AND contains(c.token, s.token)
  GROUP BY s.row_id, s.rank, s.token""")
CTES["routed"] = (("pair", "suggestion", "changed_token", "hit"), CTES["routed"][1])


# --- timing of the events ----------------------------------------------------

def timing(spark: SparkSession, d: str) -> DataFrame:
    """dataset, waiting time and size of each event."""
    return table(spark, d, "events", ["event_id", "event_type", "value", "props"]).select(
        "event_id", F.col("event_type").alias("dataset"), F.col("value").alias("waiting"),
        F.get_json_object("props", "$.k").cast("int").alias("size"))


CTES["timing"] = ((), """
  SELECT event_id, event_type AS dataset, value AS waiting,
         CAST(json_extract_string(props, '$.k') AS INTEGER) AS size FROM events""")


# --- files with labels -------------------------------------------------------

def file_changes(spark: SparkSession, d: str) -> DataFrame:
    """label, file_name, change_id, seq, code and three numeric columns."""
    docs = spread(table(spark, d, "documents", ["doc_id", "text", "n_chars"]))
    labels = table(spark, d, "labels", ["doc_id", "quality"])
    return docs.join(labels, "doc_id").select(
        (1 - F.col("quality")).cast("int").alias("label"), F.col("doc_id").alias("file_name"),
        F.concat(F.lit("I"), F.floor(F.col("doc_id") / 7)).alias("change_id"), F.col("doc_id").alias("seq"),
        F.col("text").alias("code"), F.size(F.split("text", "\n")).alias("deletions"),
        X.words_per_line("text").alias("additions"), F.col("n_chars").cast("int").alias("changed_line"))


CTES["file_change"] = ((), f"""
  SELECT 1 - quality AS label, doc_id AS file_name, 'I' || (doc_id // 7) AS change_id, doc_id AS seq, text AS code,
         len(string_split(text, chr(10))) AS deletions, len({words_sql('text')}) AS additions,
         n_chars AS changed_line
  FROM documents JOIN labels USING (doc_id)""")
