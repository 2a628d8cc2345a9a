"""Token tables: sub-word merging, top-n suggestions, changed tokens, matching.

All of them are long tables keyed by (row_id, ...). Windows run per row_id, that
is within the tokens of one text.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from diffgauge.functions import numbers as N, text as X
from diffgauge.operators.topk import top_exact

SPECIAL_PIECES = (X.START_MARK, X.END_MARK)
TOP_NS = (1, 3, 5)


def explode_scored(df: DataFrame, row: str, pieces: str, scores: str) -> DataFrame:
    """(row, pos, piece, score) out of two parallel arrays."""
    zipped = F.arrays_zip(F.col(pieces).alias("piece"), F.col(scores).alias("score"))
    return (df.select(row, F.posexplode(zipped).alias("pos", "_z"))
            .select(row, "pos", F.col("_z.piece").alias("piece"), F.col("_z.score").alias("score")))


def break_after_punctuation(pieces: DataFrame, row: str = "row_id") -> DataFrame:
    """Drop lone word-start marks and pure punctuation; the next piece that is
    kept starts a new word."""
    w = Window.partitionBy(row).orderBy("pos")
    kept = (pieces.where(F.col("piece") != X.WORD_START)
            .withColumn("_punct", X.is_pure_punctuation("piece"))
            .withColumn("_cut", F.coalesce(F.lag("_punct").over(w), F.lit(False)))
            .where(~F.col("_punct")))
    return (kept.withColumn("piece", F.when(F.col("_cut"), F.concat(F.lit(X.WORD_START), "piece"))
                            .otherwise(F.col("piece")))
            .drop("_punct", "_cut"))


def merge_subwords(pieces: DataFrame, row: str = "row_id", score: str | None = "score") -> DataFrame:
    """Words from sub-word pieces: (row, pos, token[, score]).

    A piece with the word-start mark (or a special piece, or the first piece)
    opens a word; the word's score is the maximum over its pieces.
    """
    w = Window.partitionBy(row).orderBy("pos")
    opens = (F.startswith(F.col("piece"), F.lit(X.WORD_START)) | F.col("piece").isin(*SPECIAL_PIECES)
             | (F.row_number().over(w) == 1))
    words = (pieces.withColumn("_open", opens.cast("int"))
             .withColumn("_word", F.sum("_open").over(w.rowsBetween(Window.unboundedPreceding, 0))))
    spelled = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("pos", "piece"))),
                                       lambda s: s["piece"]), "")
    aggs = [F.min("pos").alias("pos"), spelled.alias("token")]
    if score:
        aggs.append(F.max(score).alias("score"))
    out = words.groupBy(row, "_word").agg(*aggs)
    return out.select(row, "pos", "token", *(["score"] if score else []))


def clean_scores(words: DataFrame, row: str = "row_id", drop: Sequence[str] = ()) -> DataFrame:
    """Special tokens out, word-start mark off; of equal tokens the last wins,
    at the place where the token first stood."""
    special = [*SPECIAL_PIECES, X.WORD_START, *drop]
    bare = F.replace(F.col("token"), F.lit(X.WORD_START), F.lit(""))
    return (words.where(~F.col("token").isin(*special))
            .select(row, "pos", bare.alias("token"), "score")
            .groupBy(row, "token")
            .agg(F.max_by("score", "pos").alias("score"), F.min("pos").alias("pos")))


def suggestions(scores: DataFrame, n: int, row: str = "row_id") -> DataFrame:
    """Exactly n best tokens per row, first position first among equals."""
    return top_exact(scores, [row], [F.col("score").desc(), F.col("pos").asc()], n)


def changed_tokens(pairs: DataFrame, row: str = "row_id", before: str = "before_code",
                   after: str = "after_code", mode: str = "multiset") -> DataFrame:
    """Distinct deleted words of each pair: (row, token), digits masked.

    ``multiset``: words standing more often before than after (one partial
    aggregation per (row, word)). ``lcs``: words outside a longest common
    subsequence, order aware. ``set``: words absent after.
    """
    texts = pairs.select(row, X.unescape_newlines(before).alias("_x"), X.unescape_newlines(after).alias("_y"))
    if mode == "lcs":
        deleted = texts.select(row, X.plain_words("_x").alias("x"), X.plain_words("_y").alias("y")) \
            .mapInArrow(_lcs_deleted(row), schema=f"{row} {dict(pairs.dtypes)[row]}, token string")
    else:
        signed = F.concat(
            F.transform(X.plain_words("_x"), lambda t: F.struct(t.alias("token"), F.lit(1).alias("s"))),
            F.transform(X.plain_words(F.coalesce("_y", F.lit(""))),
                        lambda t: F.struct(t.alias("token"), F.lit(-1).alias("s"))))
        long = texts.select(row, F.explode(signed).alias("_t")).select(row, "_t.token", "_t.s")
        if mode == "multiset":
            kept = F.sum("s") > 0
        elif mode == "set":
            kept = F.min("s") > 0
        else:
            raise ValueError(mode)
        deleted = long.groupBy(row, "token").agg(kept.alias("_k")).where("_k").select(row, "token")
    return (deleted.select(row, X.mask_digits("token").alias("token"))
            .where("token <> ''").distinct())


LCS_ROWS = 128      # pairs whose words are Python objects at the same time


def _lcs_deleted(row: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kind = batch.schema.field(row).type
            for at in range(0, batch.num_rows, LCS_ROWS):
                ids, tokens = [], []
                part = batch.slice(at, LCS_ROWS)
                for rid, x, y in zip(*(part.column(c).to_pylist() for c in (row, "x", "y"))):
                    for t in lcs_deletions(list(x), list(y) if y is not None else []):
                        ids.append(rid)
                        tokens.append(t)
                if ids:
                    yield pa.RecordBatch.from_arrays([pa.array(ids, kind), pa.array(tokens, pa.string())], names=[row, "token"])
    return run


def _lcs_lengths(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Lengths of the longest common subsequence of x with every prefix of y."""
    best = np.zeros(len(y) + 1, dtype=np.int32)
    for t in x:
        step = best.copy()
        step[1:] = np.maximum(best[1:], best[:-1] + (y == t))
        best = np.maximum.accumulate(step)
    return best


def lcs_deletions(before: Sequence[str], after: Sequence[str]) -> list[str]:
    """Words of ``before`` outside one longest common subsequence, by divide and
    conquer over the prefix lengths (linear memory)."""
    codes = {t: i for i, t in enumerate(dict.fromkeys([*before, *after]))}
    x = np.array([codes[t] for t in before], dtype=np.int64)
    y = np.array([codes[t] for t in after], dtype=np.int64)
    kept = np.zeros(len(x), dtype=bool)
    stack = [(0, len(x), 0, len(y))]
    while stack:
        x0, x1, y0, y1 = stack.pop()
        if x0 == x1 or y0 == y1:
            continue
        if x1 - x0 == 1:
            kept[x0] = bool((y[y0:y1] == x[x0]).any())
            continue
        mid = (x0 + x1) // 2
        head = _lcs_lengths(x[x0:mid], y[y0:y1])
        tail = _lcs_lengths(x[mid:x1][::-1], y[y0:y1][::-1])[::-1]
        cut = y0 + int(np.argmax(head + tail))
        stack += [(x0, mid, y0, cut), (mid, x1, cut, y1)]
    return [t for t, k in zip(before, kept) if not k]


def xml_changed_tokens(rows: DataFrame, row: str = "row_id", xml: str = "xml") -> DataFrame:
    """Deleted names and texts of a syntactic diff: (row, token).

    Below the delete element and not below a common element; tokens with any
    punctuation are dropped, digits masked, duplicates removed. Broken documents
    yield nothing here and are found by ``broken_xml``.
    """
    from diffgauge.functions import nested as S
    safe = rows.withColumn("_x", F.when(S.is_wellformed(xml), F.col(xml)))
    texts = S.texts_under("_x", "diff:delete", None, "diff:common")
    words = safe.select(row, F.explode(texts).alias("_t")).select(row, X.strip_space("_t").alias("token"))
    return (words.where((F.col("token") != "") & ~X.has_punctuation("token"))
            .select(row, X.mask_digits("token").alias("token")).distinct())


def broken_xml(rows: DataFrame, xml: str = "xml") -> DataFrame:
    from diffgauge.functions import nested as S
    return rows.where(~S.is_wellformed(xml))


def partial_matches(suggested: DataFrame, changed: DataFrame, row: str = "row_id",
                    match: str = "contains") -> DataFrame:
    """(row, rank, token, hits): for every suggestion the number of changed
    tokens of its row that contain it. Every pair counts, as published.

    Equi join on the row; at most n suggestions meet the row's changed tokens.
    """
    s, c = suggested.alias("s"), changed.alias("c")
    inside = (F.contains(F.col("c.token"), F.col("s.token")) if match == "contains"
              else F.col("c.token") == F.col("s.token"))
    return (s.join(c, (F.col(f"s.{row}") == F.col(f"c.{row}")) & inside, "left")
            .groupBy(F.col(f"s.{row}").alias(row), F.col("s.rank").alias("rank"), F.col("s.token").alias("token"))
            .agg(F.count(F.col("c.token")).alias("hits")))


def route_rows(rows: DataFrame, suggested: DataFrame, changed: DataFrame, row: str = "row_id",
               ns: Sequence[int] = TOP_NS, more_than_n: int = 0, match: str = "contains",
               length: str = "n_tokens", predicted: str = "y_pred",
               failed: str | None = None) -> DataFrame:
    """One row per (row, k) with the match counts and the outcome.

    Outcomes: ``unknown`` (no changed tokens could be extracted), ``FN`` (not
    predicted), ``too_short``, ``positive`` and ``negative`` by n_common.
    """
    hits = partial_matches(suggested, changed, row, match)
    folded = hits.groupBy(row).agg(F.collect_list(F.struct("rank", "token", "hits")).alias("_s"))
    kept = changed.groupBy(row).agg(F.sort_array(F.collect_list("token")).alias("changed"))
    base = (rows.join(folded, row, "left").join(kept, row, "left")
            .withColumn("_s", F.coalesce("_s", F.array().cast("array<struct<rank:int,token:string,hits:bigint>>")))
            .withColumn("changed", F.coalesce("changed", F.array().cast("array<string>"))))
    per_k = base.withColumn("k", F.explode(F.array(*[F.lit(n) for n in ns])))
    head = F.sort_array(F.filter("_s", lambda s: s["rank"] <= F.col("k")))
    out = (per_k.withColumn("_h", head)
           .withColumn("suggestion", F.transform("_h", lambda s: s["token"]))
           .withColumn("n_common", F.aggregate("_h", F.lit(0).cast("long"), lambda a, s: a + s["hits"]))
           .withColumn("n_suggested", F.size("_h")).withColumn("n_changed", F.size("changed")))
    bad = F.col(failed) if failed else F.lit(False)
    outcome = (F.when(bad, "unknown").when(F.col(predicted) != 1, "FN")
               .when(F.col(length) < more_than_n, "too_short")
               .when(F.col("n_common") > 0, "positive").otherwise("negative"))
    return out.withColumn("outcome", outcome).drop("_s", "_h")


def published_outcome(outcome="outcome") -> Column:
    """The published evaluation files short rows together with the rows not predicted."""
    c = F.col(outcome) if isinstance(outcome, str) else outcome
    return F.when(c == "too_short", "FN").otherwise(c)


def token_scores_at_k(routed: DataFrame, precision_scope: str = "all") -> DataFrame:
    """Recall, precision and F1 per k.

    Common and changed tokens are summed over the routed rows; suggested tokens
    over all rows with a successful extraction (``all``, as published) or over
    the routed rows (``routed``).
    """
    used = F.col("outcome").isin("positive", "negative")
    known = F.col("outcome") != "unknown"
    scope = known if precision_scope == "all" else used

    def total(cond, c):
        return F.coalesce(F.sum(F.when(cond, F.col(c))), F.lit(0))
    sums = routed.groupBy("k").agg(total(used, "n_common").alias("common"),
                                   total(used, "n_changed").alias("changed"),
                                   total(scope, "n_suggested").alias("suggested"))
    return (sums.withColumn("recall", N.ratio("common", "changed"))
            .withColumn("precision", N.ratio("common", "suggested"))
            .withColumn("f1", N.f1("recall", "precision")))


def venn_counts(scores: DataFrame) -> DataFrame:
    """Left only, right only and common sizes of the two token sets."""
    return scores.select("k", (F.col("changed") - F.col("common")).alias("changed_only"),
                         (F.col("suggested") - F.col("common")).alias("suggested_only"),
                         F.col("common"))
