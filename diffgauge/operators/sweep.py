"""Threshold sweeps: every threshold in one pass instead of one pass each."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from diffgauge.functions import numbers as N
from diffgauge.operators import confusion as C
from diffgauge.operators.joins import measured_lookup
from diffgauge.operators.ranks import order_statistics, LOW_MIDDLE, HIGH_MIDDLE, unit_cuts
from diffgauge.operators.topk import score_levels

# The swept settings.
TOP_K_STEPS = (0, 5, 10, 15, 20, 25)
SCORE_STEPS = tuple(i / 10 for i in range(31))

FILE_KEYS = ("dataset", "changeId", "fileName")


def _per_setting(levels: DataFrame, groups: Sequence[str], first_hit: str, settings: Sequence[float],
                 out: str) -> DataFrame:
    """(groups, out, tp, fn, fp, tn) from counts per (groups, first_hit).

    ``first_hit`` is the index of the first setting that predicts the line (or
    the number of settings when none does). Running totals over a group's at most
    len(settings)+1 counters are made first and expanded last, so no row per
    (group, setting) is shuffled or hashed.
    """
    n = len(settings)
    file = Window.partitionBy(*groups)
    order = file.orderBy(first_hit)
    seen = order.rowsBetween(Window.unboundedPreceding, 0)
    after = F.least(F.coalesce(F.lead(first_hit).over(order), F.lit(n)), F.lit(n))
    start = F.when(F.row_number().over(order) == 1, F.lit(0)).otherwise(F.col(first_hit))
    steps = levels.select(
        *groups, first_hit, start.alias("_start"), after.alias("_after"),
        *[F.sum(c).over(seen).alias(f"_{c}") for c in ("pos", "neg")], *[F.sum(c).over(file).alias(c) for c in ("pos", "neg")])
    # a counter answers for the settings up to the next one, a file's first also for those before it
    per = steps.withColumn("_i", F.explode(F.when(F.col("_start") < F.col("_after"), F.sequence("_start", F.col("_after") - 1))))
    zero = F.lit(0).cast("long")
    tp, fp = (F.when(F.col(first_hit) <= F.col("_i"), F.col(c)).otherwise(zero) for c in ("_pos", "_neg"))
    return per.select(*groups, F.get(F.array(*[F.lit(s) for s in settings]), "_i").alias(out),
                      tp.alias("tp"), (F.col("pos") - tp).alias("fn"), fp.alias("fp"), (F.col("neg") - fp).alias("tn"))


def _counts(truth: str) -> list[Column]:
    return [F.count_if(F.col(truth) == 1).alias("pos"), F.count_if(F.col(truth) != 1).alias("neg")]


def steps_below(value: Column, steps: Sequence[float], offset: int = 0) -> Column:
    """How many of the ascending steps lie strictly below the value (null: none),
    by halving, so a row takes log2(steps) comparisons in generated code."""
    if not steps:
        return F.lit(offset)
    mid = len(steps) // 2
    return (F.when(value > steps[mid], steps_below(value, steps[mid + 1:], offset + mid + 1))
            .otherwise(steps_below(value, steps[:mid], offset)))


def score_sweep_by_file(lines: DataFrame, score: str = "ngramScore", truth: str = "groundTruth",
                        groups: Sequence[str] = FILE_KEYS, steps: Sequence[float] = SCORE_STEPS,
                        out: str = "threshold") -> DataFrame:
    """Confusion per (file, threshold) of ``score > threshold``.

    A line is predicted at every threshold below its score, so the lines of a
    file fold into at most len(steps)+1 counters before thresholds are expanded.
    """
    steps = [float(s) for s in sorted(steps)]
    missed = F.lit(len(steps)) - steps_below(F.col(score), steps)
    levels = (lines.withColumn("_first", missed)
              .groupBy(*groups, "_first").agg(*_counts(truth)))
    return _per_setting(levels, groups, "_first", steps[::-1], out)


def top_k_cuts(tokens: DataFrame, token: str, score: str, groups: Sequence[str],
               ks: Sequence[int]) -> DataFrame:
    """(groups, cuts): for every k the lowest score still among the top k tokens
    of the file, ties kept; only positive scores take part; k = 0 has none."""
    distinct = tokens.where(F.col(score) > 0).select(*groups, token, score).distinct()
    levels = score_levels(distinct, groups, score, max(ks))
    per_k = [F.min(F.when(F.col("above") < k, F.col(score))) for k in ks]
    return levels.groupBy(*groups).agg(F.array(*per_k).alias("cuts"))


def top_k_sweep_by_file(lines: DataFrame, tokens: DataFrame, line_key: str = "lineNumber",
                        token: str = "token", score: str = "limeScore",
                        truth: str = "groundTruth", groups: Sequence[str] = FILE_KEYS,
                        ks: Sequence[int] = TOP_K_STEPS, out: str = "k") -> DataFrame:
    """Confusion per (file, k): a line is predicted when one of its tokens is
    among the file's top k.

    The score belongs to (file, token), so a line holds a top-k token exactly
    when its best token score reaches the file's cut for k. Tokens therefore
    reduce to one number per line and the token table is never joined to itself.
    """
    positive = tokens.where(F.col(score) > 0)
    best = positive.groupBy(*groups, line_key).agg(F.max(score).alias("_best"))
    scored = lines.select(*groups, line_key, truth).join(best, [*groups, line_key], "left")
    return top_k_sweep_of_lines(scored, top_k_cuts(positive, token, score, groups, sorted(ks)), truth, groups, ks, out)


def top_k_sweep_of_lines(scored: DataFrame, cuts: DataFrame, truth: str = "groundTruth",
                         groups: Sequence[str] = FILE_KEYS, ks: Sequence[int] = TOP_K_STEPS,
                         out: str = "k") -> DataFrame:
    """The sweep of ``top_k_sweep_by_file`` from lines with their best score (``_best``) and the files' cuts,
    one for each of the ascending ``ks``."""
    ks = sorted(ks)
    folded = scored.groupBy(*groups, "_best").agg(*_counts(truth))
    reached = F.filter(F.col("cuts"), lambda c: c <= F.col("_best"))
    missed = F.lit(len(ks)) - F.when(F.col("_best").isNull() | F.col("cuts").isNull(), 0) \
        .otherwise(F.size(reached))
    levels = (folded.join(cuts, list(groups), "left")
              .withColumn("_first", missed).groupBy(*groups, "_first")
              .agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg")))
    return _per_setting(levels, groups, "_first", list(ks), out)


def sweep_summary(by_file: DataFrame, setting: str, groups: Sequence[str] = FILE_KEYS,
                  per: Sequence[str] = ()) -> DataFrame:
    """Median recall, FAR and D2H over the files, per setting.

    A file without any true line has no recall and leaves those two medians.
    """
    rates = C.with_detection_rates(by_file)
    long = (rates.select(*per, setting, "recall", "far", "d2h")
            .unpivot([*per, setting], ["recall", "far", "d2h"], "_measure", "_v"))
    mids = order_statistics(long, "_v", {"_lo": LOW_MIDDLE, "_hi": HIGH_MIDDLE},
                            [*per, setting, "_measure"], cuts=unit_cuts(), one_pass=True)
    mid = (F.col("_lo") + F.col("_hi")) / 2
    return mids.groupBy(*per, setting).agg(
        *[F.max(F.when(F.col("_measure") == m, mid)).alias(f"avg_{m}") for m in ("recall", "far", "d2h")])


def best_setting(summary: DataFrame, setting: str) -> DataFrame:
    """Smallest median distance to heaven; the smallest setting wins a tie."""
    return summary.orderBy("avg_d2h", setting).limit(1)


def final_comparison(lines: DataFrame, tokens: DataFrame, k: int, threshold: float,
                     groups: Sequence[str] = FILE_KEYS, line_key: str = "lineNumber",
                     score: str = "limeScore", truth: str = "groundTruth",
                     line_score: str = "ngramScore") -> DataFrame:
    """Per file: both approaches at their best setting, with all rates."""
    scored = lines_with_best(lines.select(*groups, line_key, truth, line_score), tokens, groups, line_key, score)
    cuts = top_k_cuts(tokens, "token", score, groups, [max(k, 1)])
    return final_comparison_of_lines(scored, cuts, k, threshold, [max(k, 1)], groups, truth, line_score)


def lines_with_best(lines: DataFrame, tokens: DataFrame, groups: Sequence[str] = FILE_KEYS,
                    line_key: str = "lineNumber", score: str = "limeScore") -> DataFrame:
    """The lines with their best positive token score (``_best``) and their number of tokens, null without any."""
    best = tokens.groupBy(*groups, line_key).agg(
        F.max(F.when(F.col(score) > 0, F.col(score))).alias("_best"),
        F.count(F.lit(1)).alias("token_count"))
    return lines.join(best, [*groups, line_key], "left")


def final_comparison_of_lines(scored: DataFrame, cuts: DataFrame, k: int, threshold: float,
                              ks: Sequence[int] = TOP_K_STEPS, groups: Sequence[str] = FILE_KEYS,
                              truth: str = "groundTruth", line_score: str = "ngramScore") -> DataFrame:
    """``final_comparison`` from ``lines_with_best`` and the files' cuts for the ascending ``ks``, ``k`` among them."""
    # one row per (file, best token score) before the cuts are joined
    folded = (scored.groupBy(*groups, "_best", (F.col(line_score) > threshold).alias("_n"))
              .agg(*_counts(truth), F.sum("token_count").alias("tokens")))
    cut = F.col("cuts")[sorted(ks).index(k)] if k > 0 else F.lit(None).cast("double")
    hit = F.coalesce(F.col("_best") >= cut, F.lit(False))
    joined = folded.join(cuts, list(groups), "left")

    def total(which, side):
        return F.sum(F.when(which, F.col(side)).otherwise(F.lit(0)))
    near = F.coalesce(F.col("_n"), F.lit(False))
    out = joined.groupBy(*groups).agg(
        total(hit, "pos").alias("topk_tp"), total(~hit, "pos").alias("topk_fn"),
        total(hit, "neg").alias("topk_fp"), total(~hit, "neg").alias("topk_tn"),
        total(near, "pos").alias("ngram_tp"), total(~near, "pos").alias("ngram_fn"),
        total(near, "neg").alias("ngram_fp"), total(~near, "neg").alias("ngram_tn"),
        F.coalesce(F.sum("tokens"), F.lit(0)).alias("tokens"))
    return C.with_detection_rates(C.with_detection_rates(out, "topk_"), "ngram_")


def marked_tokens(tokens: DataFrame, k: int = 10, groups: Sequence[str] = FILE_KEYS, token: str = "token",
                  score: str = "limeScore", out: str = "is_top") -> DataFrame:
    """The tokens with a flag for the top k of their file. The score belongs to (file, token), so a token is among
    them exactly when its score reaches the file's cut: one number per file meets the tokens, not a token table."""
    cuts = top_k_cuts(tokens, token, score, groups, [k]).select(*groups, F.col("cuts")[0].alias("_cut"))
    return (measured_lookup(tokens, cuts, groups)
            .withColumn(out, F.coalesce(F.col(score) >= F.col("_cut"), F.lit(False))).drop("_cut"))


# --- top tokens of files whose lines hold their own tokens ---------------------------------------------------

def top_levels(tokens: DataFrame, k: int, groups: Sequence[str] = FILE_KEYS, token: str = "token",
               score: str = "limeScore", out: str = "tops") -> DataFrame:
    """(groups, tops, top): the score levels of a file that its first k ranks touch, ties kept, best first: each with its
    score, the number of tokens ``above`` it and its distinct tokens; ``top``: the tokens of all levels.
    Only positive scores take part.

    ``tokens`` holds whole files' tokens, not lines'. They are shuffled once, to their file, and of the levels
    that meet in a task the best k only; what a file gathers is at most its own distinct words.
    """
    level = F.dense_rank().over(Window.partitionBy(*groups).orderBy(F.col(score).desc()))
    own = tokens.where(F.col(score) > 0).select(*groups, token, score).withColumn("_level", level).where(F.col("_level") <= k)
    levels = own.groupBy(*groups, score).agg(F.collect_set(token).alias("_tokens"))
    before = Window.partitionBy(*groups).orderBy(F.col(score).desc()).rowsBetween(Window.unboundedPreceding, -1)
    placed = levels.withColumn("_above", F.coalesce(F.sum(F.size("_tokens")).over(before), F.lit(0)))
    level = F.struct(F.col(score).alias("score"), F.col("_above").alias("above"), F.col("_tokens").alias("tokens"))
    found = placed.where(F.col("_above") < k).groupBy(*groups).agg(F.sort_array(F.collect_list(level), asc=False).alias(out))
    return found.withColumn("top", F.flatten(F.transform(out, lambda v: v["tokens"])))


def cuts_of_levels(tops: DataFrame, ks: Sequence[int], groups: Sequence[str] = FILE_KEYS, levels: str = "tops") -> DataFrame:
    """``top_k_cuts`` out of ``top_levels`` for at least the greatest of ``ks``."""
    def cut(k):
        return F.array_min(F.transform(F.filter(levels, lambda v: v["above"] < k), lambda v: v["score"]))
    return tops.select(*groups, F.array(*[cut(k) for k in ks]).alias("cuts"))


def with_held(lines: DataFrame, tokens: str = "tokens", top: str = "top", out: str = "held") -> DataFrame:
    """The top tokens of its file that a line holds; null where the file has none."""
    return lines.withColumn(out, F.array_intersect(tokens, top))


def marked_lines(lines: DataFrame, tokens: str = "tokens", held: str = "held", out: str = "is_top") -> DataFrame:
    """``marked_tokens`` for lines with their distinct tokens (``with_held``): a row per token, nothing shuffled."""
    keep = [c for c in lines.columns if c not in (tokens, held)]
    none = F.array().cast("array<string>")

    def flagged(found, flag):
        return F.transform(found, lambda t: F.struct(t.alias("token"), F.lit(flag).alias(out)))
    marks = F.concat(flagged(F.coalesce(held, none), True), flagged(F.array_except(tokens, F.coalesce(held, none)), False))
    return lines.select(*keep, F.explode(marks).alias("_m")).select(*keep, "_m.token", f"_m.{out}")


def line_top_counts(tokens: str = "tokens", held: str = "held") -> tuple[Column, Column]:
    """How many of a line's tokens are top tokens of its file, and how many it has."""
    return (F.coalesce(F.size(held), F.lit(0)).cast("long").alias("numTopK"), F.size(tokens).cast("long").alias("tokenCount"))


def best_of_line(held: str = "held", levels: str = "tops") -> Column:
    """The best score among the top tokens a line holds, null without any. Levels are tried, k of them at most."""
    best = F.array_max(F.transform(F.filter(levels, lambda v: F.arrays_overlap(v["tokens"], F.col(held))), lambda v: v["score"]))
    return F.when(F.size(held) > 0, best)


def joined_lines(lines: DataFrame, values: Sequence[tuple[str, str]], groups: Sequence[str] = FILE_KEYS,
                 line_key: str = "lineNumber") -> DataFrame:
    """Every line with the total over all lines of its key, as if totals by key were joined to the lines: files may come
    twice, and a key that holds a null meets nothing. ``values``: (column, aggregate function)."""
    same = Window.partitionBy(*groups, line_key)
    known = F.lit(True)
    for c in (*groups, line_key):
        known = known & F.col(c).isNotNull()
    return lines.withColumns({c: F.when(known, getattr(F, how)(c).over(same)) for c, how in values})


def line_hits(tokens: DataFrame, top_tokens: DataFrame, groups: Sequence[str] = FILE_KEYS,
              line_key: str = "lineNumber", token: str = "token") -> DataFrame:
    """(groups, line, numTopK): how many tokens of a line are top tokens."""
    marks = top_tokens.select(*groups, token).withColumn("_top", F.lit(1))
    return (tokens.join(marks, [*groups, token], "left")
            .groupBy(*groups, line_key).agg(F.count("_top").alias("numTopK")))
