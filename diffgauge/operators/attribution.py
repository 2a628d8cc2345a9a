"""Token attribution tables, length scores and their way back to the lines."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window, functions as F

from diffgauge.functions import text as X
from diffgauge.operators.joins import measured_lookup

FILE = ("changeId", "fileName")


def without_stop_words(attribution: DataFrame, stop_words: DataFrame, language: str = "language",
                       token: str = "token") -> DataFrame:
    """Drop the stop words of each row's language. The word table is the fixed
    list of ``diffgauge.functions.words`` (a few hundred rows)."""
    return attribution.join(F.broadcast(stop_words), [language, token], "left_anti")


def explode_tokens(lines: DataFrame, code: str = "code", token: str = "token") -> DataFrame:
    """One row per distinct lower-case token of each line."""
    keep = [c for c in lines.columns if c != code]
    return lines.select(*keep, F.explode(X.line_tokens(code)).alias(token))


def token_scores(lines: DataFrame, attribution: DataFrame, on: Sequence[str], code: str = "code",
                 weight: str = "weight", out: str = "limeScore", hot: Sequence[int] | None = None) -> DataFrame:
    """Score of every token of every line, 0 for tokens without attribution."""
    tokens = explode_tokens(lines, code)
    return (measured_lookup(tokens, attribution, on, hot=hot)
            .withColumn(out, F.coalesce(F.col(weight), F.lit(0.0))).drop(weight))


def commented_lines(lines: DataFrame, files: DataFrame, label: str = "label") -> DataFrame:
    """Positive lines whose file is a positive (training) file."""
    wanted = files.where(F.col(label) == 1).select(*FILE).distinct()
    return measured_lookup(lines.where(F.col(label) == 1), wanted, list(FILE), "left_semi")


def length_distribution(lines: DataFrame, code: str = "code") -> DataFrame:
    """(length, length_score): share of the lines with that many words."""
    hist = lines.groupBy(X.words_per_line(code).alias("length")).agg(F.count(F.lit(1)).alias("_c"))
    # one row per length: the total over this short table needs no second scan
    total = F.sum("_c").over(Window.partitionBy(F.lit(0)))
    return hist.select("length", (F.col("_c") / total).alias("length_score"))


def with_length_score(lines: DataFrame, distribution: DataFrame, code: str = "code") -> DataFrame:
    """Length score of every line, 0 for lengths never seen."""
    sized = lines.withColumn("length", X.words_per_line(code))
    return (measured_lookup(sized, distribution, ["length"])
            .withColumn("length_score", F.coalesce("length_score", F.lit(0.0))))
