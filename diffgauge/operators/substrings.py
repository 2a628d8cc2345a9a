"""Exact substring join: which needle occurs in which text of the same group.

The needles of a group are gathered into lists of a bounded number, by hash, and a text meets the lists of its
group once. One pass over the text's row tries all needles of a list and only what occurs leaves it, so there
is no row per pair and none per piece of a text. A group of any size has as many lists as it needs; its texts
spread over tasks like any skewed side of a join.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

NEEDLES = 256       # about so many needles in a list


def needle_lists(needles: DataFrame, groups: Sequence[str], columns: Sequence[str], needle: str,
                 most: int = NEEDLES) -> DataFrame:
    """(groups, _needles): the non-empty needles of each group in lists of about ``most``, with the given columns."""
    groups = list(groups)
    own = needles.where(F.length(needle) > 0).select(*groups, F.struct(*columns).alias("_c"), F.col(needle).alias("_n"))
    lists = own.groupBy(*groups).agg(F.ceil(F.count(F.lit(1)) / most).alias("_lists"))
    dealt = own.join(lists, groups).withColumn("_list", F.pmod(F.xxhash64("_n", "_c"), F.col("_lists")))
    return dealt.groupBy(*groups, "_list").agg(F.collect_list(F.struct("_n", "_c")).alias("_needles")).drop("_list")


def found_in(texts: DataFrame, lists: DataFrame, groups: Sequence[str], text: str) -> DataFrame:
    """The rows of ``texts`` once per needle of their group that occurs in them, with the needle's columns."""
    hits = F.filter("_needles", lambda x: F.contains(F.col(text), x["_n"]))
    rows = texts.where(F.length(text) > 0).join(lists, list(groups)).withColumn("_hits", hits).drop("_needles")
    return rows.withColumn("_hit", F.explode("_hits")).drop("_hits").select(
        *texts.columns, "_hit._c.*")


def substring_pairs(needles: DataFrame, texts: DataFrame, groups: Sequence[str], needle_id: str,
                    needle: str, text_id: str, text: str) -> DataFrame:
    """(needle_id, text_id) for every non-empty needle and every text of its group
    that contains it. Both ids identify a row of their side."""
    lists = needle_lists(needles, groups, [needle_id], needle)
    return found_in(texts.select(*groups, text_id, text), lists, groups, text).select(needle_id, text_id).distinct()
