"""From commented review lines and landed patch-set diffs to labelled lines.

lookup of the next diff -> chunks -> lines found in which side -> status,
context and quarantine outcome. Every input row ends in at least one output row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from diffgauge.functions import text as X
from diffgauge.operators.substrings import found_in, needle_lists
from diffgauge.session import materialize

DIFF_KEYS = ("change_id", "file_dir", "base_patch")

# The status of a labelled line.
NO_COMMENT, REVISED, NOT_REVISED = 0, 1, 2


def parse_raw(raw: DataFrame, row: str = "row_id") -> DataFrame:
    """Add the numbers out of the ref and the search text without leading plus."""
    return (raw.withColumn("change_num", X.change_number("ref"))
            .withColumn("patch_set", X.patch_number("ref"))
            .withColumn("needle", X.strip_plus("raw_code")))


def next_diffs(diffs: DataFrame, max_ahead: int = 3) -> DataFrame:
    """Per (change, file, base patch) the first diff 1..max_ahead patch sets on."""
    ahead = F.col("patch_set") - F.col("base_patch")
    return (diffs.where((ahead >= 1) & (ahead <= max_ahead))
            .groupBy(*DIFF_KEYS)
            .agg(F.min("patch_set").alias("found_patch"), F.min_by("content", "patch_set").alias("content")))


def lookup(rows: DataFrame, diffs: DataFrame, max_ahead: int = 3) -> DataFrame:
    """Rows with the patch set their diff was found at (null = missed).

    Only the key and the patch number meet the rows; the diff bodies stay out of
    this join, so many lines of one file do not each carry a copy.
    """
    ahead = F.col("patch_set") - F.col("base_patch")
    keys = (diffs.where((ahead >= 1) & (ahead <= max_ahead))
            .groupBy(*DIFF_KEYS).agg(F.min("patch_set").alias("found_patch")))
    return rows.withColumn("base_patch", F.col("patch_set")).join(keys, list(DIFF_KEYS), "left")


def chunk_sides(chosen: DataFrame) -> DataFrame:
    """One row per (diff, chunk, side): its lines and their joined text.

    Sides other than a, b and ab (any further list of strings in the chunk) are
    kept, they end as ``caution``; fields that are no lists are ignored.
    """
    fields = chosen.schema["content"].dataType.elementType.fields
    names = [f.name for f in fields if f.dataType == T.ArrayType(T.StringType())]
    chunk = chosen.select(*DIFF_KEYS, F.posexplode("content").alias("chunk", "_c"))
    sides = F.explode(F.array(*[
        F.struct(F.lit(s).alias("side"), F.col(f"_c.{s}").alias("lines")) for s in names]))
    long = chunk.select(*DIFF_KEYS, "chunk", F.col("_c.b").alias("new_lines"), sides.alias("_s"))
    return (long.where(F.col("_s.lines").isNotNull())
            .select(*DIFF_KEYS, "chunk", "_s.side", "_s.lines",
                    F.when(F.col("_s.side") == "a", F.col("new_lines")).alias("new_lines"),
                    F.array_join("_s.lines", "").alias("block")))


def locate(rows: DataFrame, sides: DataFrame, row: str = "row_id") -> DataFrame:
    """(row, chunk, side, lines, new_lines, block): every side of every chunk of
    the row's diff that holds the row's text; one row may be found many times.
    """
    return found_texts(rows, sides).join(rows.select(row, *DIFF_KEYS, "needle"), [*DIFF_KEYS, "needle"])


def found_texts(rows: DataFrame, sides: DataFrame) -> DataFrame:
    """``sides`` once per text of their diff that they hold (column ``needle``); equal texts of a file are searched once."""
    texts = rows.select(*DIFF_KEYS, "needle").distinct()
    return found_in(sides, needle_lists(texts, DIFF_KEYS, ["needle"], "needle"), DIFF_KEYS, "block")


def context_after(lines: Column, new_lines: Column, needle: Column, wrap_first: bool = False) -> dict[str, Column]:
    """The three lines of the new side around the place of the needle.

    ``index`` is 0-based, -1 when only the joined block holds the needle. The
    text is null when the new side is too short (-> not_found).
    """
    at = X.first_line_with(lines, needle)
    new = F.coalesce(new_lines, F.array().cast("array<string>"))

    def line(i: Column) -> Column:
        # try_element_at counts negative positions from the end and rejects 0
        return F.when(i >= 1, F.try_element_at(new, F.greatest(i, F.lit(1))))
    first = F.try_element_at(new, F.lit(-1)) if wrap_first else F.lit("")
    prior = F.when(at == 1, F.coalesce(first, F.lit(""))).otherwise(F.coalesce(line(at - 1), F.lit("")))
    target = F.when(new_lines.isNull(), F.lit("")).otherwise(line(at))
    following = F.coalesce(line(at + 1), F.lit(""))
    text = F.when((at >= 1) & target.isNotNull(),
                  F.concat(prior, F.lit("\\n"), target, F.lit("\\n"), following))
    return {"index": at - 1, "old_line": line_at(lines, at), "after": text}


def line_at(lines: Column, at: Column) -> Column:
    return F.when(at >= 1, F.try_element_at(lines, F.greatest(at, F.lit(1))))


def classify(raw: DataFrame, diffs: DataFrame, row: str = "row_id", max_ahead: int = 3,
             wrap_first: bool = False) -> DataFrame:
    """The labelled line table with an ``outcome`` per output row.

    ``ok``            label 0 input, or found: (0, status 2) in b/ab, (1, 1) in a
    ``not_found``     found in the joined block only, or the new side is too short;
                      the new side of that chunk is then not looked at
    ``caution``       found in a side other than a, b and ab
    ``missed_diff``   no diff within ``max_ahead`` patch sets
    ``empty_needle``  nothing to search for
    ``no_match``      diff present, text in none of its sides
    ``double``        extra row: found both in an old and in a new/common side
    """
    parsed = parse_raw(raw, row)
    keep = [row, "file_dir", "change_id", "change_num", "patch_set", F.col("code").alias("shaped_code"),
            "raw_code", "line", "ref"]

    def shaped(df, label, status, before, after, outcome):
        return df.select(
            row, F.lit(label).cast("int").alias("label") if not isinstance(label, Column) else label.alias("label"),
            F.lit(status).cast("int").alias("status") if not isinstance(status, Column) else status.alias("status"),
            "file_dir", "change_id", "change_num", "patch_set", "shaped_code",
            before.alias("before_code"), after.cast("string").alias("after_code"), "line", "ref",
            F.lit(outcome).alias("outcome") if isinstance(outcome, str) else outcome.alias("outcome"))

    none = F.lit(None)
    plain = parsed.where(F.col("label") == 0).select(*keep)
    out = shaped(plain, 0, NO_COMMENT, F.col("raw_code"), none, "ok")

    wanted = lookup(parsed.where(F.col("label") != 0), diffs, max_ahead)
    searchable = (F.col("found_patch").isNotNull()) & (F.length("needle") > 0)
    aside = wanted.where(~F.coalesce(searchable, F.lit(False)))
    reason = F.when(F.coalesce(F.length("needle"), F.lit(0)) == 0, "empty_needle").otherwise("missed_diff")
    out = out.unionByName(shaped(aside.select(*keep, reason.alias("_why")), none.cast("int"), none.cast("int"),
                                 F.col("raw_code"), none, F.col("_why")))

    live = materialize(wanted.where(searchable).select(*keep, "needle", "base_patch"))
    found = found_texts(live, chunk_sides(next_diffs(diffs, max_ahead)))
    ctx = context_after(F.col("lines"), F.col("new_lines"), F.col("needle"), wrap_first)
    is_old, is_new = F.col("side") == "a", F.col("side").isin("b", "ab")
    broken = is_old & ctx["after"].isNull()
    # what a text finds is the same for all its rows: the diff's lines go no further than here
    places = found.select(*DIFF_KEYS, "needle", "chunk", "side", broken.alias("_broken"),
                          F.when(is_old, ctx["old_line"]).alias("_before"), F.when(is_old, ctx["after"]).alias("_after"))
    same_chunk = Window.partitionBy(row, "chunk")
    hits = materialize(
        places.join(live.select(row, *DIFF_KEYS, "needle"), [*DIFF_KEYS, "needle"])
        .select(row, "chunk", "side", "_broken", "_before", "_after")
        .withColumn("_stop", F.bool_or("_broken").over(same_chunk))
        .where(~(F.col("_stop") & (F.col("side") == "b"))))
    flags = hits.groupBy(row).agg(F.bool_or(is_new).alias("_any_new"),
                                  F.bool_or(is_old & ~F.col("_broken")).alias("_good_old"))
    body = live.drop("needle", "base_patch")
    each = body.join(hits, row, "inner")
    lost = F.col("_broken") | ~(is_old | is_new)
    out = out.unionByName(shaped(
        each, F.when(lost, none.cast("int")).when(is_old, 1).otherwise(0),
        F.when(lost, none.cast("int")).when(is_old, REVISED).otherwise(NOT_REVISED),
        F.coalesce("_before", "raw_code"), F.col("_after"),
        F.when(F.col("_broken"), "not_found").when(lost, "caution").otherwise("ok")))
    state = body.join(flags, row, "left")
    extra = (F.when(F.col("_any_new").isNull(), "no_match")
             .when(F.col("_good_old") & F.col("_any_new"), "double"))
    rest = state.withColumn("_why", extra).where(F.col("_why").isNotNull())
    return out.unionByName(shaped(rest, none.cast("int"), none.cast("int"), F.col("raw_code"), none, F.col("_why")))
