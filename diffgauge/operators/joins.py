"""Lookup joins whose fact side may be dominated by a few keys."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F, types as T

from diffgauge.session import materialize

HOT_SHARE = 0.01
MOST_ROWS, MOST_BYTES = 500_000, 32 << 20       # a lookup beyond either is not broadcast


def with_scalars(df: DataFrame, one_row: DataFrame) -> DataFrame:
    """Add the columns of a table with exactly one row (a global aggregate)."""
    return df.join(F.broadcast(one_row))


def hot_keys(df: DataFrame, on: Sequence[str], share: float = HOT_SHARE) -> list[int]:
    """Hashes of all keys that hold at least ``share`` of the rows (and maybe a few
    more): one scan without a shuffle, never more than 1/share entries."""
    found = df.select(F.xxhash64(*on).alias("h")).stat.freqItems(["h"], support=share).first()
    return list(found[0] or [])


def is_small(stored: DataFrame, most_rows: int = MOST_ROWS, most_bytes: int = MOST_BYTES) -> bool:
    """Whether a stored table lies below both bounds. The rows are counted first, from the files' footers;
    only a table within them is read for the bytes of its texts. Columns are numbers and strings."""
    n = stored.count()
    if n > most_rows:
        return False
    texts = [f.name for f in stored.schema.fields if isinstance(f.dataType, T.StringType)]
    fixed = 8 * n * (len(stored.columns) - len(texts))
    wide = F.sum(sum((F.coalesce(F.octet_length(c), F.lit(0)) for c in texts), F.lit(0).cast("long")))
    return fixed + (stored.select(wide).first()[0] or 0 if texts else 0) <= most_bytes


def measured_lookup(facts: DataFrame, lookup: DataFrame, on: Sequence[str], how: str = "left",
                    hot: Sequence[int] | None = None, **bounds: int) -> DataFrame:
    """Join facts to a lookup with one row per key, whose size is measured before the plan is made.

    The lookup is written once. Below the bounds it is broadcast, so the facts are neither shuffled nor
    gathered by key; beyond them they are, with known hot keys spread. Both ways return the same rows.
    """
    stored = materialize(lookup)
    if is_small(stored, **bounds):
        return facts.join(F.broadcast(stored), list(on), how)
    return salted_lookup(facts, stored, on, how, hot)


def salted_lookup(facts: DataFrame, lookup: DataFrame, on: Sequence[str], how: str = "left",
                  hot: Sequence[int] | None = None, salts: int | None = None) -> DataFrame:
    """Join facts to a lookup with one row per key.

    Without known hot keys this is a plain join, whose skewed partitions AQE
    splits at run time. With ``hot`` (hashes from ``hot_keys``) the facts of those
    keys are spread over ``salts`` tasks and their lookup rows copied that often;
    all other keys join as usual.
    """
    on = list(on)
    if not hot:
        return facts.join(lookup, on, how)
    if salts is None:
        salts = int(facts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    others = [c for c in facts.columns if c not in on] or on
    is_hot = F.xxhash64(*on).isin(list(hot))
    f = facts.withColumn("_salt", F.when(is_hot, F.pmod(F.xxhash64(F.lit(1), *others), F.lit(salts))).otherwise(0).cast("int"))
    copies = F.when(is_hot, F.sequence(F.lit(0), F.lit(salts - 1))).otherwise(F.array(F.lit(0)))
    g = lookup.withColumn("_salt", F.explode(copies))
    return f.join(g, [*on, "_salt"], how).drop("_salt")
