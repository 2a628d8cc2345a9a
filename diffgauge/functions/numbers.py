"""Column expressions over numbers: rates, distances, portable hashing."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, functions as F


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def ratio(num, den) -> Column:
    """num / den as double, null when the denominator is 0."""
    return F.try_divide(_col(num).cast("double"), _col(den).cast("double"))


def ratio_or_zero(num, den) -> Column:
    return F.coalesce(ratio(num, den), F.lit(0.0))


def fill(c, value=0.0) -> Column:
    """Null and NaN become ``value``."""
    return F.coalesce(F.nanvl(_col(c).cast("double"), F.lit(None).cast("double")), F.lit(value))


def recall(tp, fn) -> Column:
    return ratio(tp, _col(tp) + _col(fn))


def false_alarm(fp, tn) -> Column:
    """FP / (FP + TN); no negative line at all counts as no false alarm."""
    return ratio_or_zero(fp, _col(fp) + _col(tn))


def distance_to_heaven(rec, far) -> Column:
    return F.sqrt(((1 - _col(rec)) * (1 - _col(rec)) + _col(far) * _col(far)) / 2)


def f1(rec, prec) -> Column:
    """Harmonic mean, null when both are 0."""
    return F.try_divide(2 * _col(rec) * _col(prec), _col(rec) + _col(prec))


def mcc(tp, fp, fn, tn) -> Column:
    tp, fp, fn, tn = (_col(c).cast("double") for c in (tp, fp, fn, tn))
    spread = F.sqrt(tp + fp) * F.sqrt(tp + fn) * F.sqrt(tn + fp) * F.sqrt(tn + fn)
    return F.coalesce(F.try_divide(tp * tn - fp * fn, spread), F.lit(0.0))


def sigmoid(x) -> Column:
    return 1 / (1 + F.exp(-_col(x)))


def above(p, threshold: float = 0.5) -> Column:
    """Strictly above the threshold, as 0/1."""
    return F.when(_col(p) > threshold, 1).otherwise(0)


def two_columns(p) -> Column:
    return F.struct((1 - _col(p)).alias("p0"), _col(p).alias("p1"))


def percent_change(value, base, zero_base_as_one: bool = True) -> Column:
    base = F.when(_col(base) == 0, F.lit(1.0)).otherwise(_col(base)) if zero_base_as_one else _col(base)
    return F.try_divide((_col(value) - base) * 100, base)


def digest(key_cols: Sequence, seed: int, tag: str = "") -> Column:
    """Hex digest of key and seed: the same on every engine and in every run."""
    parts = [_col(c).cast("string") for c in key_cols]
    return F.md5(F.concat_ws(":", *parts, F.lit(f"{seed}{tag}")))


def digest_number(hex_digest, first: int = 1, length: int = 8) -> Column:
    """An integer out of part of a digest."""
    return F.conv(F.substring(_col(hex_digest), first, length), 16, 10).cast("long")


def unit_hash(key_cols: Sequence, seed: int, tag: str = "") -> Column:
    """Uniform in [0, 1), a function of key and seed alone."""
    return digest_number(digest(key_cols, seed, tag)) / F.lit(float(2 ** 32))
