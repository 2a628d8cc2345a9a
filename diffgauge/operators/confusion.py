"""Confusion counts and the rates derived from them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from diffgauge.functions import numbers as N


def _bool(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def confusion(df: DataFrame, truth, predicted, groups: Sequence[str] = (),
              prefix: str = "") -> DataFrame:
    """TP, FN, FP, TN per group by conditional counts (one partial aggregation).

    ``truth`` and ``predicted`` are boolean columns; a null prediction counts as
    not predicted.
    """
    return df.groupBy(*groups).agg(*confusion_columns(truth, predicted, prefix))


def confusion_columns(truth, predicted, prefix: str = "") -> list[Column]:
    t = F.coalesce(_bool(truth), F.lit(False))
    p = F.coalesce(_bool(predicted), F.lit(False))
    return [F.count_if(t & p).alias(f"{prefix}tp"), F.count_if(t & ~p).alias(f"{prefix}fn"),
            F.count_if(~t & p).alias(f"{prefix}fp"), F.count_if(~t & ~p).alias(f"{prefix}tn")]


def with_detection_rates(df: DataFrame, prefix: str = "") -> DataFrame:
    """Recall (null without positives), false-alarm rate and distance to heaven."""
    p = prefix
    return (df.withColumn(f"{p}recall", N.recall(f"{p}tp", f"{p}fn"))
            .withColumn(f"{p}far", N.false_alarm(f"{p}fp", f"{p}tn"))
            .withColumn(f"{p}d2h", N.distance_to_heaven(f"{p}recall", f"{p}far")))


def with_class_rates(df: DataFrame) -> DataFrame:
    """Precision, recall, F1 and MCC; 0 where a denominator is 0."""
    tp, fp, fn, tn = (F.col(c) for c in ("tp", "fp", "fn", "tn"))
    return (df.withColumn("precision", N.ratio_or_zero(tp, tp + fp))
            .withColumn("recall", N.ratio_or_zero(tp, tp + fn))
            .withColumn("f1", F.coalesce(N.ratio(2 * tp, 2 * tp + fp + fn), F.lit(0.0)))
            .withColumn("mcc", N.mcc(tp, fp, fn, tn)))


def epoch_table(predictions: DataFrame, epoch: str = "epoch", label: str = "label",
                prob: str = "prob", threshold: float = 0.5) -> DataFrame:
    """One row per checkpoint from a long prediction table, in one aggregation."""
    counts = confusion(predictions, F.col(label) == 1, F.col(prob) > threshold, [epoch])
    rates = with_detection_rates(counts.withColumn(
        "f1", F.coalesce(N.ratio(2 * F.col("tp"), 2 * F.col("tp") + F.col("fp") + F.col("fn")),
                         F.lit(0.0))))
    # a set without positives has recall 0 in this table
    rec = F.coalesce(F.col("recall"), F.lit(0.0))
    return rates.select(epoch, "f1", rec.alias("recall"), "far",
                        N.distance_to_heaven(rec, F.col("far")).alias("d2h"))


def class_weights(df: DataFrame, label: str, groups: Sequence[str] = ()) -> DataFrame:
    """Class counts, inverse-frequency weights that sum to 1, the positive class
    weight n0/n1, and the balanced weights n / (2 n_class)."""
    n = df.groupBy(*groups).agg(F.count_if(F.col(label) == 0).alias("n0"),
                                F.count_if(F.col(label) == 1).alias("n1"))
    inv0, inv1 = N.ratio(F.lit(1.0), "n0"), N.ratio(F.lit(1.0), "n1")
    total = F.col("n0") + F.col("n1")
    return n.select(*groups, "n0", "n1",
                    (inv0 / (inv0 + inv1)).alias("w0"), (inv1 / (inv0 + inv1)).alias("w1"),
                    N.ratio("n0", "n1").alias("pos_weight"),
                    N.ratio(total, 2 * F.col("n0")).alias("balanced0"),
                    N.ratio(total, 2 * F.col("n1")).alias("balanced1"))


# The names of the long metric table.
MEASURES = {"AUC": "auc", "Precision": "precision", "Recall": "recall", "F1 measure": "f1",
            "MCC": "mcc", "true negative": "tn", "false positive": "fp",
            "false negative": "fn", "true positive": "tp"}


def metric_rows(wide: DataFrame, technique: str = "Technique", dataset: str = "Datasets") -> DataFrame:
    """Wide metrics to one row per (technique, dataset, measure)."""
    named = wide.select(technique, dataset,
                        *[F.col(c).cast("double").alias(m) for m, c in MEASURES.items()])
    return named.unpivot([technique, dataset], list(MEASURES), "Measure", "Value")
