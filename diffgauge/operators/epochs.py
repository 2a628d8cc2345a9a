"""Early stopping over a table with one row per epoch."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F


def early_stopping(losses: DataFrame, patience: int = 5, epoch: str = "epoch", loss: str = "test_loss") -> DataFrame:
    """The epochs that run before training stops: improved marks a new strict best,
    waited the epochs since the last one; the epoch that uses up the patience is
    the last row. The input has one row per epoch, a hundred at most by design,
    so one ordered window is the right size.
    """
    w = Window.partitionBy(F.lit(0)).orderBy(epoch)
    earlier = F.min(loss).over(w.rowsBetween(Window.unboundedPreceding, -1))
    up_to = w.rowsBetween(Window.unboundedPreceding, 0)
    run = (losses.withColumn("improved", F.coalesce(F.col(loss) < earlier, F.lit(True)))
           .withColumn("waited", F.col(epoch) - F.max(F.when(F.col("improved"), F.col(epoch))).over(up_to)))
    spent = F.count_if(F.col("waited") >= patience).over(w.rowsBetween(Window.unboundedPreceding, -1))
    return run.withColumn("_spent", spent).where(F.coalesce("_spent", F.lit(0)) == 0).drop("_spent")
