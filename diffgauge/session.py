"""Session settings and the shared scratch folder."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

# Runtime settings every job relies on. AQE splits skewed join partitions even
# when that costs one more shuffle; without the force flag it would leave a hot
# key alone whenever an aggregation on the same key follows the join. Static
# broadcasting is off: its size estimate ignores that an exploded text grows.
# AQE still broadcasts a side once its shuffled size has been measured; tables
# with a known bound (one row, a fixed word list) carry an explicit hint.
RUNTIME_SETTINGS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    "spark.sql.autoBroadcastJoinThreshold": "-1",
    "spark.sql.adaptive.autoBroadcastJoinThreshold": "32MB",
    # hash instead of sort-merge where every measured partition is this small
    "spark.sql.adaptive.maxShuffledHashJoinLocalMapThreshold": "64MB",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def tune(spark: SparkSession) -> SparkSession:
    """Apply the runtime settings to an existing session."""
    for name, value in RUNTIME_SETTINGS.items():
        spark.conf.set(name, value)
    return spark


def local_session(cores: int | str = "*", shuffle_partitions: int = 8,
                  memory: str = "8g") -> SparkSession:
    """A session for tests and the bench; clusters bring their own."""
    spark = (SparkSession.builder.master(f"local[{cores}]").appName("diffgauge")
             .config("spark.ui.enabled", "false")
             .config("spark.ui.showConsoleProgress", "false")
             .config("spark.driver.memory", memory)
             .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
             .getOrCreate())
    spark.sparkContext.setLogLevel("ERROR")
    return tune(spark)


def ship(spark: SparkSession) -> SparkSession:
    """Send the package to the executors once per application, wherever the driver was started."""
    context = spark.sparkContext
    if getattr(context, "_diffgauge_shipped", False):
        return spark
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    folder = tempfile.mkdtemp(prefix="diffgauge-package-")      # the driver serves the archive from here
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    context.addPyFile(shutil.make_archive(f"{folder}/diffgauge", "zip", root, "diffgauge"))
    context._diffgauge_shipped = True
    return spark


_local_base: str | None = None


def scratch_dir(spark: SparkSession) -> str:
    """A fresh path below the folder the cluster names in ``spark.checkpoint.dir``.

    A machine-local folder is used only by a local session that names none.
    """
    global _local_base
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
        _local_base = _local_base or tempfile.mkdtemp(prefix="diffgauge-")
        base = _local_base
    return f"{base.rstrip('/')}/diffgauge-{uuid.uuid4().hex}"


def materialize(df: DataFrame) -> DataFrame:
    """Write a table that several branches reuse and read it back.

    The copy lives in the shared folder, so a lost executor costs a re-read and
    not a recomputation, and every branch sees the same rows.
    """
    path = scratch_dir(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def spread(df: DataFrame) -> DataFrame:
    """Rebalance an input that arrives in fewer splits than there are cores.

    Large inputs have more splits than cores and pass through unchanged.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df
