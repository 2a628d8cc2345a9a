"""Readers with explicit schemas; projections and filters reach the scan."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from diffgauge import schemas
from diffgauge.functions.text import LOG_SEPARATOR, range_bucket, unquoted_items
from diffgauge.operators.joins import measured_lookup
from diffgauge.session import materialize, tune

BIG_STEP, SMALL_STEP = 10_000, 200      # fixed values: range buckets of change numbers
BUCKETS = ("big_lo", "big_hi", "small_lo", "small_hi")


def table(spark: SparkSession, folder: str, name: str, columns: Sequence[str] | None = None) -> DataFrame:
    df = spark.read.parquet(f"{folder}/{name}.parquet")
    return df.select(*columns) if columns else df


def csv(spark: SparkSession, path: str, schema: T.StructType, columns: Sequence[str] | None = None,
        header: bool = True, newlines: bool = True) -> DataFrame:
    """CSV whose fields may hold quotes and newlines. Without a header the schema
    names the columns by position.

    A quoted newline can be told from a row's end only from the file's start, so such a file is read by one task.
    With ``newlines=False`` the caller declares that no field holds one, and files are cut into splits; rows then
    end in a newline alone, as the writers end them, and a carriage return is part of its field.
    """
    options = {"header": header, "quote": '"', "escape": '"'} | ({"multiLine": True} if newlines else {"lineSep": "\n"})
    df = spark.read.schema(schema).options(**options).csv(path)
    return df.select(*columns) if columns else df


def plain_csv(spark: SparkSession, path: str, schema: T.StructType, header: bool = True,
              escape: str = ";") -> DataFrame:
    """CSV written without quotes, special characters behind an escape character.

    A field runs to the next bare separator, so lines are read as text, cut into
    fields and unescaped. Fields with newlines cannot be told apart in this format.
    """
    e = "\\" + escape
    lines = spark.read.text(path)
    if header:
        names = ",".join(f.name for f in schema.fields)
        lines = lines.where(F.col("value") != names)
    cells = F.regexp_extract_all("value", F.lit(rf"((?:[^,{e}]++|{e}.)*+)(?:,|$)"), 1)
    return lines.select(cells.alias("_c")).select(*[
        F.regexp_replace(F.col("_c")[i], rf"{e}(.)", "$1").cast(f.dataType).alias(f.name)
        for i, f in enumerate(schema.fields)])


def review_diffs(spark: SparkSession, path: str) -> DataFrame:
    """Landed diffs, one JSON document per line."""
    return spark.read.schema(schemas.REVIEW_DIFF).json(path)


def parse_diff(body) -> Column:
    """Diff content out of a JSON string column."""
    shape = T.StructType([T.StructField("content", schemas.DIFF_CONTENT)])
    return F.from_json(body, shape)["content"]


MOST_BUCKETS = 200_000      # bucket folders asked for that may be broadcast: 16 bytes each


def diffs_of(spark: SparkSession, path: str, asked: DataFrame, number: str = "change_num") -> DataFrame:
    """The bucketed diffs of the change numbers in ``asked``, read from their bucket folders only.

    The asked numbers fold to their buckets, far fewer than there are changes. As partition columns these meet
    the scan before it lists its files: Spark sends the broadcast buckets there as a pruning filter, and no file of
    another bucket is opened. Beyond the bound the buckets are not broadcast and every folder is read.
    """
    numbers = materialize(asked.where(F.col(number) >= 1).select(number).distinct())
    # change numbers start at 1; Spark prunes by a side only where it sees a condition on it
    big, small = range_bucket(number, BIG_STEP), range_bucket(number, SMALL_STEP)
    buckets = numbers.where(F.col(number) >= 1).select(big["lo"].alias("big_lo"), small["lo"].alias("small_lo")).distinct()
    few = buckets.count() <= MOST_BUCKETS
    inside = spark.read.schema(bucket_schema(spark, path)).parquet(path).join(
        F.broadcast(buckets) if few else buckets, ["big_lo", "small_lo"], "left_semi")
    return measured_lookup(inside, numbers, [number], "left_semi")


def bucket_schema(spark: SparkSession, path: str) -> T.StructType:
    """The stored columns with the bucket columns as longs, as they were written."""
    found = spark.read.parquet(path).schema
    return T.StructType([T.StructField(f.name, T.LongType() if f.name in BUCKETS else f.dataType) for f in found])


def bucketed_diffs(spark: SparkSession, path: str, lo: int | None = None, hi: int | None = None) -> DataFrame:
    """Diffs stored under range buckets of their change number; the bounds prune
    whole buckets before any file is opened."""
    df = spark.read.parquet(path)
    if lo is not None:
        df = df.where((F.col("big_hi") >= lo) & (F.col("small_hi") >= lo) & (F.col("change_num") >= lo))
    if hi is not None:
        df = df.where((F.col("big_lo") <= hi) & (F.col("small_lo") <= hi) & (F.col("change_num") <= hi))
    return df


_LOG = (r"(?s)^(.*)\n" + LOG_SEPARATOR + r"\n(.*)\nchanged_token:\[([^\n]*)\]\nsuggestion:\[([^\n]*)\]\s*$")


def parse_log(text) -> dict:
    """The four parts of a text log; lists come back as string arrays."""
    return {"before": F.regexp_extract(text, _LOG, 1), "after": F.regexp_extract(text, _LOG, 2),
            "changed": unquoted_items(F.regexp_extract(text, _LOG, 3)),
            "suggestion": unquoted_items(F.regexp_extract(text, _LOG, 4))}


LOG_OPEN_COST = 64 << 10        # a log is short: hundreds share a task


def logs(spark: SparkSession, path: str) -> DataFrame:
    """(path, before, after, changed, suggestion) of a folder of log files.

    The engine counts a file as 4 MB at least, so a task would get a few logs only, and lists each folder of
    many in a task of its own. A session of its own counts and lists them by hundreds.
    """
    own = tune(spark.newSession())
    for name in ("spark.sql.files.maxPartitionBytes", "spark.sql.shuffle.partitions"):
        own.conf.set(name, spark.conf.get(name))
    own.conf.set("spark.sql.files.openCostInBytes", str(LOG_OPEN_COST))
    own.conf.set("spark.sql.sources.parallelPartitionDiscovery.parallelism", str(8 * spark.sparkContext.defaultParallelism))
    raw = own.read.text(path, wholetext=True, recursiveFileLookup=True)
    return raw.select(F.col("_metadata.file_path").alias("path"),
                      *[c.alias(n) for n, c in parse_log(F.col("value")).items()])


def entropies(spark: SparkSession, path: str) -> DataFrame:
    """Headerless two-column file of numbers: line_id, entropy."""
    return csv(spark, path, schemas.ENTROPY, header=False, newlines=False)


def by_line_id(lines: DataFrame, scores: DataFrame, key: str = "line_id") -> DataFrame:
    """Lines with their scores by a carried key, never by file order."""
    return lines.join(scores, key, "inner")

