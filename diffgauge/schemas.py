"""Explicit schemas of the landed inputs; nothing is inferred."""

from pyspark.sql import types as T

REVIEW_LINE_RAW = T.StructType([
    T.StructField("label", T.IntegerType()),
    T.StructField("file_dir", T.StringType()),
    T.StructField("change_id", T.StringType()),
    T.StructField("code", T.StringType()),
    T.StructField("raw_code", T.StringType()),
    T.StructField("project", T.StringType()),
    T.StructField("created", T.StringType()),
    T.StructField("deletions", T.IntegerType()),
    T.StructField("additions", T.IntegerType()),
    T.StructField("changed_line", T.IntegerType()),
    T.StructField("line", T.IntegerType()),
    T.StructField("ref", T.StringType()),
])

DIFF_CONTENT = T.ArrayType(T.StructType([
    T.StructField("a", T.ArrayType(T.StringType())),
    T.StructField("b", T.ArrayType(T.StringType())),
    T.StructField("ab", T.ArrayType(T.StringType())),
]))

REVIEW_DIFF = T.StructType([
    T.StructField("change_id", T.StringType()),
    T.StructField("file_dir", T.StringType()),
    T.StructField("base_patch", T.IntegerType()),
    T.StructField("patch_set", T.IntegerType()),
    T.StructField("content", DIFF_CONTENT),
])

REVIEW_LINE = T.StructType([
    T.StructField("label", T.IntegerType()),
    T.StructField("status", T.IntegerType()),
    T.StructField("file_dir", T.StringType()),
    T.StructField("change_id", T.StringType()),
    T.StructField("change_num", T.IntegerType()),
    T.StructField("patch_set", T.IntegerType()),
    T.StructField("shaped_code", T.StringType()),
    T.StructField("before_code", T.StringType()),
    T.StructField("after_code", T.StringType()),
    T.StructField("line", T.IntegerType()),
    T.StructField("ref", T.StringType()),
])

LINE_SCORE = T.StructType([
    T.StructField("dataset", T.StringType()),
    T.StructField("changeId", T.StringType()),
    T.StructField("fileName", T.StringType()),
    T.StructField("lineNumber", T.IntegerType()),
    T.StructField("token", T.StringType()),
    T.StructField("ngramScore", T.DoubleType()),
    T.StructField("groundTruth", T.IntegerType()),
    T.StructField("lengthScore", T.DoubleType()),
])

TOKEN_SCORE = T.StructType([
    T.StructField("dataset", T.StringType()),
    T.StructField("changeId", T.StringType()),
    T.StructField("fileName", T.StringType()),
    T.StructField("lineNumber", T.IntegerType()),
    T.StructField("token", T.StringType()),
    T.StructField("limeScore", T.DoubleType()),
])

ENTROPY = T.StructType([
    T.StructField("line_id", T.LongType()),
    T.StructField("entropy", T.DoubleType()),
])

REVIEW_TIMING = T.StructType([
    T.StructField("dataset", T.StringType()),
    T.StructField("initial_feedback_time", T.DoubleType()),
    T.StructField("percentage_time_cost", T.DoubleType()),
    T.StructField("changed_line", T.IntegerType()),
])
