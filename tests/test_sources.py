import pytest
from pyspark.sql import functions as F, types as T

from helpers import rows
from diffgauge import schemas
from diffgauge.functions import text as X
from diffgauge.sources import readers, writers
from diffgauge.session import materialize, scratch_dir

ODD = [(1, 'say "hi", x'), (2, "two\nlines"), (3, "back\\slash;"), (4, "a,b;c;;"), (5, "plain")]
SCHEMA = T.StructType([T.StructField("id", T.LongType()), T.StructField("code", T.StringType())])


def test_quoted_csv_round_trip(spark):
    path = scratch_dir(spark)
    writers.csv(spark.createDataFrame(ODD, SCHEMA), path)
    assert rows(readers.csv(spark, path, SCHEMA)) == ODD
    assert rows(readers.csv(spark, path, SCHEMA, ["id"])) == [(i,) for i, _ in ODD]


def test_plain_csv_round_trip(spark):
    path = scratch_dir(spark)
    flat = [r for r in ODD if "\n" not in r[1]]
    writers.plain_csv(spark.createDataFrame(flat, SCHEMA), path)
    assert rows(readers.plain_csv(spark, path, SCHEMA)) == flat


def test_json_diffs_ignore_other_keys(spark):
    path = scratch_dir(spark)
    body = ('{"change_id":"I1","file_dir":"f","base_patch":3,"patch_set":4,"content":[{"ab":["x"],"skip":7},'
            '{"a":["y"],"b":["z"],"due_to_rebase":true}]}')
    spark.createDataFrame([(body,)], "value string").write.text(path)
    content = readers.review_diffs(spark, path).first()["content"]
    assert [(c["a"], c["b"], c["ab"]) for c in content] == [(None, None, ["x"]), (["y"], ["z"], None)]
    parsed = spark.createDataFrame([(body,)], "value string").select(readers.parse_diff(F.col("value")).alias("c")).first()["c"]
    assert parsed == content


def test_range_buckets_prune_folders(spark):
    path = scratch_dir(spark)
    writers.diffs_by_range(spark.range(1, 30001, 50).select(F.col("id").alias("change_num")), path)
    got = readers.bucketed_diffs(spark, path, 10001, 10250)
    assert sorted(r["change_num"] for r in got.collect()) == [10001, 10051, 10101, 10151, 10201]
    plan = got._jdf.queryExecution().executedPlan().toString()
    filters = plan.split("PartitionFilters: [")[1].split("]")[0]
    assert "small_hi" in filters and "big_lo" in filters


def test_asked_changes_open_their_buckets_only(spark):
    path = scratch_dir(spark)
    stored = spark.range(1, 30001, 50).select(F.col("id").alias("change_num"), F.concat(F.lit("d"), "id").alias("diff"))
    writers.diffs_by_range(stored.unionByName(stored.limit(3)), path)
    asked = spark.createDataFrame([(1,), (1,), (51,), (10051,), (29951,), (7,), (99999999,), (None,), (-5,)], "change_num long")
    got = readers.diffs_of(spark, path, asked)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "dynamicpruning" in plan.split("PartitionFilters: [")[1].split("]")[0]
    assert sorted(r["change_num"] for r in got.collect()) == [1, 1, 51, 51, 10051, 29951]
    every = len(spark.read.parquet(path).inputFiles())
    assert every >= 150 and any(0 < n < every / 10 for n in read_files(got)), (every, read_files(got))
    assert readers.diffs_of(spark, path, asked.where("change_num = 7")).count() == 0
    assert readers.diffs_of(spark, path, asked.limit(0)).count() == 0


def read_files(df):
    """Numbers of files the scans of an executed plan opened."""
    found, todo = [], [df._jdf.queryExecution().executedPlan()]
    while todo:
        node = todo.pop()
        if node.getClass().getSimpleName() == "AdaptiveSparkPlanExec":
            todo.append(node.executedPlan())
            continue
        metric = node.metrics().get("numFiles")
        if metric.isDefined():
            found.append(metric.get().value())
        kids = node.children()
        todo += [kids.apply(i) for i in range(kids.size())]
        if node.getClass().getSimpleName().endswith("QueryStageExec"):
            todo.append(node.plan())
    return found


def test_csv_without_newlines_is_cut_into_splits(spark):
    path = scratch_dir(spark)
    flat = spark.range(0, 20000, 1, 1).select("id", F.concat(F.lit('say "x", '), "id").alias("code"))
    writers.csv(flat, path)
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "64KB")
        spark.conf.set("spark.sql.files.openCostInBytes", "1KB")
        cut, whole = (readers.csv(spark, path, SCHEMA, newlines=n) for n in (False, True))
        tasks = [df.select(F.spark_partition_id().alias("p")).distinct().count() for df in (cut, whole)]
        assert tasks[0] > 4 and tasks[1] == 1
        assert rows(cut) == rows(whole) == rows(flat)
        path = scratch_dir(spark)
        odd = [(1, "carriage\rreturn"), (2, 'say "hi", x'), (3, "end\r"), (4, "back\\slash;"), (5, "    indented  "), (6, "\ttab")]
        writers.csv(spark.createDataFrame(odd, SCHEMA), path)
        assert rows(readers.csv(spark, path, SCHEMA, newlines=False)) == odd
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
        spark.conf.unset("spark.sql.files.openCostInBytes")


def test_records_number_and_parse_back(spark):
    routed = spark.createDataFrame(
        [(i, 1 + 2 * (i % 2), "positive" if i % 3 else "negative", f"b{i}\nq", "after [x]", ["it's", 'q"', "a, b"], ["s"] if i else [])
         for i in range(30)] + [(99, 1, "FN", "b", "a", [], [])],
        "row_id long, k int, outcome string, before_code string, after_code string, changed array<string>, suggestion array<string>")
    numbered = writers.numbered_records(routed)
    assert numbered.count() == 30
    for r in numbered.groupBy("k", "outcome").agg(F.sort_array(F.collect_list("log_number")).alias("n")).collect():
        assert r["n"] == list(range(1, len(r["n"]) + 1))
    path = scratch_dir(spark)
    for r in numbered.where("row_id < 3").select("row_id", "log").collect():
        spark.createDataFrame([(r["log"],)], "value string").coalesce(1).write.text(f"{path}/log{r['row_id']}")
    logs = readers.logs(spark, path).collect()
    back = {r["before"]: r for r in logs}
    assert len(logs) == 3 and "b1\nq" in back, logs
    assert back["b1\nq"]["changed"] == ["it's", 'q"', "a, b"] and back["b1\nq"]["after"] == "after [x]"
    assert back["b0\nq"]["suggestion"] == []


def test_log_folder_is_written_and_read_by_many_files_a_task(spark):
    """One file per record, written by several tasks; read back, files share a task instead of a few in each."""
    data = [(1 + i % 3, "positive", i, f"b{i}", f"b{i}\n{X.LOG_SEPARATOR}\na\nchanged_token:['x']\nsuggestion:['y']") for i in range(200)]
    records = spark.createDataFrame(data, "k int, outcome string, log_number long, before string, log string").coalesce(1)
    path = scratch_dir(spark)
    writers.logs(records, path)
    files = [r["p"] for r in spark.read.text(path, wholetext=True, recursiveFileLookup=True).select(
        F.col("_metadata.file_path").alias("p")).collect()]
    assert len(set(files)) == 200
    assert len({p.rsplit("/part-")[1][:5] for p in files}) > 1
    logs = readers.logs(spark, path)
    assert logs.rdd.getNumPartitions() <= 8
    assert sorted(r["before"] for r in logs.collect()) == sorted(d[3] for d in data)


def test_outcomes_keep_every_row(spark):
    path = scratch_dir(spark)
    t = spark.range(10).withColumn("outcome", F.when(F.col("id") > 6, "no_match").otherwise("ok"))
    writers.by_outcome(t, path)
    assert spark.read.parquet(path).count() == 10
    assert spark.read.parquet(path).where("outcome = 'ok'").count() == 7


def test_entropy_file_and_line_id_join(spark):
    path = scratch_dir(spark)
    spark.createDataFrame([(2, .5), (1, .25)], schemas.ENTROPY).write.csv(path)
    lines = spark.createDataFrame([(1, "a"), (2, "b")], "line_id long, code string")
    assert rows(readers.by_line_id(lines, readers.entropies(spark, path))) == [(1, "a", .25), (2, "b", .5)]


class Named:
    """A session as far as the scratch folder looks at it."""

    def __init__(self, folder, master):
        self.conf = {"spark.checkpoint.dir": folder} if folder else {}
        self.sparkContext = type("Context", (), {"master": master})


def test_scratch_folder_is_the_one_the_session_names(spark):
    assert scratch_dir(Named("hdfs://x/shared/", "yarn")).startswith("hdfs://x/shared/diffgauge-")
    assert scratch_dir(Named(None, "local[2]")) != scratch_dir(Named(None, "local[2]"))
    with pytest.raises(RuntimeError):
        scratch_dir(Named(None, "yarn"))
    base = spark.conf.get("spark.checkpoint.dir", None)
    written = materialize(spark.range(5)).inputFiles()[0]
    assert base is None or base in written
