"""Every documented case of the change tracking ends in the right outcome."""

from pyspark.sql import functions as F

from diffgauge import schemas
from diffgauge.operators import changes as J

RAW = "row_id long, label int, file_dir string, change_id string, code string, raw_code string, line int, ref string"


def raw_row(i, needle, label=1, change="I1", patch=3):
    return (i, label, "pkg/a b.py", change, needle, needle, 10 + i, f"refs/changes/21/77/{patch}")


def diff(content, change="I1", base=3, to=4):
    return (change, "pkg/a b.py", base, to, content)


def chunk(a=None, b=None, ab=None):
    return {"a": a, "b": b, "ab": ab}


def run(spark, raws, diffs, **options):
    raw = spark.createDataFrame(raws, RAW)
    d = spark.createDataFrame(diffs, schemas.REVIEW_DIFF)
    out = {}
    for r in J.classify(raw, d, **options).collect():
        out.setdefault(r["row_id"], []).append((r["outcome"], r["label"], r["status"], r["before_code"], r["after_code"]))
    return {k: sorted(v, key=str) for k, v in out.items()}


def test_sides_and_context(spark):
    content = [chunk(ab=["import os"]), chunk(a=["first()", "middle()", "last()"], b=["A", "B", "C", "D"])]
    out = run(spark, [raw_row(1, "+import os"), raw_row(2, "++middle()"), raw_row(3, "first()"), raw_row(4, "last()"),
                      raw_row(5, "B"), raw_row(6, "gone"), raw_row(7, "++"), raw_row(8, "x", label=0)], [diff(content)])
    assert out[1] == [("ok", 0, 2, "+import os", None)]
    assert out[2] == [("ok", 1, 1, "middle()", r"A\nB\nC")]
    assert out[3] == [("ok", 1, 1, "first()", r"\nA\nB")]
    assert out[4] == [("ok", 1, 1, "last()", r"B\nC\nD")]
    assert out[5] == [("ok", 0, 2, "B", None)]
    assert out[6] == [("no_match", None, None, "gone", None)]
    assert out[7] == [("empty_needle", None, None, "++", None)]
    assert out[8] == [("ok", 0, 0, "x", None)]


def test_first_line_wraps_on_request(spark):
    content = [chunk(a=["first()", "x"], b=["A", "B"])]
    assert run(spark, [raw_row(1, "first()")], [diff(content)], wrap_first=True)[1] == [("ok", 1, 1, "first()", r"B\nA\nB")]


def test_missing_and_short_new_side(spark):
    out = run(spark, [raw_row(1, "del()")], [diff([chunk(a=["del()"])])])
    assert out[1] == [("ok", 1, 1, "del()", r"\n\n")]
    out = run(spark, [raw_row(1, "second()")], [diff([chunk(a=["f", "second()"], b=["only second()"])])])
    assert out[1] == [("not_found", None, None, "second()", None)]      # the new side is not looked at either
    out = run(spark, [raw_row(1, "abcd")], [diff([chunk(a=["ab", "cd"], b=["x", "y"])])])
    assert out[1] == [("not_found", None, None, "abcd", None)]


def test_several_chunks_and_double(spark):
    content = [chunk(ab=["call()"]), chunk(a=["call()"], b=["n1"]), chunk(a=["z", "call() + 1"], b=["m1", "m2"])]
    out = run(spark, [raw_row(1, "call()")], [diff(content)])
    assert [o[0] for o in out[1]] == ["double", "ok", "ok", "ok"]
    assert {o[4] for o in out[1] if o[2] == 1} == {r"\nn1\n", r"m1\nm2\n"}
    assert (("ok", 1, 1, "call() + 1", r"m1\nm2\n")) in out[1]


def test_forward_lookup(spark):
    c = [chunk(a=["x()"], b=["y()"])]
    far = run(spark, [raw_row(1, "x()")], [diff([chunk(a=["no"])], to=6), diff(c, to=5)])
    assert far[1][0][0] == "ok"
    assert run(spark, [raw_row(1, "x()")], [diff(c, to=7)])[1][0][0] == "missed_diff"
    assert run(spark, [raw_row(1, "x()")], [diff(c, base=2, to=4)])[1][0][0] == "missed_diff"


def test_every_row_is_accounted_for(spark):
    content = [chunk(a=[f"line {i}" for i in range(20)], b=[f"new {i}" for i in range(5)], ab=["line 3"])]
    raws = [raw_row(i, f"line {i % 25}", label=i % 3 and 1) for i in range(100)]
    assert set(run(spark, raws, [diff(content)])) == set(range(100))


def test_further_list_sides_are_cautioned(spark):
    raw = spark.createDataFrame([raw_row(1, "odd()")], RAW)
    shape = "change_id string, file_dir string, base_patch int, patch_set int, content array<struct<a:array<string>,b:array<string>,ab:array<string>,skip:int,extra:array<string>>>"
    d = spark.createDataFrame([("I1", "pkg/a b.py", 3, 4, [(None, None, None, 5, ["odd()"])])], shape)
    got = [(r["outcome"], r["label"]) for r in J.classify(raw, d).collect()]
    assert got == [("caution", None)]


def test_lookup_keeps_bodies_out_of_the_row_join(spark):
    raw = J.parse_raw(spark.createDataFrame([raw_row(1, "x")], RAW))
    plan = J.lookup(raw, spark.createDataFrame([diff([chunk(a=["x"])])], schemas.REVIEW_DIFF)).select("row_id", "found_patch")
    assert "Cartesian" not in plan._jdf.queryExecution().executedPlan().toString()
    assert plan.where(F.col("found_patch") == 4).count() == 1


def test_ids_of_a_long_conversation(spark, tmp_path):
    """Ids stay apart whatever the number of turns: packed ones met after a thousand."""
    from diffgauge.plans import roles as R
    rows = [(c, t, "user", f"a {c} {t}\nb") for c, n in ((1, 1005), (2, 5)) for t in range(n)]
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").write.parquet(
        f"{tmp_path}/conversations.parquet")
    pairs = R.pairs(spark, str(tmp_path))
    assert pairs.count() == pairs.select("row_id").distinct().count() == 1004 + 4
    raw = R.review_raw(spark, str(tmp_path))
    assert raw.count() == raw.select("row_id").distinct().count() == 2 * 1010


def test_no_term_is_dropped(spark):
    """A vocabulary of any width reaches the model: 9,000 terms in two of five files each."""
    from diffgauge.operators.features import feature_pipeline
    files = spark.createDataFrame([(i, " ".join(f"t{j}" for j in range(9000)) if i < 2 else "alone") for i in range(5)],
                                  "file long, code string")
    vectors = feature_pipeline("code").fit(files).transform(files)
    assert {r["features"].size for r in vectors.collect()} == {9000}
