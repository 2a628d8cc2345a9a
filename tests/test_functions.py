import json
import re
from urllib.parse import quote

from pyspark.sql import functions as F

from diffgauge.functions import nested as S, numbers as N, text as X


def one(spark, expr, **values):
    df = spark.range(1).select(*[F.lit(v).alias(k) for k, v in values.items()]) if values else spark.range(1)
    return df.select(expr.alias("out")).first()["out"]


def test_percent_encode_matches_rfc(spark):
    for path in ("pkg/a b~c*d+é.py", "", "x&y=%/'()!", "-_."):
        assert one(spark, X.percent_encode("p"), p=path) == quote(path, safe="")


def test_ref_and_buckets(spark):
    assert one(spark, X.change_number("r"), r="refs/changes/21/4321/3") == 4321
    assert one(spark, X.patch_number("r"), r="refs/changes/21/4321/3") == 3
    for n, lo, hi in ((1, 1, 200), (200, 1, 200), (201, 201, 400)):
        got = one(spark, X.range_bucket("n", 200), n=n)
        assert (got["lo"], got["hi"]) == (lo, hi)


def test_line_forms(spark):
    assert one(spark, X.strip_plus("c"), c="+++ a+b") == " a+b"
    assert one(spark, X.with_markers("c"), c="x <NUMBER>") == "<s> x NUM </s>"
    assert one(spark, X.with_markers("c", spaced_end=False), c="x") == "<s> x</s>"
    assert one(spark, X.with_markers(F.lit(None).cast("string"), null_as_nan=True)) == "<s> nan </s>"
    scored = one(spark, X.with_markers("c", spaced_end=False), c="a  b")
    assert one(spark, X.tokens_per_line("c"), c="a  b") == len(scored.split(" ")) - 2
    for line in ("", "   ", " a  b\tc ", "x"):
        assert one(spark, X.words_per_line("c"), c=line) == len(line.split())
        assert sorted(one(spark, X.line_tokens("c"), c=line)) == sorted(set(line.lower().split()))
    assert one(spark, X.capitalise("c"), c="dEMO base") == "Demo base"


def test_fixed_window(spark):
    w = one(spark, X.fixed_window(F.array(*[F.lit(i) for i in range(5)]), 3))
    assert list(w["input_ids"]) == [0, 1, 2] and list(w["attention_mask"]) == [1, 1, 1]
    w = one(spark, X.fixed_window(F.array(F.lit(9)), 3))
    assert list(w["input_ids"]) == [9, 1, 1] and list(w["attention_mask"]) == [1, 0, 0]


def test_numbers(spark):
    assert one(spark, N.false_alarm(F.lit(0), F.lit(0))) == 0.0
    assert one(spark, N.recall(F.lit(0), F.lit(0))) is None
    assert one(spark, N.f1(F.lit(0.0), F.lit(0.0))) is None
    assert one(spark, N.fill(F.lit(float("nan")))) == 0.0
    assert one(spark, N.above(F.lit(0.5))) == 0
    assert abs(one(spark, N.mcc(F.lit(3), F.lit(1), F.lit(2), F.lit(4))) - 10 / (4 * 5 * 5 * 6) ** 0.5) < 1e-12
    assert one(spark, N.percent_change(F.lit(3.0), F.lit(0.0))) == 200.0


def test_needles(spark):
    block = F.array(F.lit("ab"), F.lit("cd"))
    assert one(spark, X.block_contains(block, F.lit("bc"))) is True
    assert one(spark, X.first_line_with(block, F.lit("bc"))) == 0
    assert one(spark, X.first_line_with(block, F.lit("d"))) == 2


def test_xml(spark):
    xml = ('<unit xmlns:diff="urn:d"><diff:delete><name>oldName</name><diff:common><name>kept</name></diff:common>'
           '</diff:delete><diff:insert><name>newName</name></diff:insert></unit>')
    assert list(one(spark, S.texts_under("x", "diff:delete", "name", "diff:common"), x=xml)) == ["oldName"]
    assert list(one(spark, S.search_key("x", "name"), x=xml)) == ["oldName", "kept", "newName"]
    assert list(one(spark, S.texts_without("x", "diff:common"), x=xml)) == ["oldName", "newName"]
    assert one(spark, S.is_wellformed("x"), x="<a><b></a>") is False


def test_lists_of_any_depth(spark):
    """Depth 1 to 6 and uneven, against a plain recursion; marks inside texts, empty lists, nulls, no list at all."""
    def flat(v):
        return [y for x in v for y in flat(x)] if isinstance(v, list) else [v]
    inner = ["a, b", "[c]", 'say "d"', "back\\slash\\", "", " e ", "line\nbreak", "\u00e9\u4e16"]
    values = [inner]
    for i in range(5):
        values.append([values[-1], [], f"level {i}", [[None, str(i)]]])
    for v in [*values, [], [[], [[]]], ["x"]]:
        assert one(spark, S.flatten_all("j"), j=json.dumps(v)) == flat(v)
        assert one(spark, S.flatten_all("j"), j=json.dumps(v, ensure_ascii=False, indent=1)) == flat(v)
    assert one(spark, S.flatten_all("j"), j="[1, [2.5, [true]], null]") == ["1", "2.5", "true", None]
    assert one(spark, S.flatten_all("j"), j='"alone"') == ["alone"]
    assert one(spark, S.flatten_all(F.lit(None).cast("string"))) is None
    long = [["w"] * 50000, [["v"] * 50000]]
    assert len(one(spark, S.flatten_all("j"), j=json.dumps(long))) == 100000
    marks = '\n"\\' * 100000          # one item of escapes only
    assert one(spark, S.flatten_all("j"), j=json.dumps([[[marks]], ["end"]])) == [marks, "end"]


def test_blanks_and_digits_of_any_script(spark):
    blanks = [chr(c) for c in range(0x3100) if chr(c).isspace()]
    for line in ("".join(f"w{b}" for b in blanks), "\u3000lead\u00a0mid trail\u2003", "\u00a0 \u2028", "zero\u200bwidth stays"):
        assert one(spark, X.words_per_line("c"), c=line) == len(line.split())
        assert list(one(spark, X.line_words("c"), c=line)) == line.split()
        assert one(spark, X.strip_space("c"), c=line) == line.strip()
    for line in ("a1b22", "\u0663\u0664 x", "\uff11\uff12", "\u00b2 no digit"):
        assert one(spark, X.mask_digits("c"), c=line) == re.sub(r"\d+", "NUM", line)
