"""The ranking of lines by their number of top tokens: every file is ranked, ties are kept."""

import pytest

from diffgauge.operators import sweep
from diffgauge.plans.registry import load

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def plans():
    return load()[0]


def test_top_lines_by_hits(spark, plans):
    want, by_file = [], {}
    for r in plans["D2_lines_with_counts"](spark, FOLDER).collect():
        by_file.setdefault(r["fileName"], []).append((r["numTopK"], r["lineNumber"], r["groundTruth"]))
    for name, lines in by_file.items():
        least = sorted((n for n, _, _ in lines), reverse=True)[:10][-1]
        want += [(name, line, n, truth) for n, line, truth in lines if n >= least]
    got = plans["F2_top_lines_by_hits"](spark, FOLDER).select("fileName", "lineNumber", "numTopK", "groundTruth").collect()
    assert sorted(map(tuple, got)) == sorted(want)
    share = {r["fileName"]: (r["top"], r["total_true"]) for r in plans["M10_top10_share_by_hits"](spark, FOLDER).collect()}
    assert share == {f: (sum(w[3] for w in want if w[0] == f), sum(x[2] for x in by_file[f])) for f in by_file}
    acc = {r["dataset"]: r["top10_acc"] for r in plans["M11_top10_accuracy_by_hits"](spark, FOLDER).collect()}
    assert acc["all"] == round(100 * sum(top > 0 for top, _ in share.values()) / len(share), 6)


def test_marked_tokens_equal_the_joined_top_tokens(spark):
    """Ties at the cut, files of few tokens, no positive score, null score, a repeated token."""
    data = [("d", 1, 1, line, f"t{(line * 7 + j) % 9}", [3.0, 2.0, 2.0, 1.0, 0.0, -1.0, 0.5, 2.0, None][(line * 7 + j) % 9])
            for line in range(6) for j in range(4)]
    data += [("d", 1, 2, 1, "only", 0.25), ("d", 1, 3, 1, "none", 0.0), ("d", 1, 3, 2, "below", -2.0)]
    tokens = spark.createDataFrame(data, "dataset string, changeId int, fileName int, lineNumber int, token string, limeScore double")
    for k in (1, 2, 3, 10):
        got = {tuple(r) for r in sweep.marked_tokens(tokens, k).where("is_top").select("fileName", "lineNumber", "token").collect()}
        want = set()
        for file in (1, 2, 3):
            score = {t: s for _, _, f, _, t, s in data if f == file and s is not None and s > 0}
            top = {t for t, s in score.items() if sum(o > s for o in score.values()) < k}
            want |= {(f, n, t) for _, _, f, n, t, _ in data if f == file and t in top}
        assert got == want and sweep.marked_tokens(tokens, k).count() == len(data)


def test_levels_of_files_mark_lines_as_the_token_table_does(spark):
    """Files scored as a whole and lines that meet their levels: ties at the cut, repeated files, a null in a file's key."""
    weight = {f"t{i}": [3.0, 2.0, 2.0, 1.0, 0.0, -1.0, 0.5, 2.0, None][i] for i in range(9)}
    texts = [("d", 1, f, [[f"t{(n * 7 + j * f) % 9}" for j in range(4)] for n in range(6)]) for f in (1, 2, 2, 3)]
    texts += [("d", 1, 4, [["only"], [], ["t5"]]), (None, 1, 5, [["t0"], ["t1"]])]
    lines = [(d, c, f, n, sorted(set(words))) for d, c, f, text in texts for n, words in enumerate(text)]
    kinds = "dataset string, changeId int, fileName int, "
    table = spark.createDataFrame([(d, c, f, n, t, weight.get(t)) for d, c, f, n, words in lines for t in words],
                                  kinds + "lineNumber int, token string, limeScore double")
    rows = spark.createDataFrame(lines, kinds + "lineNumber int, tokens array<string>")
    for k in (1, 2, 3, 10):
        tops = sweep.top_levels(table.drop("lineNumber"), k)
        held = sweep.with_held(rows.join(tops, list(sweep.FILE_KEYS), "left"))
        key = ["dataset", "fileName", "lineNumber"]
        want = sorted(map(str, sweep.marked_tokens(table, k).select(*key, "token", "is_top").collect()))
        assert sorted(map(str, sweep.marked_lines(held.drop("tops", "top")).select(*key, "token", "is_top").collect())) == want
        cuts = {(r["dataset"], r["fileName"]): r["cuts"] for r in sweep.top_k_cuts(table, "token", "limeScore", sweep.FILE_KEYS, [0, k]).collect()}
        assert {(r["dataset"], r["fileName"]): r["cuts"] for r in sweep.cuts_of_levels(tops, [0, k]).collect()} == cuts
        counted = held.select(*sweep.FILE_KEYS, "lineNumber", *sweep.line_top_counts(), sweep.best_of_line().alias("_best"))
        got = sweep.joined_lines(counted, [("numTopK", "sum"), ("_best", "max")]).collect()
        top = {(r["dataset"], r["fileName"]): {t for v in r["tops"] for t in v["tokens"]} for r in tops.collect() if r["dataset"]}
        assert len(got) == len(lines)
        for r in got:
            same = [w for d, _, f, n, w in lines if (d, f, n) == (r["dataset"], r["fileName"], r["lineNumber"]) and d]
            found = [t for w in same for t in w if t in top.get((r["dataset"], r["fileName"]), ())]
            assert (r["numTopK"] or 0) == len(found) and r["_best"] == max((weight[t] for t in found), default=None)
