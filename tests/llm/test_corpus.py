"""N-gram join, benchmark leaks, quality and the pipeline against plain restatements."""

import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from diffgauge.llm import decontaminate, ngram_join, quality, queries, secret_scan
from diffgauge.llm.common import table

from llm_rows import FOLDER, SCHEMA, odd_rows


def plain_groups(texts, similarity=0.8):
    """Group (smallest index) and links of each text, by comparing all that share an n-gram."""
    sets = [frozenset(ngram_join.ngram_set(t or "").tolist()) for t in texts]
    by_gram, common = defaultdict(list), Counter()
    for i, s in enumerate(sets):
        for g in s or {"none"}:
            by_gram[g].append(i)
    for own in by_gram.values():
        for x, i in enumerate(own):
            for j in own[:x]:
                common[j, i] += 1
    root, links = list(range(len(texts))), Counter()

    def find(x):
        while root[x] != x:
            x = root[x]
        return x
    for (i, j), c in common.items():
        if not sets[i] or c >= similarity * (len(sets[i]) + len(sets[j]) - c) - 1e-9:
            links[i] += 1
            links[j] += 1
            a, b = find(i), find(j)
            root[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(texts))], links


def copies(n=400, seed=3):
    """Families of edited copies, tight and loose, so that groups need several stars."""
    rnd = random.Random(seed)
    words = [f"w{i}" for i in range(5000)]
    out = []
    for _ in range(12):
        first = [rnd.choice(words) for _ in range(rnd.choice([30, 120, 300]))]
        family = [first]
        for _ in range(n // 12):
            ws = list(rnd.choice(family[-6:]))
            for _ in range(rnd.randint(0, 3)):
                ws[rnd.randrange(len(ws))] = rnd.choice(words)
            family.append(ws)
        out += [" ".join(ws) for ws in family]
    return out + ["a b c", "A, b c!", "", None, "one two three four five", "one two three four six"]


def test_band_choice():
    for s, recall in ((0.8, 0.9999), (0.5, 0.99), (0.95, 0.999)):
        b, r = ngram_join.bands_and_rows(s, recall)
        assert 1 - (1 - s ** r) ** b >= recall and b * r <= ngram_join.HASHES


def test_join_equals_brute_force(spark):
    texts = copies()
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(5)
    root, links = plain_groups(texts)
    got = {r["doc_id"]: r for r in ngram_join.join(docs).collect()}
    assert len(got) == len(texts) and len(set(root)) < len(texts) / 2
    assert {i: (r["class_id"], r["n_links"]) for i, r in got.items()} == {
        i: (root[i], links[i]) for i in range(len(texts))}
    kept = [r["doc_id"] for r in ngram_join.keep_one(docs).collect()]
    assert sorted(kept) == sorted(set(root))


def test_join_odd_rows(odd, none):
    rows = odd_rows()
    got = ngram_join.join(odd).collect()
    assert len(got) == len(rows)
    _, links = plain_groups([r[1] for r in rows])
    assert sorted(r["n_links"] for r in got) == sorted(links[i] for i in range(len(rows)))
    kept = ngram_join.keep_one(odd)
    assert kept.columns == odd.columns and ngram_join.join(none).count() == 0
    groups = len(set(plain_groups([r[1] for r in rows])[0]))
    assert kept.count() == groups == ngram_join.keep_one(kept).count()


def test_leaks(spark, odd, none):
    docs, bench = table(spark, FOLDER, "documents"), table(spark, FOLDER, "benchmark")
    items = {r["item_id"]: decontaminate.words_of(r["text"]) for r in bench.collect()}
    want = set()
    for r in docs.collect():
        there = " " + " ".join(decontaminate.words_of(r["text"])) + " "
        want |= {(r["doc_id"], i) for i, ws in items.items() if " " + " ".join(ws) + " " in there}
    rows = decontaminate.leaks(docs, bench).collect()
    found = {(r["doc_id"], r["item_id"]) for r in rows}
    assert want <= found and len(want) >= 3 and all(r["score"] >= decontaminate.LIMIT - 1e-9 for r in rows)
    kept = {r["doc_id"] for r in decontaminate.clean(docs, bench).collect()}
    assert kept == {r["doc_id"] for r in docs.collect()} - {d for d, _ in found}
    # several indexes give the same pairs and scores
    split = list(decontaminate.indexes(bench, 2000))
    assert len(split) > 2
    texts = [(r["doc_id"], r["text"]) for r in docs.collect()]
    again = {(texts[d][0], ix.items[i][0], round(s, 9)) for own in split
             for d, ix, i, s, *_ in decontaminate._found(own, [t for _, t in texts])}
    assert again == {(r["doc_id"], r["item_id"], round(r["score"], 9)) for r in rows}
    assert decontaminate.leaks(none, bench).count() == 0
    empty = spark.createDataFrame([(1, None), (2, ""), (None, "...")], "item_id long, text string")
    assert decontaminate.leaks(odd, empty).count() == 0
    assert decontaminate.clean(odd, empty).count() == len(odd_rows())
    short = spark.createDataFrame([(1, "no id"), (None, "spaces tab"), (1, "no id")], "item_id long, text string")
    assert sorted((str(r["doc_id"]), str(r["item_id"])) for r in decontaminate.leaks(odd, short).collect()) == [
        ("34", "None"), ("None", "1")]
    assert decontaminate.clean(odd, short).columns == odd.columns


def test_retrieval_is_exact(spark):
    """Every passage and item above the limit is found: all scores are computed for comparison."""
    rnd = random.Random(9)
    words = [f"t{int(rnd.paretovariate(0.7))}" for _ in range(4000)]
    items = [(i, " ".join(rnd.sample(words, rnd.randint(8, 40)))) for i in range(60)]
    texts = []
    for _ in range(80):
        ws = rnd.sample(words, 150)
        for _, t in rnd.sample(items, 3):
            own = [w for w in t.split() if rnd.random() < 0.75]
            at = rnd.randrange(len(ws))
            ws[at:at] = own
        texts.append(" ".join(ws))
    bench = spark.createDataFrame(items, "item_id long, text string")
    (own,) = decontaminate.indexes(bench)
    assert [index.stride for index in own] == [32, 64]
    docs = [decontaminate.words_of(t) for t in texts]
    for index in own:
        got = {(d, i): s for d, i, s, *_ in index.hits(docs)}
        want, names, s = {}, list(index.terms), index.stride
        for d, ws in enumerate(docs):
            for start in range(0, len(ws), s):
                held = ws[start:start + 2 * s]
                for i, weights in enumerate(index.weights):
                    score = sum(v for k, v in weights.items() if names[k] in held)
                    if score >= decontaminate.LIMIT and min(index.overlap(i, held)) >= decontaminate.OVERLAP:
                        want[d, i] = max(want.get((d, i), 0), score)
        assert got.keys() == want.keys() and len(want) > 5
        assert all(abs(got[k] - v) < 1e-9 for k, v in want.items())


def test_a_long_item_changes_no_other_hit(spark):
    """Phrases of an item that lie a thousand words apart are no passage, whatever else the benchmark holds."""
    rnd = random.Random(4)
    filler = lambda n: [f"f{rnd.randrange(10 ** 6)}" for _ in range(n)]
    item = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu".split()
    spaced = [w for k in range(0, 12, 3) for w in [*item[k:k + 3], *filler(1000)]] + item[12:]
    docs = spark.createDataFrame([(1, " ".join(spaced)), (2, " ".join([*filler(500), *item, *filler(500)]))],
                                 "doc_id long, text string")
    long = [(9, " ".join(f"other{i}" for i in range(5000)))]
    for more in ([], long):
        bench = spark.createDataFrame([(1, " ".join(item)), *more], "item_id long, text string")
        assert [(r["doc_id"], r["item_id"]) for r in decontaminate.leaks(docs, bench).collect()] == [(2, 1)]
        assert [r["doc_id"] for r in decontaminate.clean(docs, bench).collect()] == [1]


@pytest.fixture(scope="module")
def rated(spark):
    return queries.QUERIES["op10_attention_quality"](spark, "/root/testdata/sf0.01").collect()


def test_quality_on_held_out(spark, rated):
    labels = {r["doc_id"]: r["quality"] for r in table(spark, "/root/testdata/sf0.01", "labels").collect()}
    assert len(rated) == 1000 and all(0 <= r["score"] <= 1 for r in rated)
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) for r in rated)
    own = [r for r in rated if r["held_out"] and r["doc_id"] in labels]
    right = sum(r["predicted"] == labels[r["doc_id"]] for r in own)
    assert len(own) > 50 and right / len(own) >= 0.95


def test_quality_gradients():
    """The analytic step lowers the loss, and attention sums to one in each bag."""
    rnd = np.random.default_rng(1)
    bags = [rnd.normal(0, 1, (k, quality.FEATURES)) for k in rnd.integers(1, 5, 60)]
    labels = np.array([float(b[:, 0].max() > 0.8) for b in bags])
    model = quality.fit(bags, labels)
    p, attention = model.score(bags)
    assert all(abs(a.sum() - 1) < 1e-9 for a in attention)
    assert ((p > 0.5) == (labels == 1)).mean() > 0.9


def test_quality_odd_rows(spark, odd, none):
    labels = spark.createDataFrame([(3, 1), (3, 0), (5, 1), (None, 1), (7, None), (8, 9)], "doc_id long, quality int")
    model = quality.train(odd, labels, F.lit(True))
    assert quality.score(odd, model).count() == len(odd_rows())
    assert quality.keep(odd, model, 0.0).columns == odd.columns and quality.score(none, model).count() == 0
    blank = quality.train(odd, labels.where("false"), F.lit(True))
    assert {round(r["score"], 6) for r in quality.score(odd, blank).collect()} == {0.5}


def test_quality_learns_from_all_passages(spark):
    """A labelled document of any length enters the fit whole."""
    text = " ".join(f"w{i}" for i in range(70 * quality.PASSAGE))
    docs = spark.createDataFrame([(1, text), (2, "short")], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 1), (2, 0)], "doc_id long, quality int")
    bags = {r["doc_id"]: np.frombuffer(r["features"]).reshape(-1, quality.FEATURES)
            for r in quality.sample(docs, labels, F.lit(True)).collect()}
    assert bags.keys() == {1, 2} and np.array_equal(bags[1], quality.passages(text)) and len(bags[2]) == 1


def test_pipeline(spark):
    """Each stage against a plain restatement over its own input."""
    docs, seen = table(spark, FOLDER, "documents"), {}
    for name, stage in corpus_pipeline.STAGES:
        seen[name] = docs.collect()
        docs = stage(spark, docs, FOLDER)
        if name != "packing":
            assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    seen["end"] = docs.collect()
    raw, good, apart, clean, safe, pieces = seen.values()
    rated = {r["doc_id"]: r["predicted"] for r in queries.QUERIES["op10_attention_quality"](spark, FOLDER).collect()}
    assert {r["doc_id"] for r in good} == {i for i, keep in rated.items() if keep}
    good.sort(key=lambda r: r["doc_id"])
    root, _ = plain_groups([r["text"] for r in good])
    assert {r["doc_id"] for r in apart} == {good[i]["doc_id"] for i in set(root)}
    items = [" ".join(decontaminate.words_of(r["text"])) for r in table(spark, FOLDER, "benchmark").collect()]
    held = {r["doc_id"] for r in apart if any(
        f" {i} " in f" {' '.join(decontaminate.words_of(r['text']))} " for i in items)}
    assert {r["doc_id"] for r in clean} == {r["doc_id"] for r in apart} - held
    assert {r["doc_id"]: r["text"] for r in safe} == {
        r["doc_id"]: secret_scan.redacted(r["text"], "[secret]") for r in clean}
    assert all(r["n_chars"] == len(r["text"]) for r in safe if "[secret]" in r["text"])
    assert {r["doc_id"] for r in pieces} == {r["doc_id"] for r in safe}
    by_doc = Counter()
    for r in pieces:
        by_doc[r["doc_id"], r["doc_tokens"]] += r["length"]
    assert all(n == total for (_, total), n in by_doc.items())
    assert len(raw) == 200 and spark.createDataFrame([], SCHEMA).count() == 0


def test_pipeline_stages_on_odd_rows(spark, odd, none):
    for df in (odd, none):
        for _, stage in corpus_pipeline.STAGES:
            stage(spark, df, FOLDER).count()
