"""Positive-unlabelled learning: risk and slopes by hand, features by scanning, held-out documents."""

import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from diffgauge.llm import toxicity
from diffgauge.llm.common import remainder

RUDE = ["blorgish", "snarfen", "wuggle", "krantz"]


def test_risk_by_hand():
    z_p, z_u, prior = np.array([0.3, -1.2]), np.array([0.1, 2.0, -0.7]), 0.25
    cost = lambda z: float(np.log(1 + np.exp(-z)))
    missed, clean = toxicity.risks(z_p, z_u, prior)
    assert missed == pytest.approx(prior * (cost(0.3) + cost(-1.2)) / 2)
    assert clean == pytest.approx((cost(-0.1) + cost(-2.0) + cost(0.7)) / 3 - prior * (cost(-0.3) + cost(1.2)) / 2)


@pytest.mark.parametrize("prior", [0.1, 0.9])       # the second term is positive, negative
def test_slopes_are_gradients(prior):
    rnd = np.random.default_rng(1)
    z_p, z_u = rnd.normal(2, 1, 5), rnd.normal(0, 1, 7)
    negative = toxicity.risks(z_p, z_u, prior)[1] < 0
    assert negative == (prior == 0.9)

    def value(p, u):
        missed, clean = toxicity.risks(p, u, prior)
        return -clean if negative else missed + clean
    for own, slope, at in ((z_p, toxicity.slopes(z_p, z_u, prior)[0], 0), (z_u, toxicity.slopes(z_p, z_u, prior)[1], 1)):
        for i in range(len(own)):
            up, down = ([z_p.copy(), z_u.copy()] for _ in range(2))
            up[at][i] += 1e-5
            down[at][i] -= 1e-5
            assert slope[i] == pytest.approx((value(*up) - value(*down)) / 2e-5, abs=1e-8)


def plain_runs(text):
    data = b" " + text.encode().translate(toxicity.LOWER) + b" " * 8
    return {int.from_bytes(data[i:i + n], "little") for n in toxicity.SIZES for i in range(len(data) - n)
            if 32 not in data[i + 1:i + n]}


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(st.sampled_from("abcDE é.\n"), max_size=60), min_size=1, max_size=4), st.sampled_from([9, 1 << 20]))
def test_features_equal_a_scan(texts, block):
    before, toxicity.BLOCK_BYTES = toxicity.BLOCK_BYTES, block
    try:
        each = [set(toxicity.runs_of([t]).tolist()) for t in texts]
        assert each == [plain_runs(t) for t in texts]
        some = sorted(set().union(*each))[::2]
        found = toxicity.Vocabulary(np.array(some, np.uint64)).found(texts)
        assert sorted(zip(*map(list, found))) == sorted((i, some.index(r)) for i, own in enumerate(each) for r in own if r in some)
    finally:
        toxicity.BLOCK_BYTES = before


@pytest.fixture(scope="module")
def written(spark):
    """800 invented texts, one in six rude; only a part of the rude ones is confirmed, nothing else is labelled."""
    rnd = random.Random(5)
    rows, labels = [], []
    for i in range(800):
        words = ["".join(rnd.choice("aeioulmnrst") for _ in range(rnd.randint(2, 8))) for _ in range(rnd.randint(5, 400))]
        rude = i % 6 == 0
        for _ in range(3 if rude else 0):
            words.insert(rnd.randrange(len(words)), rnd.choice(RUDE).title())
        rows.append((i, " ".join(words), rude))
        if rude and rnd.random() < 0.7:
            labels.append((i, 1))
    return (spark.createDataFrame(rows, "doc_id long, text string, rude boolean").repartition(4),
            spark.createDataFrame(labels, "doc_id long, toxic int"))


def test_learns_from_positives_and_unlabelled_text(written):
    docs, labels = written
    model = toxicity.train(docs, labels, remainder(F.col("doc_id"), 4) != 2)
    rows = toxicity.score(docs, model).join(docs, "doc_id").where(remainder(F.col("doc_id"), 4) == 2).collect()
    assert np.mean([r["score"] >= toxicity.TOXIC for r in rows if r["rude"]]) >= 0.95
    assert np.mean([r["score"] >= toxicity.TOXIC for r in rows if not r["rude"]]) <= 0.02
    # a plain loop gives the same scores
    where = {int(r): i for i, r in enumerate(model.vocabulary.runs)}
    for r in rows[:40]:
        z = model.bias + sum(model.weights[where[x]] for x in plain_runs(r["text"]) if x in where)
        assert r["score"] == pytest.approx(1 / (1 + np.exp(-z)), abs=1e-9)


def test_same_rows_same_model(written):
    docs, labels = written
    learn = remainder(F.col("doc_id"), 4) != 2
    a, b = toxicity.train(docs, labels, learn), toxicity.train(docs.repartition(7, "text"), labels.repartition(3), learn)
    assert np.array_equal(a.vocabulary.runs, b.vocabulary.runs) and np.allclose(a.weights, b.weights) and a.bias == b.bias


def test_odd_rows(spark, written, odd, none):
    docs, labels = written
    model = toxicity.train(docs, labels, F.lit(True))
    rows = toxicity.score(odd, model).collect()
    assert len(rows) == odd.count() and all(0 <= r["score"] <= 1 for r in rows)
    assert sum(r["doc_id"] is None for r in rows) == 2
    assert toxicity.score(none, model).collect() == []
    no_labels = labels.where("toxic = 2")
    for few in (toxicity.train(odd, no_labels, F.lit(True)), toxicity.train(none, labels, F.lit(True)),
                toxicity.train(none, no_labels, F.lit(True))):
        assert toxicity.score(odd, few).where("score >= 0.3 and n_marks > 0").count() == 0
    marked = spark.createDataFrame([(3, 1), (3, 0), (3, 1), (None, 1), (4, None), (99999, 1)], "doc_id long, toxic int")
    assert toxicity.score(odd, toxicity.train(odd, marked, F.lit(True))).count() == odd.count()
