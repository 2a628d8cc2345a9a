"""Bit-sliced importance weights against counting feature by feature."""

import hashlib
import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from diffgauge.llm import importance

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def features(text):
    words = WORD.findall((text or "").translate({c: c + 32 for c in range(65, 91)}))
    runs = [" ".join(words[i:i + n]) for n in (1, 2, 3) for i in range(len(words) - n + 1)]
    return Counter(zlib.crc32(r.encode()) % 10000 for r in runs), len(words)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(st.sampled_from("abZ09 .\n-éß日"), max_size=120), min_size=1, max_size=6),
       st.sampled_from([3, 20, 1 << 21]))
def test_counts(texts, block):
    before, importance.BLOCK_BYTES = importance.BLOCK_BYTES, block
    try:
        got = importance.count_texts(texts)
    finally:
        importance.BLOCK_BYTES = before
    for i, t in enumerate(texts):
        counts, n = features(t)
        assert got.words[i] == n
        assert {b: int(got.counts[i, b]) for b in np.flatnonzero(got.counts[i])} == dict(counts)


def test_long_words_are_hashed_whole():
    texts = ["y" * n + " " + "é" * n for n in (47, 48, 49, 50, 97, 5000)]
    got = importance.count_texts(texts)
    for i, t in enumerate(texts):
        assert {b: int(got.counts[i, b]) for b in np.flatnonzero(got.counts[i])} == dict(features(t)[0])


@settings(max_examples=40, deadline=None)
@given(st.lists(st.lists(st.tuples(st.integers(0, 9999), st.integers(0, 70000)), max_size=30), min_size=1, max_size=4),
       st.lists(st.tuples(st.integers(0, 9999), st.integers(-20000, 20000)), max_size=60))
def test_planes_give_the_inner_product(documents, gains):
    counts = np.zeros((len(documents), importance.BUCKETS), np.int64)
    for i, own in enumerate(documents):
        for b, n in own:
            counts[i, b] = n
    gain = np.zeros(importance.BUCKETS, np.int64)
    for b, g in gains:
        gain[b] = g
    planes = importance.planes_of(counts)
    own = [planes[:int(m).bit_length(), i] for i, m in enumerate(counts.max(1))]
    assert importance.Gains(gain).weights(own).tolist() == (counts @ gain).tolist()


def brute(docs, target):
    own = [features(t) for _, t in docs]
    s, t = Counter(), Counter()
    for c, _ in own:
        s.update(c)
    for text in target:
        t.update(features(text)[0])
    S, T = sum(s.values()), sum(t.values())
    gain = {b: math.floor(1000 * math.log((t[b] + 1) * (S + 10000) / ((s[b] + 1) * (T + 10000)))) for b in s}
    rows = []
    for (i, _), (c, n) in zip(docs, own):
        h = int(hashlib.sha256(f"42:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        weight = sum(gain[b] * k for b, k in c.items())
        rows.append((i, n, sum(c.values()), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 2 ** 32)))))
    able = sorted((r for r in rows if r[1] >= 20), key=lambda r: (-r[4], r[0] is None, r[0] or 0))
    return sorted(rows, key=repr), [r[0] for r in able[:5 * len(able) // 100]]


@pytest.mark.parametrize("copies", [1, 40])
def test_resample_on_odd_rows(spark, odd, copies):
    target = spark.createDataFrame([("the of naïve don't",), (None,), ("WORD word a1b2 " * 30,)], "text string")
    docs = odd
    for _ in range(copies // 40 * 5):       # 32 copies of every row
        docs = docs.union(docs)
    got = importance.resample(docs, target).collect()
    rows, drawn = brute([(r["doc_id"], r["text"]) for r in docs.collect()], [r["text"] for r in target.collect()])
    assert sorted(((r["doc_id"], r["n_words"], r["n_features"], r["weight"], r["score"]) for r in got), key=repr) == rows
    ranked = sorted((r for r in got if r["rank"] is not None), key=lambda r: r["rank"])
    assert [r["rank"] for r in ranked] == list(range(1, len(drawn) + 1))
    assert [r["doc_id"] for r in ranked] == drawn


def test_empty_tables(spark, odd, none):
    assert importance.resample(none, odd).collect() == []
    rows = importance.resample(odd, none).collect()
    assert len(rows) == odd.count() and all(r["weight"] == 0 for r in rows if not r["n_features"])
