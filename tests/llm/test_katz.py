"""Katz backoff against a plain restatement, on whole tables and odd rows."""

import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from diffgauge.llm import katz
from diffgauge.llm.common import remainder

from llm_rows import odd_rows

K = katz.DISCOUNTED


def tokens(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return re.findall("[^\x20\x09-\x0D]+", low) + ["</s>"]


class Plain:
    def __init__(self, texts):
        self.c, self.pairs = Counter(), Counter()
        for t in texts:
            ws = tokens(t)
            self.c.update(ws)
            self.pairs.update(zip(["<s>", *ws], ws))
        self.n, self.v = sum(self.c.values()), len(self.c)
        self.after = defaultdict(dict)
        for (h, w), n in self.pairs.items():
            self.after[h][w] = n
        self.d, self.d1 = (katz.discounts(np.bincount(np.minimum(list(x.values()) or [0], K + 2), minlength=K + 3))
                           for x in (self.pairs, self.c))

    def one(self, w):
        if w not in self.c:
            return 1 - sum(self.one(x) for x in self.c)
        return self.d1[min(self.c[w], K + 1) if self.c[w] <= K else 0] * self.c[w] / (self.n + 1)

    def prob(self, h, w):
        own = self.after.get(h)
        if not own:
            return self.one(w)
        total = sum(own.values())

        def star(x):
            return (self.d[own[x]] if own[x] <= K else 1.0) * own[x] / (total + 1)
        if w in own:
            return star(w)
        return (1 - sum(map(star, own))) / (1 - sum(map(self.one, own))) * self.one(w)


def check(spark, docs, rows):
    held = [zlib.crc32(("" if i is None else str(i)).encode()) % 5 == 1 for i, *_ in rows]
    plain = Plain([t for (_, t, *_), x in zip(rows, held) if not x])
    scored, model = katz.score(docs, remainder(F.col("doc_id"), 5) == 1)
    got = scored.collect()
    want = Counter()
    for (i, t, *_), x in zip(rows, held):
        ws = tokens(t)
        base = sum(math.log10((plain.c[w] + 0.5) / (plain.n + 0.5 * (plain.v + 1))) for w in ws)
        score = sum(math.log10(plain.prob(h, w)) for h, w in zip(["<s>", *ws], ws))
        want[i, x, len(ws), sum(plain.c[w] > 0 for w in ws), plain.n, round(base, 5), round(score, 5)] += 1
    assert Counter((r["doc_id"], r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"],
                    round(r["base_score"], 5), round(r["score"], 5)) for r in got) == want
    assert sorted(r["n"] for r in model.bigrams().collect()) == sorted(plain.pairs.values())
    return plain


def some(spark):
    df = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").limit(40)
    return df, [tuple(r) for r in df.collect()]


@pytest.mark.parametrize("bucket_tokens", [4_000_000, 700])
def test_scores(spark, monkeypatch, bucket_tokens):
    monkeypatch.setattr(katz, "BUCKET_TOKENS", bucket_tokens)
    rows = [tuple(r) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").where(
        "n_chars < 1500").collect()][:40]
    rows += [(1000 + i, t, None, None, None) for i, t in enumerate(["the the the", "the end", "", None, "THE\tof\x0bthe é É"])]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(6)
    plain = check(spark, docs, rows)
    words = [*plain.c, "never seen"]
    for h in ["<s>", "the", "never seen", words[3]]:
        assert math.isclose(sum(plain.prob(h, w) for w in words), 1, abs_tol=1e-9)


def test_hot_words(spark, monkeypatch):
    monkeypatch.setattr(katz, "BUCKET_TOKENS", 2000)
    rows = [(i, "is it is " * 20 + f"w{i % 7} x{i}", "", "", 0) for i in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(6)
    texts = docs.select("doc_id", "text", (remainder(F.col("doc_id"), 5) == 1).alias("held"))
    total, _, hot = katz.hot_words(texts)
    assert total == sum(len(tokens(r[1])) for r in rows) and len(hot) >= 2
    check(spark, docs, rows)


def test_odd_rows(spark, odd, none):
    rows = [r for r in odd_rows() if len(r[1] or "") < 2000]
    check(spark, odd.where("coalesce(length(text), 0) < 2000"), rows)
    assert katz.score(odd, remainder(F.col("doc_id"), 5) == 1)[0].count() == len(odd_rows())
    assert katz.score(none, remainder(F.col("doc_id"), 5) == 1)[0].count() == 0
