"""The halving trie against a trie built node by node."""

import hashlib
import random
import zlib

import pytest
from pyspark.sql import functions as F

from diffgauge.llm import prefix_trie

SCHEMA = "conv_id long, turn long, role string, text string"


def brute(rows):
    own = {}
    for c, turn, role, text in rows:
        if c is not None:
            own.setdefault(c, []).append(((turn is not None, turn or 0), (role or "", text or "")))
    own = {c: [t for _, t in sorted(ts, key=lambda x: (x[0], hashlib.sha256(
        "".join(f"{len(p)}:{p}" for p in x[1]).encode()).digest()[:16]))] for c, ts in own.items()}
    built = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 6
        built[c] = own.get(c - c % 100, [])[:h] + turns[h:]
    members = {}
    for c, turns in built.items():
        for d in range(len(turns) + 1):
            members.setdefault(tuple(turns[:d]), []).append(c)
    children = {}
    for p in members:
        if p:
            children.setdefault(p[:-1], []).append(p)

    out = []
    totals = {}
    for p in sorted(members, key=len, reverse=True):
        below = [totals[c] for c in children.get(p, [])]
        totals[p] = (sum(x for x, _ in below) if below else 1,
                     sum(x for _, x in below) + (len(p) and (len(members[p]) - 1) * len(p[-1][1])))
        ends = ",".join(str(c) for c in sorted(members[p]) if len(built[c]) == len(p))
        out.append((min(members[p]), len(p), min(members[p[:-1]]) if p else None, len(members[p]), len(children.get(p, [])),
                    *totals[p], hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=repr)


def got(df, **k):
    rows = prefix_trie.trie(df, **k)
    assert tuple(rows.columns) == prefix_trie.RESULT
    return sorted((tuple(r) for r in rows.collect()), key=repr)


def conversations(seed, ids, longest, texts):
    rnd = random.Random(seed)
    return [(c, t, rnd.choice(["user", "assistant"]), rnd.choice(texts)) for c in ids for t in range(rnd.randint(1, longest))]


@pytest.mark.parametrize("slab", [1, 2, 4, 256])
def test_equals_brute_force(spark, slab):
    rows = conversations(slab, [*range(0, 12), *range(100, 112), *range(205, 225)], 9, ["a", "bé", "", "日本 c"])
    df = spark.createDataFrame(rows, SCHEMA).repartition(5)
    assert got(df, slab=slab) == brute(rows)


def test_odd_rows(spark):
    rows = conversations(3, [0, 1, 2, 3], 4, ["x", "y"])
    rows += [(None, 0, "user", "nobody"), (5, None, None, None), (5, None, "user", ""), (5, 0, "user", None), (5, 0, "user", None),
             (7, 2, "a", "b"), (7, 1, "", "ab"), (307, 0, "user", "no base"), (9, 0, "user", "w " * 40000)]
    df = spark.createDataFrame(rows, SCHEMA).repartition(4)
    for name in ("pos", "name", "path", "n", "part", "chars", "slab", "root"):
        df = df.withColumn(name, F.lit("clash"))
    assert got(df) == brute(rows)


def test_hot_conversation_and_opener(spark):
    """One conversation holds a third of all rows, equal rows among them; one opener is shared by most others."""
    rows = [(400, t // 3, "user", "same") for t in range(300)]
    rows += [(c, t, "user", "hello" if t == 0 else f"{c % 7}") for c in range(500, 620) for t in range(5)]
    df = spark.createDataFrame(rows, SCHEMA).repartition(7)
    assert got(df, slab=32) == brute(rows)


def test_empty(spark):
    assert got(spark.createDataFrame([], SCHEMA)) == []
    assert got(spark.createDataFrame([(None, 1, "a", "b")], SCHEMA)) == []


def test_long_member_lists(spark, monkeypatch):
    monkeypatch.setattr(prefix_trie, "CHUNK", 3)
    rows = [(c, 0, "user", "hi") for c in range(1000, 1040)]
    assert got(spark.createDataFrame(rows, SCHEMA).repartition(3)) == brute(rows)
