"""Flows against exhaustive search, and whole tables through the resharding."""

import itertools
import zlib
from collections import Counter

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from diffgauge.llm import resharding

from llm_rows import odd_rows


def cheapest(supply, capacity, cost):
    """Least cost by trying every way to send single bytes (tiny cases)."""
    slots = [j for j, c in enumerate(capacity) for _ in range(c)]
    bytes_ = [i for i, s in enumerate(supply) for _ in range(s)]
    return min(sum(cost(i, j) for i, j in zip(bytes_, p)) for p in set(itertools.permutations(slots, len(bytes_))))


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 3), min_size=1, max_size=3), st.lists(st.integers(0, 3), min_size=1, max_size=3),
       st.lists(st.integers(0, 4), min_size=9, max_size=9))
def test_flow_is_cheapest(supply, capacity, prices):
    def cost(i, j):
        return prices[3 * i + j]
    while sum(supply) > 5:
        supply[supply.index(max(supply))] -= 1
    if sum(capacity) < sum(supply) or sum(capacity) > 7:
        return
    plan = resharding.transfers(supply, capacity, cost)
    assert [sum(v for (i, _), v in plan.items() if i == k) for k in range(len(supply))] == supply
    assert all(sum(v for (_, j), v in plan.items() if j == k) <= c for k, c in enumerate(capacity))
    assert sum(cost(i, j) * v for (i, j), v in plan.items()) == cheapest(supply, capacity, cost)


def test_default_cost_moves_only_surplus():
    supply = [100, 40, 70, 0]
    plan = resharding.transfers(supply, resharding.even(210, 6))
    assert sum(v for (i, j), v in plan.items() if i != j) == sum(max(0, s - 35) for s in supply)
    with pytest.raises(ValueError):
        resharding.transfers([2], [1])


def shards_of(df, n):
    new, plan = resharding.reshard(resharding.lay_out(df, F.pmod(F.xxhash64("doc_id"), F.lit(4))), n)
    return new, plan, resharding.slots(new).collect()


def test_whole_table(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    new, plan, rows = shards_of(docs, 6)
    want = sorted((r["doc_id"], len((r["text"] or "").encode()) + 8, zlib.crc32((r["text"] or "").encode()))
                  for r in docs.collect())
    assert sorted((r["doc_id"], r["size"], r["text_crc32"]) for r in rows) == want
    bytes_ = Counter()
    for r in rows:
        bytes_[r["shard"]] += r["size"]
    assert max(bytes_.values()) - min(bytes_.values()) < 4000 and len(bytes_) == 6
    for s in range(6):
        assert sorted(r["slot"] for r in rows if r["shard"] == s) == list(range(sum(r["shard"] == s for r in rows)))
    # what leaves its shard is what the flow says, up to a row at each cut
    old = {r["doc_id"]: r["o"] for r in docs.select("doc_id", F.pmod(F.xxhash64("doc_id"), F.lit(4)).alias("o")).collect()}
    moved = sum(r["size"] for r in rows if r["shard"] != old[r["doc_id"]])
    assert abs(moved - sum(v for (i, j), v in plan.items() if i != j)) < 8 * 2500


def test_odd_rows(odd, none):
    _, _, rows = shards_of(odd, 3)
    want = Counter((r[0], zlib.crc32((r[1] or "").encode())) for r in odd_rows())
    assert Counter((r["doc_id"], r["text_crc32"]) for r in rows) == want
    for s in {r["shard"] for r in rows}:
        assert sorted(r["slot"] for r in rows if r["shard"] == s) == list(range(sum(r["shard"] == s for r in rows)))
    sizes = Counter()
    for r in rows:
        sizes[r["shard"]] += r["size"]
    longest = max(r["size"] for r in rows)
    assert max(sizes.values()) <= sum(sizes.values()) / 3 + 2 * longest
    assert shards_of(none, 3)[2] == []


def test_equal_rows_are_dealt_over_shards(spark):
    """Half of all rows are equal in id and text; bytes stay near equal all the same."""
    rows = [(7, "the same text " * 40)] * 600 + [(i, f"{i} " * (i % 300)) for i in range(600)]
    _, _, got = shards_of(spark.createDataFrame(rows, "doc_id long, text string").repartition(6), 24)
    sizes = Counter()
    for r in got:
        sizes[r["shard"]] += r["size"]
    assert len(sizes) == 24 and sum(sizes.values()) == sum(len(t) + 8 for _, t in rows)
    assert max(sizes.values()) - min(sizes.values()) < 4 * max(r["size"] for r in got)
    for s in range(24):
        assert sorted(r["slot"] for r in got if r["shard"] == s) == list(range(sum(r["shard"] == s for r in got)))
