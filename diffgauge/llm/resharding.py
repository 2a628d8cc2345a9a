"""Resharding by minimum-cost flow: given old shards and new capacities, move as few bytes as possible.

Old shards hold blocks of rows; a block is a size class, a folder of files. In the flow network the old
shards' bytes are the supply and the new shards' capacities the demand; a byte that stays in its shard costs
nothing, a byte that moves costs one (or what the caller's cost function says). The solved transfers are laid
over the rows of each old shard as ranges of a running byte total, with the part that stays first. Rows run
from large to small, so sizes come out nearly equal and a cut touches one block: blocks above it stay where
they lie, blocks below it move, and only the block under the cut is split.
"""

from __future__ import annotations

import bisect
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from diffgauge.llm.common import partition_id, store
from diffgauge.session import scratch_dir

Cost = Callable[[int, int], int]


def transfers(supply: list[int], capacity: list[int], cost: Cost = lambda i, j: int(i != j)) -> dict[tuple[int, int], int]:
    """Bytes from each old to each new shard, at the least total cost.

    Successive shortest paths: while bytes are left, send as much as fits along the cheapest path in the
    residual network from an old shard with bytes to a new shard with room. Each step empties a shard, fills
    one or frees an arc, so the work follows the number of shards, not of bytes.
    """
    if sum(capacity) < sum(supply):
        raise ValueError("the new shards cannot hold the old ones")
    n, m = len(supply), len(capacity)
    price = np.array([[cost(i, j) for j in range(m)] for i in range(n)], float).reshape(n, m)
    flow = np.zeros((n, m), object)
    left, room = np.array(supply, object), np.array(capacity, object)
    while any(left):
        old = np.where(left > 0, 0.0, np.inf)
        new, from_old, from_new = np.full(m, np.inf), np.full(m, -1), np.full(n, -1)
        while True:     # relax all arcs until nothing gets cheaper
            reach = old[:, None] + price
            best = reach.argmin(0)
            better = reach[best, np.arange(m)] < new - 1e-9
            new[better], from_old[better] = reach[best, np.arange(m)][better], best[better]
            back = np.where(flow > 0, new[None, :] - price, np.inf)
            best = back.argmin(1)
            better = back[np.arange(n), best] < old - 1e-9
            if not better.any():
                break
            old[better], from_new[better] = back[np.arange(n), best][better], best[better]
        j = int(np.where(room > 0, new, np.inf).argmin())
        path, amount, end = [], room[j], j
        while True:
            i = int(from_old[j])
            path.append((i, j, 1))
            j = int(from_new[i])
            if j < 0:
                break
            path.append((i, j, -1))
            amount = min(amount, flow[i, j])
        amount = min(amount, left[i])
        for a, b, sign in path:
            flow[a, b] += sign * amount
        left[i] -= amount
        room[end] -= amount
    return {(i, j): int(flow[i, j]) for i in range(n) for j in range(m) if flow[i, j]}


def even(total: int, shards: int) -> list[int]:
    """Capacities that differ by one byte at most."""
    return [total // shards + (j < total % shards) for j in range(shards)]


def size_of(text) -> Column:
    """UTF-8 bytes of the text (none for null) and 8 more."""
    return (F.coalesce(F.octet_length(text), F.lit(0)) + 8).cast("long")


def running(rows: DataFrame, group: str, order: list[str], value: Column) -> DataFrame:
    """``before``: the sum of ``value`` over the earlier rows of the group, by a range sort and part totals.

    The rows are range-partitioned by group and order, so a group of any size spreads over parts. A part adds
    up its rows in one stream; what lies before it comes from one total per (part, group). The ordered rows
    are stored, so both passes see the same parts.
    """
    def add_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, last, at = partition_id(), None, 0
        for batch in batches:
            keys, values = pd.Series(batch.column(group).to_numpy()), pd.Series(batch.column("value").to_numpy())
            within = values.groupby(keys, sort=False).cumsum() - values
            if len(keys):
                within += np.where(keys == last, at, 0)
                last, at = keys.iloc[-1], within.iloc[-1] + values.iloc[-1]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([part] * len(keys), pa.int32()),
                                              pa.array(within, pa.int64())], [*batch.schema.names, "part", "within"])

    ordered = rows.withColumn("value", value.cast("long")).repartitionByRange(group, *order).sortWithinPartitions(
        group, *order)
    kept = store(ordered.mapInArrow(add_up, f"{_ddl(ordered)}, part int, within long"))
    totals = kept.groupBy(group, "part").agg(F.sum("value").alias("total"))
    base = totals.select(group, "part", F.expr(
        f"coalesce(sum(total) over (partition by {group} order by part rows between unbounded preceding "
        "and 1 preceding), 0)").alias("base"))      # a row per part and group: no data rows
    return kept.join(base, [group, "part"]).withColumn("before", F.col("base") + F.col("within")).drop(
        "part", "within", "base")


def _ddl(df: DataFrame) -> str:
    return ", ".join(f"`{n}` {t}" for n, t in df.dtypes)


STORED = "doc_id long, text string, size long, text_hash long, copy long, shard int, block int"


def write_shards(rows: DataFrame, path: str) -> DataFrame:
    """Write rows by shard and block. The rebalance hint splits large blocks over several files."""
    rows.hint("rebalance", "shard", "block").write.partitionBy("shard", "block").option(
        "compression", "zstd").parquet(path)
    return rows.sparkSession.read.schema(STORED).parquet(path)


def lay_out(docs: DataFrame, shard: Column) -> DataFrame:
    """A sharded table: ``shard`` by the given expression, ``block`` the bit length of the row's size.

    ``copy`` is the row's place in the input, so rows equal in id and text can be told apart.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"),
                       shard.cast("int").alias("shard"), F.monotonically_increasing_id().alias("copy"))
    rows = rows.withColumn("size", size_of("text")).withColumn("text_hash", F.xxhash64("text")).withColumn(
        "block", F.length(F.bin("size")).cast("int"))
    return write_shards(rows, scratch_dir(docs.sparkSession))


def reshard(old: DataFrame, shards: int, cost: Cost = lambda i, j: int(i != j)) -> tuple[DataFrame, dict]:
    """Move a sharded table (``lay_out``) to ``shards`` shards of nearly equal bytes.

    Returns the new table, read from the untouched old blocks and the rewritten ones, and the solved
    transfers. Null texts have size 8. A cut can fall between any two rows, also between equal ones. An empty
    table stays empty. Only one number per old shard and one key per transfer reach the
    driver.
    """
    spark = old.sparkSession
    sizes = {r["shard"]: r["bytes"] for r in old.groupBy("shard").agg(F.sum("size").alias("bytes")).collect()}
    supply = [sizes.get(i, 0) for i in range(max(sizes, default=-1) + 1)]
    plan = transfers(supply, even(sum(supply), shards), cost)
    ranges = {}
    for i in sizes:
        targets = sorted((j for k, j in plan if k == i), key=lambda j: (j != i, j))     # what stays comes first
        ranges[i] = (np.cumsum([plan[i, j] for j in targets]).tolist(), targets)

    order = F.struct((-F.col("size")).alias("size"), F.coalesce("doc_id", F.lit(-1 << 63)).alias("doc_id"), "text_hash", "copy")
    slim = old.select("shard", order.alias("key"), "size")
    placed = running(slim.select("shard", "key.*", F.col("size").alias("bytes")), "shard",
                     ["size", "doc_id", "text_hash", "copy"], F.col("bytes"))

    def targets_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            middle = batch.column("before").to_numpy() + batch.column("bytes").to_numpy() // 2
            found = [ranges[i][1][min(bisect.bisect_right(ranges[i][0], at), len(ranges[i][0]) - 1)]
                     for i, at in zip(batch.column("shard").to_pylist(), middle.tolist())]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, pa.int32())],
                                             [*batch.schema.names, "target"])

    last = placed.mapInArrow(targets_of, f"{_ddl(placed)}, target int").groupBy("shard", "target").agg(
        F.max(F.struct("size", "doc_id", "text_hash", "copy")).alias("key"))
    cuts: dict[int, list[tuple]] = {}
    for r in last.collect():                # a key per transfer
        cuts.setdefault(r["shard"], []).append((tuple(r["key"]), r["target"]))
    cuts = {i: sorted(c) for i, c in cuts.items()}

    moved = old.withColumn("target", _target(cuts, order)).withColumnRenamed("shard", "old_shard")
    # a row per old shard and size class (at most 40): bounded, whatever the table's size
    affected = F.broadcast(store(moved.groupBy("old_shard", "block").agg(
        F.max(F.col("target") != F.col("old_shard")).alias("hit")).where("hit").select("old_shard", "block")))
    again = moved.join(affected, ["old_shard", "block"]).select(
        "doc_id", "text", "size", "text_hash", "copy", F.col("target").alias("shard"), "block")
    rewritten = write_shards(again, scratch_dir(spark))
    untouched = old.join(affected.withColumnRenamed("old_shard", "shard"), ["shard", "block"], "left_anti")
    names = [f.split()[0] for f in STORED.split(", ")]
    return untouched.select(names).unionByName(rewritten.select(names)), plan


def _target(cuts: dict[int, list[tuple]], key: Column) -> Column:
    """The new shard of a row: the first cut of its old shard that its key does not pass."""
    out = F.col("shard")
    for i, own in cuts.items():
        inner = F.lit(own[-1][1])
        for values, target in reversed(own[:-1]):
            cut = F.struct(*[F.lit(v).cast("long").alias(n) for n, v in zip(("size", "doc_id", "text_hash", "copy"), values)])
            inner = F.when(key <= cut, F.lit(target)).otherwise(inner)
        out = F.when(F.col("shard") == i, inner).otherwise(out)
    return out.cast("int")


def slots(table: DataFrame) -> DataFrame:
    """The rows without their texts, numbered from 0 in each shard by id and text."""
    slim = table.select("doc_id", "size", F.crc32(F.coalesce("text", F.lit("")).cast("binary")).alias("text_crc32"),
                        "text_hash", "copy", "shard")
    return running(slim, "shard", ["doc_id", "text_hash", "copy"], F.lit(1)).withColumnRenamed("before", "slot").drop(
        "value", "text_hash", "copy")
