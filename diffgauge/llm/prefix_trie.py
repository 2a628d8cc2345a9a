"""Conversation prefix trie by van Emde Boas recursion.

A conversation is a path of turns from a common root; paths that begin alike share nodes. The trie of height
H is cut at depth H/2: the first halves of all paths, equal ones merged, are the paths of one upper trie, the
rests are the paths of lower tries, each rooted at the prefix that was cut off and found by that prefix's
name. Upper and lower tries have the same height, so one table holds them all and the next cut treats them
together: log2(H) passes until every trie is a single node. Copies merge at every cut, before anything is
expanded to nodes. Totals go the other way: at each height the totals of lower tries are grafted onto the
node they hang from and onto its ancestors within the upper trie, which lie at hand as that trie's path.

A name is the digest of the parent's name and the turn, so a prefix has the same name in every task and no
join hands names out. Texts are never shuffled, only turn digests with their lengths. Turns are put in order
by a range sort, so a conversation of any length spreads over tasks. A path longer than ``SLAB`` turns is cut
into slabs beforehand; slabs are named from the root on and grafted from the deepest up, so that no row holds
more than ``SLAB`` turns.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from diffgauge.llm.common import partition_id, store
from diffgauge.operators.joins import hot_keys, salted_lookup

GROUP = 100             # conversations that share the beginnings of the first of them
HEADS = 6               # a beginning has 0 to HEADS - 1 turns
SLAB = 256              # turns of a path in one row; a power of two
ROOT = bytes(16)        # name of the empty prefix
CHUNK = 4096            # member ids in one row on their way to a node's digest

RESULT = ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")


def digest(*columns: Column) -> Column:
    """16 bytes of SHA-256 over texts, each led by its length."""
    parts = [x for c in columns for x in (F.length(c).cast("string"), F.lit(":"), c)]
    return F.substring(F.unhex(F.sha2(F.concat(*parts).cast("binary"), 256)), 1, 16)


def _partitions(df: DataFrame) -> int:
    return max(1, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))


# ---------------------------------------------------------------- turns in order

def ordered(turns: DataFrame) -> DataFrame:
    """``conv_id, pos, turn_name, chars``: the turns of each conversation, numbered from 0 in order.

    A range sort on all order keys, and at last on the place in the input, splits even a conversation of
    equal rows. Each part numbers its rows; a conversation that runs over several parts adds what the parts
    before hold of it: one count per conversation and part.
    """
    rows = turns.where(F.col("conv_id").isNotNull()).select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"),
        F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"),
        F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    rows = store(rows.select("conv_id", "turn", digest(F.col("role"), F.col("text")).alias("turn_name"),
                             F.length("text").cast("long").alias("chars"), F.monotonically_increasing_id().alias("at")))
    order = [F.col("conv_id"), F.col("turn").asc_nulls_first(), F.col("turn_name"), F.col("at")]

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, conv, n = partition_id(), None, 0
        for batch in batches:
            place = []
            for c in batch.column("conv_id").to_pylist():
                conv, n = (c, 0) if c != conv else (conv, n + 1)
                place.append(n)
            yield pa.RecordBatch.from_arrays(
                [batch.column("conv_id"), pa.array(place, pa.int64()), batch.column("turn_name"), batch.column("chars"),
                 pa.array([part] * len(place), pa.int32())], ["conv_id", "place", "turn_name", "chars", "part"])

    placed = store(rows.repartitionByRange(_partitions(rows), *order).sortWithinPartitions(*order).mapInArrow(
        number, "conv_id long, place long, turn_name binary, chars long, part int"))
    counts = placed.groupBy("conv_id", "part").agg(F.count("*").alias("n"))
    earlier = Window.partitionBy("conv_id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    before = counts.select("conv_id", "part", F.sum("n").over(earlier).alias("before")).where("before is not null")
    return placed.join(before, ["conv_id", "part"], "left").select(
        "conv_id", (F.col("place") + F.coalesce("before", F.lit(0))).alias("pos"), "turn_name", "chars")


def head_length(conv_id: Column) -> Column:
    return (F.crc32(conv_id.cast("string").cast("binary")) % HEADS).cast("int")


def rebuilt(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """All conversations, and the turns of each after its beginning was taken from the first of its group.

    Returns ``conv_id, length`` (0 for a conversation without turns) and ``conv_id, pos, turn_name, chars``.
    """
    own = store(ordered(turns))
    heads = own.where(F.col("pos") < HEADS - 1).groupBy("conv_id").agg(
        F.array_sort(F.collect_list(F.struct("pos", "turn_name", "chars"))).alias("head"))
    convs = own.groupBy("conv_id").agg(F.count("*").alias("n")).select(
        "conv_id", "n", head_length(F.col("conv_id")).alias("h"), (F.col("conv_id") - F.col("conv_id") % GROUP).alias("base"))
    convs = convs.join(heads.withColumnRenamed("conv_id", "base"), "base", "left").select(
        "conv_id", "n", "h", F.when(F.col("head").isNull() | (F.col("h") == 0), F.expr("slice(head, 1, 0)")).otherwise(
            F.expr("slice(head, 1, h)")).alias("head"))
    convs = store(convs.withColumn("taken", F.greatest(F.size("head"), F.lit(0))).withColumn(
        "length", F.col("taken") + F.greatest(F.col("n") - F.col("h"), F.lit(0))))
    # only a conversation whose head is short of its h turns moves its own turns
    short = convs.where(F.col("taken") < F.col("h")).select("conv_id", (F.col("taken") - F.col("h")).alias("by"))
    tail = own.where(F.col("pos") >= head_length(F.col("conv_id"))).join(short, "conv_id", "left").select(
        "conv_id", (F.col("pos") + F.coalesce("by", F.lit(0))).alias("pos"), "turn_name", "chars")
    first = convs.where("taken > 0").select("conv_id", F.inline("head"))
    return convs.select("conv_id", "length"), tail.unionByName(first)


# ---------------------------------------------------------------- names

PATH = "array<struct<name: binary, chars: bigint>>"


def _named(rows: DataFrame) -> DataFrame:
    """``conv_id, slab, root, path`` from ``conv_id, slab, root, turns``: every prefix of the slab by its name."""
    kind = pa.list_(pa.struct([("name", pa.binary()), ("chars", pa.int64())]))

    def name(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            paths = []
            for parent, turns in zip(batch.column("root").to_pylist(), batch.column("turns").to_pylist()):
                path = []
                for turn in turns:
                    parent = hashlib.blake2b(parent + turn["turn_name"], digest_size=16).digest()
                    path.append({"name": parent, "chars": turn["chars"]})
                paths.append(path)
            yield pa.RecordBatch.from_arrays([batch.column("conv_id"), batch.column("slab"), batch.column("root"),
                                              pa.array(paths, kind)], ["conv_id", "slab", "root", "path"])

    return rows.select("conv_id", "slab", "root", "turns").mapInArrow(
        name, f"conv_id long, slab long, root binary, path {PATH}")


def paths(turns: DataFrame, slab: int) -> tuple[DataFrame, int]:
    """The named paths of all conversations, ``conv_id, slab, root, path``, and the number of slabs.

    Slabs are named one after another: a slab's root is the last name of the slab before.
    """
    rows = store(turns.withColumn("slab", F.expr(f"pos div {slab}")).groupBy("conv_id", "slab").agg(
        F.array_sort(F.collect_list(F.struct("pos", "turn_name", "chars"))).alias("turns")))
    deepest = rows.agg(F.max("slab")).first()[0]
    if deepest is None:
        return rows.select("conv_id", "slab", F.lit(ROOT).alias("root"), F.lit(None).cast(PATH).alias("path")), 0
    out = last = store(_named(rows.where("slab = 0").withColumn("root", F.lit(ROOT))))
    for k in range(1, deepest + 1):
        roots = last.select("conv_id", F.element_at("path", -1)["name"].alias("root"))
        last = store(_named(rows.where(F.col("slab") == k).join(roots, "conv_id")))
        out = out.unionByName(last)
    return out, deepest + 1


# ---------------------------------------------------------------- down: cut, up: graft

def merged(rows: DataFrame) -> DataFrame:
    """Equal paths of one trie become one, with the number and the smallest of their conversations."""
    return rows.groupBy("base", "root", "path").agg(F.sum("n").alias("n"), F.min("conv_id").alias("conv_id"))


def cut(rows: DataFrame, half: int) -> DataFrame:
    """Tries of height 2 * half into upper tries and lower ones of height half."""
    upper = merged(rows.withColumn("path", F.slice("path", 1, half)))
    lower = rows.where(F.size("path") > half).select(
        (F.col("base") + half).alias("base"), F.element_at("path", half)["name"].alias("root"),
        F.expr(f"slice(path, {half + 1}, {half})").alias("path"), "n", "conv_id")
    return upper.unionByName(lower)


def graft(nodes: DataFrame, tops: DataFrame, cut_paths: DataFrame) -> DataFrame:
    """Adds the totals of lower tries to the node they hang from and to its ancestors in the upper trie.

    ``tops``: the topmost nodes of the lower tries. ``cut_paths``: ``names`` of the paths from an upper trie's
    top to a node where it was cut.
    """
    below = tops.groupBy("parent").agg(F.sum("leaves").alias("l"), F.sum("saved").alias("s"))
    onto = cut_paths.withColumn("parent", F.element_at("names", -1)).join(below, "parent").select(
        F.explode("names").alias("name"), "l", "s").groupBy("name").agg(F.sum("l").alias("l"), F.sum("s").alias("s"))
    return store(nodes.join(onto, "name", "left").select(
        *(c for c in nodes.columns if c not in ("leaves", "saved")),
        (F.col("leaves") + F.coalesce("l", F.lit(0))).alias("leaves"),
        (F.col("saved") + F.coalesce("s", F.lit(0))).alias("saved")))


def _names(rows: DataFrame) -> DataFrame:
    return rows.select(F.col("path")["name"].alias("names"))


def nodes_of(named: DataFrame, slabs: int, slab: int) -> DataFrame:
    """All nodes but the root: ``name, parent, depth, n_convs, conv_id, n_children, leaves, saved``."""
    height = 1
    longest = named.agg(F.max(F.size("path"))).first()[0] or 1
    while height < longest:
        height *= 2
    rows = store(merged(named.select((F.col("slab") * slab).alias("base"), "root", "path", F.lit(1).cast("long").alias("n"),
                                     "conv_id")))
    whole, levels, size = rows, {}, height
    while size > 1:
        rows = levels[size] = store(cut(rows, size // 2))
        size //= 2
    nodes = rows.select(F.col("path")[0]["name"].alias("name"), F.col("root").alias("parent"),
                        (F.col("base") + 1).alias("depth"), F.col("n").alias("n_convs"), "conv_id",
                        ((F.col("n") - 1) * F.col("path")[0]["chars"]).alias("saved"))
    children = nodes.groupBy(F.col("parent").alias("name")).agg(F.count("*").alias("n_children"))
    nodes = store(nodes.join(children, "name", "left").select(
        "name", "parent", "depth", "n_convs", "conv_id", F.coalesce("n_children", F.lit(0)).alias("n_children"),
        F.when(F.col("n_children").isNull(), 1).otherwise(0).cast("long").alias("leaves"), "saved"))
    while size < height:        # size: height of the tries that are complete
        within = (F.col("depth") - 1) % slab
        tops = nodes.where(within % (2 * size) == size)
        full = levels[2 * size].where((F.col("base") % slab % (2 * size) == 0) & (F.size("path") == size))
        nodes = graft(nodes, tops, _names(full))
        size *= 2
    for k in range(slabs - 1, 0, -1):
        full = whole.where((F.col("base") == (k - 1) * slab) & (F.size("path") == slab))
        nodes = graft(nodes, nodes.where(F.col("depth") == k * slab + 1), _names(full))
    return nodes


# ---------------------------------------------------------------- conversations that end at a node

def end_digests(ends: DataFrame) -> DataFrame:
    """``name, ends_sha256``: SHA-256 of the ascending ids that end at each node, joined by commas.

    Ids come range-sorted by (node, id) and are joined to texts of ``CHUNK`` ids where they lie; a node's
    texts, in order, then run through one digest. Neither an id list nor a joined text is ever held whole.
    """
    order = ["name", "conv_id"]

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, seq, name, ids, out = partition_id(), 0, None, [], []

        def flush() -> None:
            nonlocal seq, ids
            if ids:
                out.append((name, part, seq, ",".join(map(str, ids))))
                seq, ids = seq + 1, []

        def rows() -> pa.RecordBatch:
            done = list(zip(*out)) or [()] * 4
            out.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(
                done, (pa.binary(), pa.int32(), pa.int64(), pa.string()))], ["name", "part", "seq", "ids"])

        for batch in batches:
            for node, conv in zip(batch.column("name").to_pylist(), batch.column("conv_id").to_pylist()):
                if node != name or len(ids) >= CHUNK:
                    flush()
                    name = node
                ids.append(conv)
            yield rows()
        flush()
        yield rows()

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, state = None, None
        for batch in batches:
            done = []
            for node, text in zip(batch.column("name").to_pylist(), batch.column("ids").to_pylist()):
                if node != name:
                    if state is not None:
                        done.append((name, state.hexdigest()))
                    name, state = node, hashlib.sha256(text.encode())
                else:
                    state.update(b"," + text.encode())
            columns = list(zip(*done)) or [()] * 2
            yield pa.RecordBatch.from_arrays([pa.array(columns[0], pa.binary()), pa.array(columns[1], pa.string())],
                                             ["name", "ends_sha256"])
        if state is not None:
            yield pa.RecordBatch.from_arrays([pa.array([name], pa.binary()), pa.array([state.hexdigest()])],
                                             ["name", "ends_sha256"])

    n = _partitions(ends)
    pieces = ends.repartitionByRange(n, *order).sortWithinPartitions(*order).mapInArrow(
        join, "name binary, part int, seq long, ids string")
    return pieces.repartition(n, "name").sortWithinPartitions("name", "part", "seq").mapInArrow(
        finish, "name binary, ends_sha256 string")


# ---------------------------------------------------------------- the trie

def trie(turns: DataFrame, slab: int = SLAB) -> DataFrame:
    """One row per node of the trie of the rebuilt conversations, with the columns of ``RESULT``.

    Rows with a null ``conv_id`` belong to no conversation and are left out. A null role or text is empty.
    Turns with the same ``turn`` of one conversation (null first) are ordered by a digest of role and text, so
    the result does not depend on the layout; equal rows are turns of their own. A rebuilt conversation
    without turns is a member of the root only. The root's ``parent_conv_id`` is null. An empty table gives no
    rows. Other columns are not read.
    """
    convs, turns = rebuilt(turns)
    named, slabs = paths(turns, slab)
    nodes = nodes_of(named, slabs, slab)
    empty = F.lit(hashlib.sha256(b"").hexdigest())
    ends = named.join(convs, "conv_id").where(F.col("slab") * slab + F.size("path") == F.col("length")).select(
        F.element_at("path", -1)["name"].alias("name"), "conv_id")
    ends = store(ends.unionByName(convs.where("length = 0").select(F.lit(ROOT).alias("name"), "conv_id")))
    tops = nodes.where("depth = 1").agg(F.count("*").alias("n_children"), F.sum("leaves").alias("l"), F.sum("saved").alias("s"))
    root = convs.agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs")).where("n_convs > 0").join(
        F.broadcast(tops)).select(
        F.lit(ROOT).alias("name"), F.lit(None).cast("binary").alias("parent"), F.lit(0).cast("long").alias("depth"),
        "n_convs", "conv_id", "n_children", F.coalesce("l", F.lit(1)).alias("leaves"), F.coalesce("s", F.lit(0)).alias("saved"))
    every = store(nodes.unionByName(root))
    # a node may be the parent of a large share of all nodes
    parents = every.select(F.col("name").alias("parent"), F.col("conv_id").alias("parent_conv_id"))
    linked = salted_lookup(every, parents, ["parent"], "left", hot_keys(every.where("parent is not null"), ["parent"]))
    return linked.join(end_digests(ends), "name", "left").select(
        "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", F.col("leaves").alias("n_leaves"),
        F.col("saved").alias("saved_tokens"), F.coalesce("ends_sha256", empty).alias("ends_sha256"))
