"""N-gram Jaccard join: MinHash bands find candidates, full n-gram sets decide.

Texts with equal n-gram sets form a class and enter the join once. Band and row counts follow from the
similarity and the wanted recall. A shuffle on band hashes brings candidates together, but no bucket emits
its pairs: a class goes to the home of its smallest bucket mate, a home is cut into blocks of bounded size,
and two blocks meet once if they share a bucket. A task compares two blocks in matrix form. A pair is a
candidate if it agrees in a band; its full sets are intersected, and the task returns link counts and the
parts that the links connect, not the links themselves.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from diffgauge.llm.common import slices, store, texts_of

N = 5
SIMILARITY = 0.8
RECALL = 0.9999
HASHES = 128            # most MinHash values a document gets
WORD = re.compile(r"\w+")
BLOCK_GRAMS, BLOCK_CLASSES = 1 << 17, 512       # about what a block holds
KNOWN_WORDS = 200_000   # hashes of words kept by a Python worker


def bands_and_rows(similarity: float, recall: float, most: int = HASHES) -> tuple[int, int]:
    """The fewest bands that reach the recall at the similarity, with as many rows as the hashes allow.

    A pair of similarity s meets in one of b bands of r rows with probability 1 - (1 - s^r)^b; more rows
    mean fewer false candidates.
    """
    fits = []
    for r in range(1, most + 1):
        hit = similarity ** r
        b = 1 if hit >= 1 else math.ceil(math.log(1 - recall) / math.log1p(-hit))
        if b * r <= most:
            fits.append((b, r))
    if not fits:
        raise ValueError(f"{most} hashes do not reach a recall of {recall} at {similarity}")
    return fits[-1]


_WORDS: dict[str, int] = {}


def _word_hash(word: str) -> int:
    h = _WORDS.get(word)
    if h is None:
        if len(_WORDS) >= KNOWN_WORDS:
            _WORDS.clear()
        h = _WORDS[word] = xxhash.xxh3_64_intdigest(word.encode("utf-8", "surrogatepass"))
    return h


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    return x ^ (x >> np.uint64(29))


def ngram_set(text: str, n: int = N) -> np.ndarray:
    """Sorted 64-bit hashes of the text's distinct n-grams; a text of fewer words has one, all its words."""
    words = WORD.findall(text.lower())
    if not words:
        return np.zeros(0, np.uint64)
    hashes = np.fromiter(map(_word_hash, words), np.uint64, len(words))
    grams = np.full(max(len(words) - n + 1, 1), min(n, len(words)), np.uint64)
    for j in range(min(n, len(words))):
        grams = _mixed(grams + hashes[j:j + len(grams)])
    return np.unique(grams)


def signatures(sets: list[np.ndarray], bands: int, rows: int) -> np.ndarray:
    """Band hashes (documents x bands) of non-empty sets."""
    rnd = np.random.default_rng(20)
    factors = rnd.integers(1, 1 << 63, bands * rows, np.uint64) * np.uint64(2) + np.uint64(1)
    first = np.cumsum([0] + [len(s) for s in sets])[:-1]
    every = np.concatenate(sets)
    out = np.empty((len(sets), bands), np.uint64)
    for b in range(bands):
        key = np.full(len(sets), b + 1, np.uint64)
        for f in factors[b * rows:(b + 1) * rows]:
            key = _mixed(key + np.minimum.reduceat(_mixed(every * f), first))
        out[:, b] = key
    return out.view(np.int64)


GRAMS_AT_ONCE = 1 << 18


def sketches(docs: DataFrame, n: int, bands: int, rows: int) -> DataFrame:
    """Per row: its id and text hash, the digest of its n-gram set, the set's size and the band hashes."""
    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            sets = [ngram_set(t, n) for t in texts_of(batch.column("text"))]
            keys: list[list[int]] = [[] for _ in sets]
            some: list[int] = []
            held = 0
            for i, s in enumerate([*sets, None]):
                if s is None or held > GRAMS_AT_ONCE:
                    for j, row in zip(some, signatures([sets[j] for j in some], bands, rows).tolist() if some else []):
                        keys[j] = row
                    some, held = [], 0
                if s is not None and len(s):
                    some.append(i)
                    held += len(s)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("text_hash"),
                 pa.array([hashlib.blake2b(s.tobytes(), digest_size=16).digest() for s in sets], pa.binary()),
                 pa.array([len(s) for s in sets], pa.int64()), pa.array(keys, pa.list_(pa.int64()))],
                ["doc_id", "text_hash", "cls", "n_grams", "bands"])

    return store(_texts(docs).mapInArrow(
        sketch, "doc_id long, text_hash long, cls binary, n_grams long, bands array<long>"))


def _texts(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"),
                       F.xxhash64(F.col("text").cast("string")).alias("text_hash"))


def full_sets(docs: DataFrame, classes: DataFrame, n: int) -> DataFrame:
    """The n-gram sets of the given classes (``cls, doc_id, text_hash`` of a member), from the whole texts."""
    def sets_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            yield pa.RecordBatch.from_arrays(
                [batch.column("cls"), pa.array([ngram_set(t, n).tobytes() for t in texts_of(batch.column("text"))],
                                               pa.binary())], ["cls", "grams"])

    members = classes.select("cls", F.col("doc_id").alias("m_id"), F.col("text_hash").alias("m_hash"))
    rows = _texts(docs).join(members, F.col("doc_id").eqNullSafe(F.col("m_id")) & (F.col("text_hash") == F.col("m_hash")))
    # a member row that repeats gives the same set again
    return store(rows.select("cls", "text").mapInArrow(sets_of, "cls binary, grams binary").dropDuplicates(["cls"]), codec="none")


def compared(blocks: DataFrame, pairs: DataFrame, similarity: float) -> DataFrame:
    """``cls, peer, more`` of each class with a link in a pair of blocks: the smallest class it is connected with
    there, and the rows it is linked to there. ``pairs`` holds each pair (a, b) of blocks with a <= b once."""
    def links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                sides = [batch.column(c)[row].as_py() for c in ("a_members", "b_members")]
                same = batch.column("same")[row].as_py()
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, t) for c, t in zip(_links(*sides, same, similarity),
                                                    (pa.binary(), pa.binary(), pa.int64()))], ["cls", "peer", "more"])

    rows = pairs.withColumn("same", F.col("a") == F.col("b"))
    for side in ("a", "b"):
        rows = rows.join(blocks.select(F.col("block").alias(side), F.col("members").alias(f"{side}_members")), side)
    return store(rows.select("a_members", "b_members", "same").mapInArrow(links, "cls binary, peer binary, more long"))


def _links(left: list[dict], right: list[dict], same: bool, similarity: float) -> tuple[list, list, list]:
    sizes = [np.array([len(m["grams"]) // 8 for m in side]) for side in (left, right)]
    # candidates agree in a band and have sizes that allow the similarity
    found = np.zeros((len(left), len(right)), bool)
    a, b = (np.array([m["bands"] for m in side], np.int64) for side in (left, right))
    for k in range(a.shape[1]):
        found |= a[:, k, None] == b[None, :, k]
    found &= np.minimum.outer(*sizes) >= np.maximum.outer(*sizes) * similarity - 1e-6
    if same:
        found &= np.tri(len(left), k=-1, dtype=bool).T
    i, j = np.flatnonzero(found.any(1)), np.flatnonzero(found.any(0))
    if not len(i):
        return [], [], []
    common = _common([left[x]["grams"] for x in i], [right[x]["grams"] for x in j])
    either = sizes[0][i][:, None] + sizes[1][j][None, :] - common
    linked = found[np.ix_(i, j)] & (common >= similarity * either - 1e-9)
    if not linked.any():
        return [], [], []
    names = [left[x]["cls"] for x in i] + [right[x]["cls"] for x in j]
    copies = [np.array([side[x]["copies"] for x in at]) for side, at in ((left, i), (right, j))]
    more = np.concatenate([linked @ copies[1], copies[0] @ linked])
    # smallest connected name: spread the least rank over the links until nothing changes
    rank = np.argsort(np.argsort(np.array(names, object), kind="stable"), kind="stable")
    least, none = rank.copy(), len(names)
    while True:
        old, new = least[:len(i)], least[len(i):]
        after = np.concatenate([np.minimum(old, np.where(linked, new[None, :], none).min(1)),
                                np.minimum(new, np.where(linked, old[:, None], none).min(0))])
        if (after == least).all():
            break
        least = after
    by_rank = dict(zip(rank.tolist(), names))
    own = [x for x in range(len(names)) if more[x]]
    return [names[x] for x in own], [by_rank[int(least[x])] for x in own], [int(more[x]) for x in own]


COLUMNS = 8192          # shared n-grams multiplied at once


def _common(left: list[bytes], right: list[bytes]) -> np.ndarray:
    """Sizes of the intersections of all sets of one side with all of the other."""
    sides = [[np.frombuffer(g, np.uint64) for g in side] for side in (left, right)]
    both = np.intersect1d(*(np.concatenate(side) for side in sides))
    places = []
    for side in sides:
        grams, row = np.concatenate(side), np.repeat(np.arange(len(side)), [len(g) for g in side])
        at = np.minimum(np.searchsorted(both, grams), max(len(both) - 1, 0))
        there = both[at] == grams if len(both) else np.zeros(len(grams), bool)
        order = np.argsort(at[there], kind="stable")
        places.append((at[there][order], row[there][order]))
    out = np.zeros((len(left), len(right)), np.float32)
    for start in range(0, len(both), COLUMNS):
        parts = []
        for (at, row), side in zip(places, sides):
            lo, hi = np.searchsorted(at, (start, start + COLUMNS))
            part = np.zeros((len(side), min(COLUMNS, len(both) - start)), np.float32)
            part[row[lo:hi], at[lo:hi] - start] = 1
            parts.append(part)
        out += parts[0] @ parts[1].T        # counts stay far below 2 ** 24, exact in single precision
    return out.astype(np.int64)


def components(edges: DataFrame) -> DataFrame:
    """``node, root``: the smallest node of each connected part, by neighbours' least labels and label jumps."""
    both = store(edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    labels = store(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.min("a")).alias("root")))
    while True:
        near = both.join(labels.select(F.col("node").alias("b"), "root"), "b").groupBy(F.col("a").alias("node")).agg(
            F.min("root").alias("least"))
        step = labels.join(near, "node").select("node", F.least("root", "least").alias("root"), F.col("root").alias("old"))
        jump = step.select(F.col("node").alias("root"), F.col("root").alias("next"))
        after = store(step.join(jump, "root", "left").select(
            "node", F.least("root", F.coalesce("next", "root")).alias("root"), "old"))
        labels = after.select("node", "root")
        if after.where(F.col("root") != F.col("old")).isEmpty():
            return labels


def join(docs: DataFrame, similarity: float = SIMILARITY, n: int = N, recall: float = RECALL) -> DataFrame:
    """One row per row of ``docs``, with its class, its group and its links.

    Result: ``doc_id, text_hash, cls`` (digest of the n-gram set), ``root`` (the group: smallest digest in it),
    ``n_grams, text_class`` (smallest id with the same set), ``class_id`` (smallest id of the connected
    group), ``n_links`` (other rows at the similarity or above, copies counted). Texts are lower-cased words; shorter texts than ``n`` words are
    one n-gram, texts without words (null too) equal each other. Null ids stay null and are never chosen as
    the smallest if there is another. Rows may repeat. Other columns are not read.
    """
    bands, rows = bands_and_rows(similarity, recall)
    rows_of = sketches(docs, n, bands, rows)
    by_class = store(rows_of.groupBy("cls").agg(
        F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "text_hash")).alias("m"), F.count("*").alias("copies"),
        F.first("n_grams").alias("n_grams"), F.first("bands").alias("bands")).select(
        "cls", "m.doc_id", "m.text_hash", "copies", "n_grams", "bands"))

    buckets = by_class.select("cls", F.explode("bands").alias("key"))
    shared = buckets.groupBy("key").agg(F.min("cls").alias("pivot"), F.max("cls").alias("last")).where(
        F.col("pivot") != F.col("last")).select("key", "pivot")
    met = store(buckets.join(shared, "key"))
    homes = store(met.groupBy("cls").agg(F.min("pivot").alias("home")).join(by_class, "cls"))
    parts = homes.groupBy("home").agg(F.ceil(F.greatest(
        F.sum("n_grams") / BLOCK_GRAMS, F.count("*") / BLOCK_CLASSES)).cast("int").alias("parts"))
    placed = store(homes.join(parts, "home").select(
        "cls", "copies", "bands", "doc_id", "text_hash",
        F.struct("home", F.pmod(F.xxhash64("cls"), F.col("parts")).cast("int").alias("part")).alias("block")))
    blocks = store(placed.join(full_sets(docs, homes, n), "cls").groupBy("block").agg(
        F.collect_list(F.struct("cls", "copies", "bands", "grams")).alias("members")), codec="none")
    in_bucket = met.join(placed.select("cls", "block"), "cls").select("key", "block").distinct()
    several = in_bucket.groupBy("key").agg(F.min("block").alias("m"), F.max("block").alias("n")).where("m <> n")
    in_bucket = store(in_bucket.join(several.select("key"), "key", "left_semi"))
    # rows are pairs of blocks that share a bucket: a block holds up to BLOCK_CLASSES classes
    pairs = in_bucket.withColumnRenamed("block", "a").join(in_bucket.withColumnRenamed("block", "b"), "key").where(
        F.col("a") < F.col("b")).select("a", "b").distinct()
    inside = blocks.where(F.size("members") > 1).select(F.col("block").alias("a"), F.col("block").alias("b"))
    links = compared(blocks, pairs.unionByName(inside), similarity)

    roots = components(links.where(F.col("cls") != F.col("peer")).select(F.col("cls").alias("a"), F.col("peer").alias("b")))
    linked = links.groupBy("cls").agg(F.sum("more").alias("more")).join(
        roots.withColumnRenamed("node", "cls"), "cls", "left")
    found = by_class.select("cls", "doc_id", "copies").join(linked, "cls", "left").select(
        "cls", F.col("doc_id").alias("text_class"), F.coalesce("root", "cls").alias("root"),
        (F.coalesce("more", F.lit(0)) + F.col("copies") - 1).alias("n_links"))
    named = found.groupBy("root").agg(F.min("text_class").alias("class_id"))
    found = found.join(named, "root")
    return rows_of.select("doc_id", "text_hash", "cls", "n_grams").join(found, "cls").select(
        "doc_id", "text_hash", "cls", "root", "n_grams", "text_class", "class_id", "n_links")


def keep_one(docs: DataFrame, similarity: float = SIMILARITY, n: int = N) -> DataFrame:
    """One row of each group: the smallest id, then text hash; all columns are kept.

    A kept row that occurs several times is reduced to one; those few rows are looked up on their own.
    """
    found = store(join(docs, similarity, n))
    kept = found.groupBy("root").agg(
        F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "text_hash")).alias("m")).select(
        F.col("m.doc_id").alias("k_id"), F.col("m.text_hash").alias("k_hash"))
    rows = found.groupBy("doc_id", "text_hash").agg(F.count("*").alias("n_rows"))
    same = F.col("doc_id").eqNullSafe(F.col("k_id")) & (F.col("text_hash") == F.col("k_hash"))
    kept = store(rows.join(kept, same).select("k_id", "k_hash", "n_rows"))
    here = docs.alias("d").join(
        kept.where("n_rows = 1").alias("k"),
        F.col("d.doc_id").cast("long").eqNullSafe(F.col("k.k_id"))
        & (F.xxhash64(F.col("d.text").cast("string")) == F.col("k.k_hash")), "left_semi")
    several = kept.where("n_rows > 1")
    if several.isEmpty():
        return here
    again = docs.alias("d").join(several.alias("k"), F.col("d.doc_id").cast("long").eqNullSafe(F.col("k.k_id"))
                                 & (F.xxhash64(F.col("d.text").cast("string")) == F.col("k.k_hash")), "left_semi")
    return here.unionByName(again.dropDuplicates(["doc_id", "text"]))
