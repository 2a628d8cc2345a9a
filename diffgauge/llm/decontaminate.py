"""Benchmark decontamination: every passage of every document asks a BM25 index of the benchmark's items.

An item's term weights are its BM25 weights over their sum, so a passage that holds all words of the item
scores 1, and one limit suits items of any length. Items lie in blocks, and a term's posting list keeps the
highest weight per block. Retrieval follows block-max WAND: the frequent terms of an item, up to a share of
its weight below the limit, cannot lift it over the limit, so only its other, essential terms open a block; a
block whose maxima and idle share do not reach the limit is skipped; in the others the same bound is taken
per item, and what is left is scored exactly. That returns all items above the limit. Hits are verified:
question and answer of the item must overlap the passage.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from diffgauge.llm.common import texts_of

K1, B = 1.2, 0.75
LIMIT = 0.6             # share of an item's BM25 weight that a passage must hold
OVERLAP = 0.5           # share of the word pairs of question and of answer that the passage must hold
IDLE = 0.25             # share of an item's weight, in its most frequent terms, that opens no block
BLOCK = 8               # items in a block of the index
SHORTEST = 8            # shorter items must occur word for word
WORD = re.compile(r"\w+")
INDEX_BYTES = 32 << 20  # texts of the items in one index; a larger benchmark makes several passes


def words_of(text: str | None) -> list[str]:
    return WORD.findall((text or "").lower())


def question_and_answer(words: list[str], raw: str) -> tuple[list[str], list[str]]:
    """An item's two parts: up to the last question mark and after it, else the first two thirds and the rest."""
    head, mark, tail = raw.rpartition("?")
    if mark and words_of(head) and words_of(tail):
        return words_of(head), words_of(tail)
    cut = -(-2 * len(words) // 3)
    return words[:cut], words[cut:]


def grams(words: list[str], n: int) -> set[tuple[str, ...]]:
    return {tuple(words[i:i + n]) for i in range(len(words) - n + 1)}


class Postings:
    """Posting lists of all terms, one after another: places (blocks or items) and weights."""

    def __init__(self, lists: dict[int, dict[int, float]], n_terms: int):
        self.lengths = np.zeros(n_terms, np.int64)
        for t, own in lists.items():
            self.lengths[t] = len(own)
        self.start = np.cumsum(self.lengths) - self.lengths
        order = [(t, p) for t in sorted(lists) for p in sorted(lists[t])]
        self.places = np.array([p for _, p in order], np.int64)
        self.weights = np.array([lists[t][p] for t, p in order])

    def sums(self, window: np.ndarray, term: np.ndarray, n_places: int) -> tuple[np.ndarray, np.ndarray]:
        """For each (window, place) that a posting meets, as window * n_places + place, the sum of weights."""
        lengths = self.lengths[term]
        entry = np.repeat(self.start[term] - np.cumsum(lengths) + lengths, lengths) + np.arange(lengths.sum())
        met, which = np.unique(np.repeat(window, lengths) * n_places + self.places[entry], return_inverse=True)
        return met, np.bincount(which, self.weights[entry], len(met))


class Index:
    """Items with their weights; terms with block maxima. ``df`` and the mean length cover the whole benchmark."""

    def __init__(self, items: list[tuple[int | None, str]], df: dict[str, int], n_items: int, mean_words: float,
                 stride: int):
        self.stride, self.items = stride, items
        self.words = [words_of(t) for _, t in items]
        self.parts = [question_and_answer(w, t) for w, (_, t) in zip(self.words, items)]
        self.terms: dict[str, int] = {}
        self.weights: list[dict[int, float]] = []
        essential: dict[int, dict[int, float]] = defaultdict(dict)
        self.idle = np.zeros(len(items))
        for i, words in enumerate(self.words):
            raw = {}
            for t in set(words):
                tf = words.count(t)
                idf = np.log1p((n_items - df[t] + 0.5) / (df[t] + 0.5))
                raw[t] = idf * tf * (K1 + 1) / (tf + K1 * (1 - B + B * len(words) / mean_words))
            total = sum(raw.values())
            for t, v in sorted(raw.items(), key=lambda x: (-df[x[0]], x[0])):
                k = self.terms.setdefault(t, len(self.terms))
                if self.idle[i] + v / total < IDLE:
                    self.idle[i] += v / total
                else:
                    essential[k][i] = v / total
            self.weights.append({self.terms[t]: v / total for t, v in raw.items()})
        starts = np.arange(0, len(items), BLOCK)
        self.rest = np.maximum.reduceat(self.idle, starts) if len(items) else self.idle
        maxima = {t: {b: max(v for i, v in own.items() if i // BLOCK == b) for b in {i // BLOCK for i in own}}
                  for t, own in essential.items()}
        self.by_block = Postings(maxima, len(self.terms))
        self.by_item = Postings(essential, len(self.terms))

    def hits(self, docs: list[list[str]]) -> list[tuple[int, int, float, float, float, int]]:
        """Verified (text, item, score, question overlap, answer overlap, first word), the best passage of each.

        ``docs``: the words of some texts. Passages are windows of two strides, one stride apart; a stride
        holds the longest item of the index, so every item lies whole in some passage.
        """
        if not self.items:
            return []
        s, get = self.stride, self.terms.get
        # windows of all texts in one row: a text of n words has the windows 0 .. (n - 1) // s
        first = np.cumsum([0] + [-(-len(d) // s) for d in docs])
        sizes = np.array([len(d) for d in docs])
        terms = np.fromiter(map(get, chain.from_iterable(docs), repeat(-1)), np.int64, int(sizes.sum()))
        doc = np.repeat(np.arange(len(docs)), sizes)
        at = np.arange(len(terms)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        known = np.flatnonzero(terms >= 0)
        known = known[self.by_item.lengths[terms[known]] > 0]
        window = first[doc[known]] + at[known] // s
        # a word lies in the window that begins in its stride and in the one before
        earlier = at[known] >= s
        pairs = np.unique(np.concatenate([window, window[earlier] - 1]) * len(self.terms)
                          + np.concatenate([terms[known], terms[known][earlier]]))
        window, term = pairs // len(self.terms), pairs % len(self.terms)
        place, bound = self.by_block.sums(window, term, len(self.rest))
        place = place[bound + self.rest[place % len(self.rest)] >= LIMIT - 1e-9]
        opened = np.isin(window, place // len(self.rest))
        chosen, bound = self.by_item.sums(window[opened], term[opened], len(self.items))
        chosen = chosen[(bound + self.idle[chosen % len(self.items)] >= LIMIT - 1e-9)
                        & np.isin(chosen // len(self.items) * len(self.rest) + chosen % len(self.items) // BLOCK, place)]
        best: dict[tuple[int, int], tuple] = {}
        seen, held = -1, []
        for p in chosen.tolist():
            w, i = divmod(p, len(self.items))
            if w != seen:
                seen, d = w, int(np.searchsorted(first, w, "right") - 1)
                start = (w - int(first[d])) * s
                held = docs[d][start:start + 2 * s]
                ids = {get(x) for x in held}
            score = sum(v for t, v in self.weights[i].items() if t in ids)
            if score >= LIMIT - 1e-9:
                question, answer = self.overlap(i, held)
                if min(question, answer) >= OVERLAP:
                    found = (score, question, answer, start)
                    if (d, i) not in best or found[:3] > best[d, i][:3]:
                        best[d, i] = found
        return [(d, i, *v) for (d, i), v in sorted(best.items())]

    def overlap(self, i: int, passage: list[str]) -> tuple[float, float]:
        """Shares of the word pairs of question and answer that occur in the passage."""
        n = len(self.words[i])
        if n < SHORTEST:
            whole = float(tuple(self.words[i]) in grams(passage, n))
            return whole, whole
        there = grams(passage, 2)
        return tuple(len(g & there) / len(g) if (g := grams(p, 2)) else float(p[0] in passage) if p else 1.0
                     for p in self.parts[i])


def stride_of(n_words: int) -> int:
    """Windows suit the item: its length class, the next power of two, 32 at least."""
    return max(32, 1 << (n_words - 1).bit_length())


def indexes(benchmark: DataFrame, most: int = INDEX_BYTES) -> Iterator[list[Index]]:
    """The indexes of one pass over the documents after another; the items of a pass take about ``most`` bytes.

    A pass has one index for each length class of its items, so a long item does not widen the windows of the
    others. Document frequencies, item count and mean length are counted by Spark over the whole benchmark, so a
    score does not depend on the number of passes. Null and wordless items are left out. One pass at a time is
    held by the driver.
    """
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")
                             ).distinct().where(F.col("text").isNotNull())
    size = items.agg(F.sum(F.octet_length("text")).alias("b")).first()["b"] or 0
    shards = -(-size // most)
    if not shards:
        return

    def words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = [words_of(t) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array([sorted(set(w)) for w in own], pa.list_(pa.string())),
                                              pa.array([len(w) for w in own], pa.int64()), batch.column("shard")],
                                             ["terms", "n", "shard"])

    items = items.withColumn("shard", F.pmod(F.xxhash64("item_id", "text"), F.lit(shards)).cast("int"))
    counted = items.select("text", "shard").mapInArrow(words, "terms array<string>, n long, shard int").where("n > 0")
    total = counted.agg(F.count("*").alias("items"), F.avg("n").alias("mean")).first()
    if not total["items"]:
        return
    in_shard = counted.select("shard", F.explode("terms").alias("term"))
    df = in_shard.groupBy("term").agg(F.count("*").alias("df"))
    for k in range(shards):     # each holds at most about ``most`` bytes of text
        own = [(r["item_id"], r["text"]) for r in items.where(F.col("shard") == k).select("item_id", "text").collect()]
        own = sorted(((i, t) for i, t in own if words_of(t)), key=lambda x: (x[0] is None, x[0] or 0, x[1]))
        if not own:
            continue
        terms = in_shard.where(F.col("shard") == k).select("term").distinct()
        counts = {r["term"]: r["df"] for r in df.join(terms, "term").collect()}
        classes = defaultdict(list)
        for item in own:
            classes[stride_of(len(words_of(item[1])))].append(item)
        yield [Index(classes[s], counts, total["items"], total["mean"], s) for s in sorted(classes)]


TEXTS_AT_ONCE = 64


def _found(own: list[Index], texts: list[str]) -> Iterator[tuple]:
    """(text, index, item, ...) of all hits of one pass; words are cut once for all its indexes."""
    for at in range(0, len(texts), TEXTS_AT_ONCE):
        docs = [words_of(t) for t in texts[at:at + TEXTS_AT_ONCE]]
        for index in own:
            for d, *hit in index.hits(docs):
                yield at + d, index, *hit


def leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Pairs of a document and a benchmark item it holds, with the best passage.

    Result: ``doc_id, item_id, score, question_overlap, answer_overlap, first_word, n_words``. Null and
    empty texts hold nothing; a null id stays null; repeated rows give a row each; an empty benchmark gives
    none. The items of a pass are bounded by ``INDEX_BYTES`` and travel with the tasks; documents are not shuffled.
    """
    result = ("doc_id long, item_id long, score double, question_overlap double, answer_overlap double, "
              "first_word long, n_words long")
    names = [f.split()[0] for f in result.split(", ")]
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))

    def of(own: list[Index]) -> DataFrame:
        def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                ids = batch.column("doc_id").to_pylist()
                rows = [(ids[d], index.items[i][0], score, q, a, at, len(index.words[i]))
                        for d, index, i, score, q, a, at in _found(own, texts_of(batch.column("text")))]
                columns = list(zip(*rows)) or [()] * 7
                types = [pa.int64()] * 2 + [pa.float64()] * 3 + [pa.int64()] * 2
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names)
        return texts.mapInArrow(search, result)

    found = [of(own) for own in indexes(benchmark)]
    out = found[0] if found else docs.sparkSession.createDataFrame([], result)
    for more in found[1:]:
        out = out.unionByName(more)
    return out


def clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows that hold no benchmark item, with all their columns."""
    fields = docs.schema
    for own in indexes(benchmark):
        def kept(batches: Iterator[pa.RecordBatch], own: list[Index] = own) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                hit = {d for d, *_ in _found(own, texts_of(batch.column("text")))}
                yield batch.filter(pa.array([d not in hit for d in range(batch.num_rows)], pa.bool_()))
        docs = docs.mapInArrow(kept, fields)
    return docs
