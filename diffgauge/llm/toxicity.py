"""Toxicity by non-negative positive-unlabelled learning.

Only confirmed toxic documents carry a label that counts; all other text is unlabelled, toxic text included.
With the class prior pi, the share of toxic text, the risk of a classifier z is

    R = pi * E_P[l(z)] + max(0, E_U[l(-z)] - pi * E_P[l(-z)])          l(z) = log(1 + exp(-z))

The second term estimates the risk on clean text: what unlabelled text costs as clean, less the toxic share
of it. A flexible classifier can push that estimate below zero by learning single documents; then the step
goes up the term instead of down the risk (Kiryo et al., 2017). The prior is estimated without clean labels:
a run that only toxic text holds is pi times as frequent in unlabelled text as among the positives, any other
is more frequent than that, so pi is read off the purest of the surest runs.

Features are byte runs of lowered words, of ``SIZES`` bytes, a leading blank marking the begin of a word; a
document has a feature or not, so its length matters little. Kept are the runs that are surely more frequent
among the positives than in unlabelled text. The fit reads bounded samples (``POSITIVES`` confirmed and
``UNLABELLED`` rows); their texts stay in tasks, the driver gets counts and bit rows. Scoring reads whole texts
where they lie.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from diffgauge.llm.common import slices, store, texts_of
from diffgauge.llm.importance import LOWER

POSITIVES, UNLABELLED = 3000, 12_000    # rows the fit reads at most
SIZES = (4, 6, 8)                       # bytes of a feature
CANDIDATES = 30_000                     # most frequent runs of the positives that are counted in unlabelled text
FEATURES = 4096                         # runs kept
SURE, RATIO = 2.5, 3.0                  # standard errors, and times the rate in unlabelled text, a kept run must be above
PURE, PURE_SHARE = 100, 0.2             # the prior is this quantile of rate ratios of that many surest runs
EPOCHS, RATE, DECAY = 200, 0.05, 3e-4
TOXIC = 0.3                             # score from which a document counts as toxic
BLOCK_BYTES = 1 << 20

_MASKS = {n: np.uint64((1 << 8 * n) - 1) for n in SIZES}


# ---------------------------------------------------------------- features of texts

def blocks(texts: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Lowered bytes of some texts, blanks between them, and the text of each byte; a long text in several
    blocks that overlap by one run less a byte."""
    data, owner, size = [], [], 0
    for i, text in enumerate(texts):
        raw = b" " + text.encode("utf-8", "surrogatepass").translate(LOWER) + b" " * 8
        for at in range(0, len(raw) - 8, BLOCK_BYTES):
            data.append(raw[at:at + BLOCK_BYTES + 8])
            owner.append(i)
            size += len(data[-1])
            if size >= BLOCK_BYTES:
                yield np.frombuffer(b"".join(data), np.uint8), np.repeat(owner, [len(d) for d in data])
                data, owner, size = [], [], 0
    if data:
        yield np.frombuffer(b"".join(data), np.uint8), np.repeat(owner, [len(d) for d in data])


def windows(data: np.ndarray) -> np.ndarray:
    """The eight bytes from each place as one number, the first byte lowest."""
    padded = np.concatenate([data, np.full(8, 32, np.uint8)])
    return np.ascontiguousarray(np.lib.stride_tricks.sliding_window_view(padded, 8)[:len(data)]).view("<u8")[:, 0]


def runs_of(texts: list[str]) -> np.ndarray:
    """The distinct runs of each text, one text after another: runs whose bytes after the first are no blanks."""
    out = [np.zeros(0, np.uint64)]
    for i, text in enumerate(texts):
        own = []
        for data, _ in blocks([text]):
            value = windows(data)
            solid = np.concatenate([data != 32, np.zeros(8, bool)])
            run = np.ones(len(data), bool)
            for n in range(1, max(SIZES)):
                run &= solid[n:n + len(data)]
                if n + 1 in SIZES:
                    own.append(np.unique(value[run] & _MASKS[n + 1]))
        out.append(np.unique(np.concatenate(own)))
    return np.concatenate(out)


class Vocabulary:
    """Runs in order, found at every place of a text; a bitmap of their first four bytes passes over most places."""

    def __init__(self, runs: np.ndarray):
        self.runs = np.sort(runs.astype(np.uint64))
        self.starts = np.zeros(1 << 16, bool)
        self.starts[self._slot(self.runs)] = True

    @staticmethod
    def _slot(value: np.ndarray) -> np.ndarray:
        return (value.astype(np.uint32) * np.uint32(0x9E3779B1)) >> np.uint32(16)

    def found(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Distinct pairs of a text and a run that it holds."""
        pairs = [np.zeros(0, np.int64)]
        for data, owner in blocks(texts) if len(self.runs) else ():
            value = windows(data)
            at = np.flatnonzero(self.starts[self._slot(value)])
            value, text = value[at], owner[at]
            for n in SIZES:
                code = value & _MASKS[n]
                place = np.minimum(np.searchsorted(self.runs, code), len(self.runs) - 1)
                hit = self.runs[place] == code
                pairs.append(np.unique(text[hit] * len(self.runs) + place[hit]))
        pairs = np.unique(np.concatenate(pairs))
        return pairs // max(1, len(self.runs)), pairs % max(1, len(self.runs))


# ---------------------------------------------------------------- the classifier

def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def risks(z_p: np.ndarray, z_u: np.ndarray, prior: float) -> tuple[float, float]:
    """The two terms of the risk: toxic text taken as clean, and clean text taken as toxic (may be negative)."""
    return (prior * float(np.logaddexp(0, -z_p).mean()),
            float(np.logaddexp(0, z_u).mean()) - prior * float(np.logaddexp(0, z_p).mean()))


def slopes(z_p: np.ndarray, z_u: np.ndarray, prior: float) -> tuple[np.ndarray, np.ndarray]:
    """Direction per positive and per unlabelled document: down the risk, or up its negative second term."""
    p, u = _sigmoid(z_p) * prior / len(z_p), _sigmoid(z_u) / len(z_u)
    if risks(z_p, z_u, prior)[1] < 0:
        return p, -u
    return -_sigmoid(-z_p) * prior / len(z_p) - p, u


def fit(positive: tuple[np.ndarray, np.ndarray, int], unlabelled: tuple[np.ndarray, np.ndarray, int], n_features: int,
        prior: float) -> tuple[np.ndarray, float]:
    """Weights and bias, by Adam over full batches. A sample is its (row, feature) pairs and its number of rows."""
    row = np.concatenate([positive[0], unlabelled[0] + positive[2]])
    feature = np.concatenate([positive[1], unlabelled[1]])
    n, n_p = positive[2] + unlabelled[2], positive[2]
    w = np.zeros(n_features + 1)
    w[-1] = np.log(prior / (1 - prior))
    first, second = np.zeros_like(w), np.zeros_like(w)
    for step in range(1, EPOCHS + 1):
        z = np.bincount(row, w[feature], n) + w[-1]
        slope = np.concatenate(slopes(z[:n_p], z[n_p:], prior))
        g = np.append(np.bincount(feature, slope[row], n_features), slope.sum())
        g[:-1] += DECAY * w[:-1]
        first += 0.1 * (g - first)
        second += 0.001 * (g * g - second)
        w -= RATE * (first / (1 - 0.9 ** step)) / (np.sqrt(second / (1 - 0.999 ** step)) + 1e-8)
    return w[:-1], float(w[-1])


@dataclass
class Model:
    vocabulary: Vocabulary
    weights: np.ndarray
    bias: float

    def score(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Per text the score and the number of its features."""
        text, run = self.vocabulary.found(texts)
        z = np.bincount(text, self.weights[run], len(texts)) if len(run) else np.zeros(len(texts))
        return _sigmoid(z + self.bias), np.bincount(text, minlength=len(texts))


# ---------------------------------------------------------------- jobs

def _sample(docs: DataFrame, size: int) -> DataFrame:
    """At most ``size`` distinct (id, text), by hash; only the hashes (a bounded table) are broadcast."""
    keyed = docs.withColumn("key", F.xxhash64("doc_id", "text"))
    chosen = keyed.select("key").distinct().orderBy(F.xxhash64("key"), "key").limit(size)
    return keyed.join(F.broadcast(chosen), "key").select("key", "text").dropDuplicates(["key"]).select("text")


def training_rows(docs: DataFrame, labels: DataFrame, learn: Column) -> tuple[DataFrame, float]:
    """The stored samples, ``positive, text``, and the share of toxic among all labels to learn from.

    A document labelled several times is toxic if most of its labels say so.
    """
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).where(learn)
    own = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").alias("label"))
    own = own.where(F.col("label").isin(0, 1) & F.col("doc_id").isNotNull() & learn).groupBy("doc_id").agg(
        (F.avg("label") > 0.5).alias("toxic"))
    prior = own.agg(F.avg(F.col("toxic").cast("double"))).first()[0] or 0.0
    confirmed = F.broadcast(own.where("toxic").select("doc_id").orderBy(F.xxhash64("doc_id"), "doc_id").limit(POSITIVES))
    rows = _sample(texts.join(confirmed, "doc_id"), POSITIVES).withColumn("positive", F.lit(True)).unionByName(
        _sample(texts, UNLABELLED).withColumn("positive", F.lit(False)))
    parts = docs.sparkSession.sparkContext.defaultParallelism
    return store(rows.repartition(parts)), prior


def _counts(rows: DataFrame, schema: str) -> dict[int, int]:
    key = schema.split()[0]
    return {r[key]: r["n"] for r in rows.groupBy(key).agg(F.sum("n").alias("n")).collect()}


def candidates(rows: DataFrame, least: int) -> dict[int, int]:
    """Runs in ``least`` or more positives, with that number; at most ``CANDIDATES``, the most frequent."""
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 64):
            runs, n = np.unique(runs_of(texts_of(batch.column("text"))), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(runs.view(np.int64)), pa.array(n.astype(np.int64))], ["run", "n"])

    found = rows.where("positive").select("text").mapInArrow(count, "run long, n long").groupBy("run").agg(
        F.sum("n").alias("n")).where(F.col("n") >= least).orderBy(F.desc("n"), "run").limit(CANDIDATES)
    return {r["run"]: r["n"] for r in found.collect()}


def frequencies(rows: DataFrame, vocabulary: Vocabulary) -> np.ndarray:
    """In how many unlabelled texts each run occurs."""
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(vocabulary.runs), np.int64)
        for batch in slices(batches):
            total += np.bincount(vocabulary.found(texts_of(batch.column("text")))[1], minlength=len(total))
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], ["at", "n"])

    out = np.zeros(len(vocabulary.runs), np.int64)
    counted = rows.where("not positive").select("text").mapInArrow(count, "at long, n long").groupBy("at").agg(F.sum("n").alias("n"))
    for r in counted.collect():
        out[r["at"]] = r["n"]
    return out


def chosen(n_p: np.ndarray, n_u: np.ndarray, positives: int, unlabelled: int) -> tuple[np.ndarray, float]:
    """Places of the runs that are surely more frequent among positives, the surest ``FEATURES``; the class prior."""
    p, u = n_p / positives, n_u / unlabelled
    error = np.sqrt(p * (1 - p) / positives + u * (1 - u) / unlabelled + 1e-12)
    sure = (p - u) / error
    good = np.flatnonzero((sure >= SURE) & (p >= RATIO * u))
    good = good[np.argsort(-sure[good], kind="stable")][:FEATURES]
    top = good[:PURE]
    return good, float(np.quantile(u[top] / p[top], PURE_SHARE)) if len(top) else 0.0


def train(docs: DataFrame, labels: DataFrame, learn: Column) -> Model:
    """The model; without a confirmed document, or a run that tells them apart, the share of toxic labels for all."""
    rows, share = training_rows(docs, labels, learn)
    counts = {r["positive"]: r["n"] for r in rows.groupBy("positive").agg(F.count("*").alias("n")).collect()}
    positives, unlabelled = counts.get(True, 0), counts.get(False, 0)
    share = min(max(share, 1e-3), 1 - 1e-3)
    nothing = Model(Vocabulary(np.zeros(0, np.uint64)), np.zeros(0), float(np.log(share / (1 - share))))
    if not positives or not unlabelled:
        return nothing
    often = candidates(rows, max(2, positives // 200))
    if not often:
        return nothing
    wide = Vocabulary(np.array(list(often), np.int64).view(np.uint64))
    n_p = np.array([often[int(r)] for r in wide.runs.view(np.int64)])
    good, prior = chosen(n_p, frequencies(rows, wide), positives, unlabelled)
    vocabulary = Vocabulary(wide.runs[good])
    n, prior = len(vocabulary.runs), min(max(prior, 1e-3), 1 - 1e-3)
    if not n:
        return nothing

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            bits = np.zeros((batch.num_rows, n), bool)
            bits[vocabulary.found(texts_of(batch.column("text")))] = True
            yield pa.RecordBatch.from_arrays([batch.column("positive"), pa.array(
                [b.tobytes() for b in np.packbits(bits, axis=1)], pa.binary())], ["positive", "bits"])

    # rows of at most FEATURES bits, a bounded number; sorted, so the fit does not depend on their order
    marked = sorted((r["positive"], bytes(r["bits"])) for r in rows.mapInArrow(mark, "positive boolean, bits binary").collect())
    bits = np.unpackbits(np.frombuffer(b"".join(b for _, b in marked), np.uint8).reshape(len(marked), -1), axis=1)[:, :n]
    row, feature = np.nonzero(bits)
    own = row >= unlabelled             # positives sort last
    weights, bias = fit((row[own] - unlabelled, feature[own], positives), (row[~own], feature[~own], unlabelled), n, prior)
    return Model(vocabulary, weights, bias)


def score(docs: DataFrame, model: Model) -> DataFrame:
    """Per row: ``doc_id, score, n_marks`` (features found).

    A null or empty text has no features; a null id stays null; repeated rows are scored each; an empty table
    gives no rows; other columns are not read.
    """
    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            p, n = model.score(texts_of(batch.column("text")))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(p, pa.float64()), pa.array(n, pa.int64())],
                                             ["doc_id", "score", "n_marks"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")
                       ).mapInArrow(scored, "doc_id long, score double, n_marks long")
