"""Quality by attention-based multiple-instance learning: a document is a bag of passages.

Every passage of ``PASSAGE`` words is encoded: statistics of its characters and words, then a learned dense
layer. Gated attention weighs the passages of a document, and the weighted mean of their codes is scored.
Only documents carry labels; the passage weights are learned from them. The fit runs on a bounded sample of
labelled rows (``SAMPLE`` documents, all passages of each); scoring reads whole texts, too.
"""

from __future__ import annotations

import unicodedata
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from diffgauge.llm.common import slices, texts_of

PASSAGE = 100           # words
SAMPLE = 4000           # labelled documents used for the fit
FEATURES = 18
CODE, GATE = 16, 8      # width of a passage code and of the attention gate
EPOCHS, RATE, DECAY = 250, 0.02, 1e-4
KEEP = 0.7              # score from which a document counts as good

_SPACE, _LOWER, _UPPER, _LETTER, _DIGIT, _PERIOD, _MARK, _SYMBOL = range(8)


def _class_of(c: str) -> int:
    kind = unicodedata.category(c)
    if c.isspace():
        return _SPACE
    return {"Ll": _LOWER, "Lu": _UPPER, "Nd": _DIGIT}.get(kind) or (
        _LETTER if kind[0] == "L" or kind[0] == "M" else _PERIOD if c in ".,;:?" else _MARK if c in "!'\"()-" else _SYMBOL)


_CLASSES: list[np.ndarray] = []


def _classes(text: str) -> np.ndarray:
    if not _CLASSES:
        _CLASSES.append(np.array([_class_of(chr(i)) for i in range(1 << 16)], np.uint8))
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")
    return _CLASSES[0][np.minimum(codes, (1 << 16) - 1)]


def passages(text: str) -> np.ndarray:
    """One row of statistics per passage; a text without words is one passage of zeros."""
    words = text.split()
    if not words:
        return np.zeros((1, FEATURES))
    kinds = _classes(text)
    solid = kinds != _SPACE
    starts = np.flatnonzero(solid & np.concatenate([[True], ~solid[:-1]]))
    cut = np.append(starts[::PASSAGE], len(kinds))
    counts = np.stack([np.diff(np.concatenate([[0], np.cumsum(kinds == k)])[cut]) for k in range(8)], 1).astype(float)
    out = np.empty((len(cut) - 1, FEATURES))
    chars = np.maximum(counts[:, 1:].sum(1), 1)
    letters = np.maximum(counts[:, 1:4].sum(1), 1)
    for i in range(len(out)):
        own = words[i * PASSAGE:(i + 1) * PASSAGE]
        n = len(own)
        most = Counter(own).most_common(1)[0][1]
        distinct = len(set(own))
        out[i, :9] = (np.log1p(n) / 5, chars[i] / n / 10, distinct / n, most / n,
                      sum(map(str.__eq__, own, own[1:])) / n, sum(map(str.isupper, own)) / n,
                      sum(map(str.istitle, own)) / n, sum(not w[-1].isalnum() for w in own) / n,
                      sum(len(w) == 1 and not w.isalnum() for w in own) / n)
        out[i, 9] = sum(len(w) <= 3 for w in own) / n
    out[:, 10:16] = counts[:, [_UPPER, _LETTER, _DIGIT, _PERIOD, _MARK, _SYMBOL]] / chars[:, None]
    out[:, 16] = counts[:, _UPPER] / letters
    out[:, 17] = counts[:, _SPACE] / chars
    return out


@dataclass
class Model:
    """Weights of the encoder, the gated attention and the scorer; ``prior`` alone where nothing was learned."""

    mean: np.ndarray
    spread: np.ndarray
    weights: dict[str, np.ndarray]

    def score(self, bags: list[np.ndarray]) -> tuple[np.ndarray, list[np.ndarray]]:
        """Per bag the probability of label 1 and the attention of its passages."""
        if not bags:
            return np.zeros(0), []
        ends = np.cumsum([len(b) for b in bags])
        x = np.clip((np.concatenate(bags) - self.mean) / self.spread, -8, 8)
        p, attention, _ = _forward(self.weights, x, ends - [len(b) for b in bags])
        return p, np.split(attention, ends[:-1])


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def _forward(w: dict, x: np.ndarray, first: np.ndarray):
    sizes = np.diff(np.append(first, len(x)))
    code = np.tanh(x @ w["encode"] + w["encode_bias"])
    value, gate = np.tanh(code @ w["value"]), _sigmoid(code @ w["gate"])
    energy = (value * gate) @ w["attend"]
    weight = np.exp(energy - np.repeat(np.maximum.reduceat(energy, first), sizes))
    attention = weight / np.repeat(np.add.reduceat(weight, first), sizes)
    bag = np.add.reduceat(attention[:, None] * code, first)
    return _sigmoid(bag @ w["score"] + w["score_bias"]), attention, (sizes, code, value, gate, bag)


def fit(bags: list[np.ndarray], labels: np.ndarray, seed: int = 11) -> Model:
    """Adam on the cross entropy of the documents' labels; full batches, so the same rows give the same model."""
    rnd = np.random.default_rng(seed)
    w = {"encode": rnd.normal(0, FEATURES ** -0.5, (FEATURES, CODE)), "encode_bias": np.zeros(CODE),
         "value": rnd.normal(0, CODE ** -0.5, (CODE, GATE)), "gate": rnd.normal(0, CODE ** -0.5, (CODE, GATE)),
         "attend": rnd.normal(0, GATE ** -0.5, GATE), "score": np.zeros(CODE), "score_bias": np.zeros(1)}
    if not bags:
        return Model(np.zeros(FEATURES), np.ones(FEATURES), w)
    x = np.concatenate(bags)
    mean, spread = x.mean(0), np.maximum(x.std(0), 1e-3)
    x = np.clip((x - mean) / spread, -8, 8)
    first = np.cumsum([0] + [len(b) for b in bags])[:-1]
    share = np.clip(labels.mean(), 1e-3, 1 - 1e-3)
    w["score_bias"][0] = np.log(share / (1 - share))
    moments = {k: (np.zeros_like(v), np.zeros_like(v)) for k, v in w.items()}
    for step in range(1, EPOCHS + 1):
        p, attention, (sizes, code, value, gate, bag) = _forward(w, x, first)
        d_logit = (p - labels) / len(labels)
        grad = {"score": bag.T @ d_logit, "score_bias": d_logit.sum(keepdims=True)}
        d_bag = np.repeat(d_logit, sizes)[:, None] * w["score"]
        d_attention = (d_bag * code).sum(1)
        d_energy = attention * (d_attention - np.repeat(np.add.reduceat(attention * d_attention, first), sizes))
        grad["attend"] = (value * gate).T @ d_energy
        d_mix = d_energy[:, None] * w["attend"]
        d_value, d_gate = d_mix * gate * (1 - value ** 2), d_mix * value * gate * (1 - gate)
        grad["value"], grad["gate"] = code.T @ d_value, code.T @ d_gate
        d_code = attention[:, None] * d_bag + d_value @ w["value"].T + d_gate @ w["gate"].T
        d_in = d_code * (1 - code ** 2)
        grad["encode"], grad["encode_bias"] = x.T @ d_in, d_in.sum(0)
        for k, v in w.items():
            g = grad[k] + DECAY * v
            m, s = moments[k]
            m += 0.1 * (g - m)
            s += 0.001 * (g * g - s)
            v -= RATE * (m / (1 - 0.9 ** step)) / (np.sqrt(s / (1 - 0.999 ** step)) + 1e-8)
    return Model(mean, spread, w)


def sample(docs: DataFrame, labels: DataFrame, learn: Column, size: int = SAMPLE) -> DataFrame:
    """At most ``size`` labelled documents, chosen by the hash of their id: ``doc_id, label, features``.

    A document labelled several times gets the mean. Only the chosen ids (a bounded table) are broadcast.
    """
    own = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").alias("label"))
    own = own.where(F.col("label").isin(0, 1) & F.col("doc_id").isNotNull() & learn)
    chosen = own.groupBy("doc_id").agg(F.avg("label").alias("label")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(size)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            bags = []
            for text in texts_of(batch.column("text")):
                bags.append(passages(text).tobytes())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("label"),
                                              pa.array(bags, pa.binary())], ["doc_id", "label", "features"])

    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    rows = texts.join(F.broadcast(chosen), "doc_id").select("doc_id", "text", "label")
    # an id that repeats with several texts counts once
    return rows.mapInArrow(encode, "doc_id long, label double, features binary").groupBy("doc_id", "label").agg(
        F.max("features").alias("features"))


def train(docs: DataFrame, labels: DataFrame, learn: Column, size: int = SAMPLE) -> Model:
    """The model from the sampled bags; without a label it gives 0.5 to every document."""
    rows = sorted(sample(docs, labels, learn, size).collect(), key=lambda r: r["doc_id"])
    return fit([np.frombuffer(r["features"]).reshape(-1, FEATURES) for r in rows],
               np.array([r["label"] for r in rows]))


def _scores(model: Model, texts: list[str]) -> tuple[list[float], list[int], list[int]]:
    bags = [passages(t) for t in texts]
    p, attention = model.score(bags)
    return p.tolist(), [len(b) for b in bags], [int(a.argmax()) for a in attention]


def score(docs: DataFrame, model: Model) -> DataFrame:
    """Per row: ``doc_id, score, n_passages, top_passage`` (the passage with the highest attention).

    Whole texts are read where they lie. A null or empty text is a bag of one empty passage; a null id stays
    null; repeated rows are scored each; other columns are not read.
    """
    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            p, n, top = _scores(model, texts_of(batch.column("text")))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(p, pa.float64()), pa.array(n, pa.int64()),
                                              pa.array(top, pa.int64())], ["doc_id", "score", "n_passages", "top_passage"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")
                       ).mapInArrow(scored, "doc_id long, score double, n_passages long, top_passage long")


def keep(docs: DataFrame, model: Model, least: float = KEEP) -> DataFrame:
    """The rows whose text scores ``least`` or more, with all their columns."""
    def kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            p, _, _ = _scores(model, texts_of(batch.column("text")))
            yield batch.filter(pa.array([x >= least for x in p], pa.bool_()))

    return docs.mapInArrow(kept, docs.schema)
