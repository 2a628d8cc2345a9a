"""Importance resampling towards a target: weights by bit-sliced aggregation.

A document's features (runs of 1 to 3 words) are counted in ``BUCKETS`` buckets. Plane k of a document is a
bitmap of all buckets: bit b is bit k of the count in bucket b. The gains of the buckets are sliced the same
way, positive and negative ones apart. Then

    weight = sum over planes i, j of 2^(i+j) * (popcount(counts_i & positive_j) - popcount(counts_i & negative_j))

which is exact in integers. The planes are written once: the bucket totals of the corpus come from the task
that makes them, the weights from a second pass over the stored planes, so no text is read twice and neither
texts nor planes are shuffled. Draws add Gumbel noise of the document's id to its weight; the highest are
found by a range sort of (score, id) alone.

Feature hashes are CRC-32, a linear code: the hash of a run follows from the hashes of its words and their
lengths, so all runs of a block of texts are hashed as arrays, without building one of them.
"""

from __future__ import annotations

import hashlib
import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from diffgauge.llm.common import partition_id, part_bases, slices, store, texts_of

BUCKETS = 10_000
WORDS = (BUCKETS + 63) // 64        # 64-bit words of a plane
SHORTEST = 20                       # words from which a document can be drawn
PERCENT = 5                         # drawn, of the documents that can be
SEED = 42
BLOCK_BYTES = 1 << 21               # text handled at once; a longer document goes through in several blocks
SHORT_WORD = 48                     # longer words are hashed one by one


# ---------------------------------------------------------------- hashes of words and runs

def _lowering() -> bytes:
    """Bytes of words as they count, all others as blanks."""
    return bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32
                 for b in range(256))


LOWER = _lowering()
# one byte moved through the register, without the inversions at begin and end
_STEP = np.array([zlib.crc32(bytes([b]), 0xFFFFFFFF) ^ 0xFFFFFFFF for b in range(256)], np.uint32)


def _shifts() -> np.ndarray:
    """Tables that move a hash over n bytes: the hash of x + y is shift[len(y)](hash of x) ^ hash of y."""
    one = np.zeros((4, 256), np.uint32)     # over one byte: crc(x + "\\0") ^ crc("\\0"), which is linear in crc(x)
    basis = [zlib.crc32(b"\0", 1 << bit) ^ zlib.crc32(b"\0", 0) for bit in range(32)]
    for place in range(4):
        for b in range(256):
            value = 0
            for bit in range(8):
                if b >> bit & 1:
                    value ^= basis[8 * place + bit]
            one[place, b] = value
    out = np.zeros((SHORT_WORD + 2, 4, 256), np.uint32)
    for place in range(4):
        out[0, place] = np.arange(256, dtype=np.uint32) << np.uint32(8 * place)
    for n in range(1, len(out)):
        prior = out[n - 1]
        out[n] = one[0][prior & 255] ^ one[1][prior >> 8 & 255] ^ one[2][prior >> 16 & 255] ^ one[3][prior >> 24]
    return out


_SHIFT: list[np.ndarray] = []


def _moved(crc: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Hashes moved over n bytes each."""
    if not _SHIFT:
        _SHIFT.append(_shifts().reshape(-1))
    flat, most = _SHIFT[0], SHORT_WORD + 1
    crc, left = crc.copy(), n.astype(np.int64)
    at = np.arange(len(crc))
    while len(at):
        k = np.minimum(left[at], most)
        c, base = crc[at], k * 1024
        crc[at] = (flat[base + (c & 255)] ^ flat[base + 256 + (c >> 8 & 255)]
                   ^ flat[base + 512 + (c >> 16 & 255)] ^ flat[base + 768 + (c >> 24)])
        left[at] -= k
        at = at[left[at] > 0]
    return crc


def words_in(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the words of lowered bytes."""
    solid = np.empty(len(data) + 2, bool)
    solid[0] = solid[-1] = False
    np.not_equal(data, 32, out=solid[1:-1])
    edges = np.flatnonzero(solid[1:] != solid[:-1])
    return edges[::2], edges[1::2]


def word_crcs(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """CRC-32 of each word, byte by byte over all words that are long enough."""
    size = end - start
    order = np.argsort(-size, kind="stable")
    first, left = start[order], -size[order]
    long = int(np.searchsorted(left, -SHORT_WORD, "left"))
    state = np.full(len(start), 0xFFFFFFFF, np.uint32)
    for k in range(-int(left[long]) if long < len(left) else 0):
        n = int(np.searchsorted(left, -k, "left"))      # words of more than k bytes
        s = state[long:n]
        state[long:n] = _STEP[(s ^ data[first[long:n] + k]) & 255] ^ (s >> np.uint32(8))
    out = np.empty_like(state)
    out[order] = ~state
    for i in order[:long].tolist():
        out[i] = zlib.crc32(data[start[i]:end[i]].tobytes())
    return out


def feature_hashes(crc: np.ndarray, size: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of 1 to 3 words of one text, and the number of the last word of each run."""
    blank = np.full(len(crc), zlib.crc32(b" "), np.uint32)
    led = _moved(blank, size) ^ crc                     # a blank and the word
    at = np.arange(len(crc))
    two = at[1:][doc[1:] == doc[:-1]]
    pair = np.zeros_like(crc)
    pair[two] = _moved(crc[two - 1], size[two] + 1) ^ led[two]
    three = at[2:][doc[2:] == doc[:-2]]
    triple = _moved(pair[three - 1], size[three] + 1) ^ led[three]
    return np.concatenate([crc, pair[two], triple]), np.concatenate([at, two, three])


class Counts:
    """Bucket counts of several texts, added up block by block."""

    def __init__(self, texts: int):
        self.counts = np.zeros((texts, BUCKETS), np.int64)
        self.words = np.zeros(texts, np.int64)

    def add(self, parts: list[tuple[int, bytes, int]]) -> None:
        """Pieces (text, lowered bytes, words at the begin that were counted before)."""
        data = np.frombuffer(b" ".join(p for _, p, _ in parts), np.uint8)
        ends = np.cumsum([len(p) + 1 for _, p, _ in parts])
        start, end = words_in(data)
        if not len(start):
            return
        piece = np.searchsorted(ends, start, "right")
        hashes, last = feature_hashes(word_crcs(data, start, end), end - start, piece)
        first = np.searchsorted(piece, np.arange(len(parts)))
        fresh = first + np.array([k for _, _, k in parts])
        new = last >= fresh[piece[last]]                # runs that end in a word not counted before
        texts = np.array([t for t, _, _ in parts])
        cell = texts[piece[last[new]]] * BUCKETS + (hashes[new] % np.uint32(BUCKETS)).astype(np.int64)
        self.counts += np.bincount(cell, minlength=self.counts.size).reshape(self.counts.shape)
        own = np.arange(len(start)) >= fresh[piece]
        self.words += np.bincount(texts[piece[own]], minlength=len(self.words))


def _pieces(text: bytes) -> Iterator[tuple[bytes, int]]:
    """A long text cut behind words, each piece led by the last two words of those before."""
    if len(text) <= BLOCK_BYTES:
        yield text, 0
        return
    at, tail = 0, []
    while at < len(text):
        stop = at + BLOCK_BYTES
        stop = len(text) if stop >= len(text) else text.find(b" ", stop)
        stop = len(text) if stop < 0 else stop
        body = text[at:stop]
        yield b" ".join([*tail, body]), len(tail)
        tail = (tail + body.rsplit(None, 2)[-2:])[-2:]
        at = stop


def count_texts(texts: list[str]) -> Counts:
    out = Counts(len(texts))
    held, size = [], 0
    for i, text in enumerate(texts):
        for piece, known in _pieces(text.encode("utf-8", "surrogatepass").translate(LOWER)):
            held.append((i, piece, known))
            size += len(piece)
            if size >= BLOCK_BYTES:
                out.add(held)
                held, size = [], 0
    if held:
        out.add(held)
    return out


# ---------------------------------------------------------------- bit planes

def planes_of(values: np.ndarray) -> np.ndarray:
    """Bit planes of non-negative integers per row: planes x rows x WORDS; as many planes as the largest needs."""
    n = int(values.max()).bit_length() if values.size else 0
    out = np.zeros((n, len(values), WORDS * 8), np.uint8)
    for k in range(n):
        out[k, :, :(BUCKETS + 7) // 8] = np.packbits((values >> k & 1).astype(bool), axis=1, bitorder="little")
    return out.view("<u8")


class Gains:
    """Signed gains as bit planes."""

    def __init__(self, gains: np.ndarray):
        self.planes = [(sign << k, plane[0]) for sign, part in ((1, np.maximum(gains, 0)), (-1, np.maximum(-gains, 0)))
                       for k, plane in enumerate(planes_of(part[None, :]))]

    def weights(self, counts: list[np.ndarray]) -> np.ndarray:
        """Exact weights of documents, each given as its planes (planes x WORDS)."""
        sizes = np.array([len(c) for c in counts], np.int64)
        if not sizes.sum():
            return np.zeros(len(counts), np.int64)
        rows = np.concatenate(counts)
        value = np.zeros(len(rows), np.int64)
        for factor, plane in self.planes:
            value += factor * np.bitwise_count(rows & plane).sum(1, dtype=np.int64)
        first = np.cumsum(sizes) - sizes
        value <<= np.arange(len(rows)) - np.repeat(first, sizes)
        ends = np.concatenate([[0], np.cumsum(value)])
        return ends[first + sizes] - ends[first]


def gains_of(own: np.ndarray, target: np.ndarray) -> np.ndarray:
    """floor(1000 ln of the ratio of smoothed shares), target over own, in doubles."""
    s, t = float(own.sum()), float(target.sum())
    return np.array([math.floor(1000 * math.log((float(b) + 1) * (s + BUCKETS) / ((float(a) + 1) * (t + BUCKETS))))
                     for a, b in zip(own.tolist(), target.tolist())], np.int64)


# ---------------------------------------------------------------- jobs

PLANES = "doc_id long, n_words long, n_features long, planes binary, totals binary"
_PLANES_TYPES = [pa.int64()] * 3 + [pa.binary()] * 2
_PLANES_NAMES = [f.split()[0] for f in PLANES.split(", ")]


def sliced(docs: DataFrame) -> DataFrame:
    """The stored planes of all rows; each task adds one row with the bucket totals of its rows."""
    def slice_texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals = np.zeros(BUCKETS, np.int64)
        for batch in slices(batches, 128):
            found = count_texts(texts_of(batch.column("text")))
            totals += found.counts.sum(0)
            most = found.counts.max(1)
            planes = planes_of(found.counts)
            own = [planes[:int(m).bit_length(), i].tobytes() for i, m in enumerate(most)]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(found.words), pa.array(found.counts.sum(1)),
                 pa.array(own, pa.binary()), pa.nulls(len(own), pa.binary())], _PLANES_NAMES)
        yield pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(
            (None, None, None, None, totals.tobytes()), _PLANES_TYPES)], _PLANES_NAMES)

    return store(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
                 .mapInArrow(slice_texts, PLANES))


def bucket_totals(planes: DataFrame) -> np.ndarray:
    """Counts per bucket over all rows; partial totals meet by bucket, ``BUCKETS`` rows reach the driver."""
    def entries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = np.zeros(BUCKETS, np.int64)
        for batch in batches:
            for blob in batch.column("totals").to_pylist():
                own += np.frombuffer(blob, np.int64)
        at = np.flatnonzero(own)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(own[at])], ["bucket", "n"])

    rows = planes.where("totals is not null").select("totals").mapInArrow(entries, "bucket long, n long")
    out = np.zeros(BUCKETS, np.int64)
    for r in rows.groupBy("bucket").agg(F.sum("n").alias("n")).collect():
        out[r["bucket"]] = r["n"]
    return out


def noise(doc_id: int | None, seed: int) -> int:
    """Gumbel noise of an id in thousandths, rounded down; a null id counts as the empty text."""
    h = int(hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
    return math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))


def weighed(planes: DataFrame, gains: Gains, seed: int = SEED) -> DataFrame:
    """``doc_id, n_words, n_features, weight, score`` of every row, from its stored planes."""
    names = ["doc_id", "n_words", "n_features", "weight", "score"]

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 1024):
            weights = gains.weights([np.frombuffer(b, "<u8").reshape(-1, WORDS) for b in batch.column("planes").to_pylist()])
            scores = weights + np.array([noise(i, seed) for i in batch.column("doc_id").to_pylist()], np.int64)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names[:3]), pa.array(weights), pa.array(scores)],
                                             names)

    rows = planes.where("totals is null").select("doc_id", "n_words", "n_features", "planes")
    return store(rows.mapInArrow(weigh, ", ".join(f"{n} long" for n in names)))


def ranked(rows: DataFrame, shortest: int = SHORTEST, percent: int = PERCENT) -> DataFrame:
    """Adds ``rank``: 1, 2, ... for the highest scores among rows of enough words, null for all others.

    A range sort on the whole order; a part numbers its own rows, and part totals give the rest.
    """
    able = F.col("n_words") >= shortest
    drawn = rows.where(able).count() * percent // 100
    order = [(~able).cast("int"), F.col("score").desc(), F.col("doc_id").asc_nulls_last(), F.col("n_features"), F.col("weight")]
    fields = [f.name for f in rows.schema]

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, before = partition_id(), 0
        for batch in batches:
            n = batch.num_rows
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in fields), pa.array([part] * n, pa.int32()),
                                              pa.array(np.arange(before, before + n))], [*fields, "part", "place"])
            before += n

    parts = max(1, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    placed = store(rows.repartitionByRange(parts, *order).sortWithinPartitions(*order).mapInArrow(
        number, ", ".join([*(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema), "part int", "place long"])))
    # one row per part
    bases = F.broadcast(part_bases(placed.select("part", F.lit(1).alias("one")), "part", "one").select("part", "base"))
    rank = F.col("base") + F.col("place") + 1
    return placed.join(bases, "part").select(*fields, F.when(rank <= drawn, rank).alias("rank"))


def resample(docs: DataFrame, target: DataFrame, percent: int = PERCENT, seed: int = SEED) -> DataFrame:
    """Every row of ``docs`` with its weight towards the texts of ``target`` and, if drawn, its rank.

    Result: ``doc_id, n_words, n_features, weight, score, rank``. Null and empty texts have no features and
    weight 0; a null id stays null, counts as the empty text in the noise and comes last among equal scores;
    repeated rows count and are ranked once per row; with an empty target all target counts are 0; an empty
    table gives no rows. Other columns are not read.
    """
    planes = sliced(docs)
    wanted = sliced(target.select(F.lit(None).alias("doc_id"), "text"))
    gains = Gains(gains_of(bucket_totals(planes), bucket_totals(wanted)))
    return ranked(weighed(planes, gains, seed), percent=percent)
