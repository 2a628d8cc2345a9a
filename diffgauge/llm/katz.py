"""Katz backoff: Good-Turing discounted bigram counts with exactly normalised backoff weights.

    P(w | h) = d(c(h,w)) c(h,w) / (c(h) + 1)      where (h, w) was seen in training
             = alpha(h) P(w)                      else; alpha(h) = 1 for an unseen history
    P(w)     = d1(c(w)) c(w) / (N + 1)            for a seen word, and what is left for the unknown word
    alpha(h) = (1 - sum of P(w | h) over seen w) / (1 - sum of P(w) over the same w)

The one in c(h) + 1 keeps some mass for backing off even where every count is too large to be discounted.
Probabilities sum to one for every history, over all words and the unknown word.

Words are 64-bit hashes. Tokens are shuffled once, packed: a row is what one block of documents sends to one
bucket, sorted and compressed. A bucket holds all tokens of its words, each with the word before it, so it
counts words and bigrams exactly and adds up per document all terms that depend on them. A word that holds
a large share of a bucket is dealt over all buckets by its pairs instead; its total comes from a first pass.
Terms that need the discounts are carried as counts of their class. The bigram table is stored by bucket;
backoff weights come from it by a second, smaller shuffle on the history, to which held-out tokens with an
unseen bigram are sent too.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from diffgauge.llm.common import partition_id, store, texts_of
from diffgauge.session import scratch_dir

DISCOUNTED = 5                  # counts up to this are discounted
BUCKET_TOKENS = 4_000_000       # tokens a bucket should hold
HOT_PART = 0.25                 # share of a bucket from which a word is dealt over all buckets
KNOWN_WORDS = 500_000           # hashes of words kept by a Python worker
END, START = np.uint64(1), np.uint64(2)

_WORDS: dict[bytes, int] = {}


def _word_hash(word: bytes) -> int:
    h = _WORDS.get(word)
    if h is None:
        if len(_WORDS) >= KNOWN_WORDS:
            _WORDS.clear()
        h = _WORDS[word] = xxhash.xxh3_64_intdigest(word)
    return h


def word_hashes(text: str) -> np.ndarray:
    """Hashes of a text's tokens and the end: A-Z lowered, cut at the six ASCII white-space characters."""
    words = text.encode("utf-8", "surrogatepass").lower().split()
    out = np.empty(len(words) + 1, np.uint64)
    out[:-1] = np.fromiter(map(_word_hash, words), np.uint64, len(words))
    out[-1] = END
    return out


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    return x ^ (x >> np.uint64(29))


def _pair(h: np.ndarray, w: np.ndarray) -> np.ndarray:
    return _mixed(_mixed(h) + w * np.uint64(0xD6E8FEB86659FD93))


# ---------------------------------------------------------------- packed arrays

def _pack(**arrays: np.ndarray) -> bytes:
    """Named arrays of unsigned integers or floats in one compressed blob; integers byte plane by byte plane."""
    out = []
    for name, a in arrays.items():
        a = np.ascontiguousarray(a)
        if a.dtype.kind in "iu" and a.dtype != np.uint64:
            most = int(a.max()) if len(a) else 0
            a = a.astype("u1" if most < 1 << 8 else "u2" if most < 1 << 16 else "u4" if most < 1 << 32 else "u8")
        plain = a.view("u1").reshape(len(a), a.itemsize).T.tobytes() if a.dtype.kind == "u" else a.tobytes()
        out.append(f"{name}:{a.dtype.str}:{len(a)};".encode())
        out.append(plain)
    head = b"".join(out[::2]) + b"\n"
    return zstandard.ZstdCompressor(level=3).compress(head + b"".join(out[1::2]))


def _unpack(blob: bytes) -> dict[str, np.ndarray]:
    data = zstandard.ZstdDecompressor().decompress(blob)
    at = data.index(b"\n") + 1
    out = {}
    for part in data[:at - 1].decode().split(";")[:-1]:
        name, kind, n = part.split(":")
        kind, n = np.dtype(kind), int(n)
        raw = np.frombuffer(data, "u1", n * kind.itemsize, at)
        at += n * kind.itemsize
        if kind.kind == "u":
            raw = np.ascontiguousarray(raw.reshape(kind.itemsize, n).T)
        out[name] = raw.view(kind).reshape(n)
    return out


def _coded(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct values, the frequent first, and the place of each value among them."""
    distinct, place, counts = np.unique(values, return_inverse=True, return_counts=True)
    order = np.argsort(-counts, kind="stable")
    rank = np.empty(len(order), np.int64)
    rank[order] = np.arange(len(order))
    return distinct[order], rank[place]


BLOB = "kind string, bucket int, part int, seq int, payload binary"
_BLOB_TYPES = [pa.string(), pa.int32(), pa.int32(), pa.int32(), pa.binary()]
_BLOB_NAMES = ["kind", "bucket", "part", "seq", "payload"]


def _blobs(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows)) or [()] * 5
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, _BLOB_TYPES)], _BLOB_NAMES)


# ---------------------------------------------------------------- first pass: sizes and hot words

def hot_words(texts: DataFrame) -> tuple[int, int, dict[int, int]]:
    """All tokens, training documents, and the exact training counts of words too frequent for one bucket.

    A sample of about one document in 50 only names the candidates (at most 4 for each bucket); counts are exact.
    """
    def sampled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = [word_hashes(t) for t in texts_of(batch.column("text"))]
            words, counts = np.unique(np.concatenate(own), return_counts=True) if own else (np.zeros(0, np.uint64),) * 2
            much = counts * 2000 >= counts.sum()        # rarer words are hot in no corpus of 8 billion tokens
            yield pa.RecordBatch.from_arrays(
                [pa.array([int(counts.sum())], pa.int64()), pa.array([words[much].view(np.int64)], pa.list_(pa.int64())),
                 pa.array([counts[much].astype(np.int64)], pa.list_(pa.int64()))], ["n", "words", "counts"])

    seen = texts.where(F.pmod(F.xxhash64("doc_id", "text"), F.lit(50)) == 0).select("text").mapInArrow(
        sampled, "n long, words array<long>, counts array<long>")
    seen = store(seen)
    total = seen.agg(F.sum("n").alias("n")).first()["n"] or 0
    share = HOT_PART / max(1, -(-total * 50 // BUCKET_TOKENS))
    often = seen.select(F.explode(F.arrays_zip("words", "counts")).alias("x")).groupBy("x.words").agg(
        F.sum("x.counts").alias("n")).where(F.col("n") > share * total)
    hot = np.array(sorted(r["words"] for r in often.collect()), np.int64)

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = docs = 0
        found = np.zeros(len(hot), np.int64)
        for batch in batches:
            for text, held in zip(texts_of(batch.column("text")), batch.column("held").to_pylist()):
                words = word_hashes(text).view(np.int64)
                n += len(words)
                if not held:
                    docs += 1
                    if len(hot):
                        at = np.minimum(np.searchsorted(hot, words), len(hot) - 1)
                        found += np.bincount(at[hot[at] == words], minlength=len(hot))
        yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64()), pa.array([docs], pa.int64()),
                                          pa.array([found], pa.list_(pa.int64()))], ["n", "docs", "found"])

    rows = texts.select("text", "held").mapInArrow(counted, "n long, docs long, found array<long>")
    rows = rows.select("n", "docs", F.posexplode_outer("found").alias("at", "c")).groupBy("at").agg(
        F.sum("n").alias("n"), F.sum("docs").alias("docs"), F.sum("c").alias("c")).collect()
    if not rows:
        return 0, 0, {}
    return rows[0]["n"], rows[0]["docs"], {int(np.uint64(hot[r["at"]].view(np.uint64))): r["c"]
                                           for r in rows if r["at"] is not None}


# ---------------------------------------------------------------- documents to buckets

def to_buckets(buckets: int, hot: dict[int, int]) -> Callable:
    hot_array = np.array(sorted(hot), np.uint64)

    def bucket_of(w: np.ndarray, h: np.ndarray) -> np.ndarray:
        key = _mixed(w)
        if len(hot_array):
            at = np.minimum(np.searchsorted(hot_array, w), len(hot_array) - 1)
            many = hot_array[at] == w
            key[many] = _pair(h[many], w[many])
        return (key % np.uint64(buckets)).astype(np.int64)

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = partition_id()
        for seq, batch in enumerate(batches):
            texts = texts_of(batch.column("text"))
            own = [word_hashes(t) for t in texts]
            sizes = np.array([len(x) for x in own], np.int64)
            if not len(sizes):
                continue
            ids = batch.column("doc_id")
            held = np.array(batch.column("held").to_pylist(), bool)
            rows = [("docs", (part * 31 + seq) % buckets, part, seq, _pack(
                ids=np.array(ids.fill_null(0).to_pylist(), np.int64).view(np.uint64),
                no_id=np.array(ids.is_null().to_pylist(), np.uint8), held=held.astype(np.uint8), sizes=sizes))]
            w = np.concatenate(own)
            h = np.concatenate([[START], w[:-1]])
            h[np.cumsum(sizes)[:-1]] = START
            doc = np.repeat(np.arange(len(sizes)), sizes)
            where = bucket_of(w, h)
            order = np.argsort(where.astype(np.uint16 if buckets < 1 << 16 else np.int64), kind="stable")
            ends = np.cumsum(np.bincount(where, minlength=buckets))
            flags = np.packbits(held)
            for b in np.flatnonzero(np.diff(ends, prepend=0)):
                at = order[ends[b - 1] if b else 0:ends[b]]
                words, place = _coded(w[at])
                by_word = np.argsort(place, kind="stable")
                at = at[by_word]
                before, h_at = _coded(h[at])
                rows.append(("tokens", int(b), part, seq, _pack(
                    words=words, counts=np.bincount(place), before=before, h=h_at, doc=doc[at], held=flags)))
            yield _blobs(rows)

    return send


# ---------------------------------------------------------------- counting in buckets

CLASSES = DISCOUNTED + 1        # counts 1..k, and one more for the Good-Turing formula


def count_buckets(hot: dict[int, int]) -> Callable:
    hot_array = np.array(sorted(hot), np.uint64)
    hot_counts = np.array([hot[int(x)] for x in hot_array], np.int64)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, blocks, bucket = [], [], -1
        for batch in batches:
            rows = batch.to_pydict()
            for kind, b, part, seq, payload in zip(*(rows[n] for n in _BLOB_NAMES)):
                if kind == "docs":
                    yield _blobs([(kind, b, part, seq, payload)])
                else:
                    own.append(_unpack(payload))
                    blocks.append((part, seq))
                    bucket = b
        if not own:
            return
        w = np.concatenate([np.repeat(x["words"], x["counts"]) for x in own])
        h = np.concatenate([x["before"][x["h"]] for x in own])
        widths = [int(x["doc"].max()) + 1 for x in own]
        starts = np.cumsum([0] + widths)
        doc = np.concatenate([x["doc"].astype(np.int64) + s for x, s in zip(own, starts)])
        held = np.concatenate([np.unpackbits(x["held"])[:n] for x, n in zip(own, widths)]).astype(bool)[doc]
        del own
        words, w_at = np.unique(w, return_inverse=True)
        c_word = np.bincount(w_at[~held], minlength=len(words))
        is_hot = np.zeros(len(words), bool)
        if len(hot_array):
            at = np.minimum(np.searchsorted(hot_array, words), len(hot_array) - 1)
            is_hot = hot_array[at] == words
            c_word[is_hot] = hot_counts[at[is_hot]]
        _, one, p_at = np.unique(_pair(h, w), return_index=True, return_inverse=True)
        c_pair = np.bincount(p_at[~held], minlength=len(one))

        # per document: logs, and how many tokens have a count of each discounted class
        c, cp = c_word[w_at], c_pair[p_at]
        seen = cp > 0
        logs = np.where(seen, np.log10(np.maximum(cp, 1)), np.log10(np.maximum(c, 1)))
        logs -= np.where((c > 0) & (w != END), np.log10(c + 1.0), 0.0)
        n = int(starts[-1])
        sums = {"base": np.bincount(doc, np.log10(c + 0.5), n), "logs": np.bincount(doc, logs, n),
                "known": np.bincount(doc[c > 0], minlength=n), "backed": np.bincount(doc[~seen & (c > 0)], minlength=n),
                "unknown": np.bincount(doc[~seen & (c == 0)], minlength=n)}
        for k in range(1, DISCOUNTED + 1):
            sums[f"p{k}"] = np.bincount(doc[cp == k], minlength=n)
            sums[f"w{k}"] = np.bincount(doc[~seen & (c == k)], minlength=n)
        there = np.bincount(doc, minlength=n) > 0
        missed = np.flatnonzero(~seen)
        for i, (part, seq) in enumerate(blocks):
            local = np.flatnonzero(there[starts[i]:starts[i + 1]])
            out = [("partials", bucket, part, seq, _pack(doc=local, **{k: v[starts[i] + local] for k, v in sums.items()}))]
            few = missed[(doc[missed] >= starts[i]) & (doc[missed] < starts[i + 1])]
            if len(few):
                before, h_at = _coded(h[few])
                out.append(("unseen", bucket, part, seq, _pack(before=before, h=h_at, doc=doc[few] - starts[i])))
            yield _blobs(out)

        kept = one[c_pair > 0]
        counts = c_pair[c_pair > 0]
        order = np.argsort(w_at[kept], kind="stable")
        kept, counts = kept[order], counts[order]
        used, pairs_of = np.unique(w_at[kept], return_counts=True)
        before, h_at = _coded(h[kept])
        yield _blobs([("pairs", bucket, -1, -1, _pack(words=words[used], word_counts=c_word[used], pairs=pairs_of,
                                                     before=before, h=h_at, counts=counts))])
        of_words, of_pairs = c_word[~is_hot & (c_word > 0)], counts
        yield _blobs([("totals", bucket, -1, -1, _pack(
            words=np.bincount(np.minimum(of_words, CLASSES + 1), minlength=CLASSES + 2),
            pairs=np.bincount(np.minimum(of_pairs, CLASSES + 1), minlength=CLASSES + 2),
            tokens=np.array([of_words.sum()])))])

    return count


def discounts(counts_of_counts: np.ndarray) -> np.ndarray:
    """d[c] for c = 0..k+: Good-Turing ratios renormalised as Katz has it; 1 beyond k.

    Where the corpus is too small for the formula (a ratio outside 0..1), fewer counts are discounted.
    """
    for k in range(DISCOUNTED, 0, -1):
        n = counts_of_counts[:k + 2].astype(float)
        if (n[1:] <= 0).any():
            continue
        rest = (k + 1) * n[k + 1] / n[1]
        c = np.arange(1, k + 1)
        d = ((c + 1) * n[c + 1] / (c * n[c]) - rest) / (1 - rest) if rest < 1 else np.full(k, np.nan)
        if ((d > 0) & (d <= 1)).all():
            return np.concatenate([[1.0], d, np.ones(DISCOUNTED - k)])
    return np.ones(DISCOUNTED + 1)


# ---------------------------------------------------------------- histories

def histories_of(buckets: int) -> Callable:
    """Bigram tables and unseen tokens, sent to the bucket of the history; a table is summed up per history first."""
    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = batch.to_pydict()
            for kind, _, part, seq, payload in zip(*(rows[n] for n in _BLOB_NAMES)):
                x = _unpack(payload)
                n = len(x["before"])
                to = (_mixed(x["before"]) % np.uint64(buckets)).astype(np.int64)
                if kind == "pairs":
                    c_word = np.repeat(x["word_counts"], x["pairs"])
                    stats = {"mass": np.bincount(x["h"], np.where(x["counts"] > DISCOUNTED, x["counts"], 0), n),
                             "words": np.bincount(x["h"], np.where(c_word > DISCOUNTED, c_word, 0), n)}
                    for k in range(1, DISCOUNTED + 1):
                        stats[f"p{k}"] = np.bincount(x["h"][x["counts"] == k], minlength=n)
                        stats[f"w{k}"] = np.bincount(x["h"][c_word == k], minlength=n)
                    stats = {k: v.astype(np.int64) for k, v in stats.items()}
                out = []
                for b in np.unique(to):
                    own = np.flatnonzero(to == b)
                    if kind == "pairs":
                        own = own[np.argsort(x["before"][own])]
                        blob = _pack(before=x["before"][own], **{k: v[own] for k, v in stats.items()})
                    else:
                        at = np.flatnonzero(to[x["h"]] == b)
                        local = np.zeros(n, np.int64)
                        local[own] = np.arange(len(own))
                        blob = _pack(before=x["before"][own], h=local[x["h"][at]], doc=x["doc"][at])
                    out.append((kind, int(b), part, seq, blob))
                yield _blobs(out)
    return send


def back_off(d: np.ndarray, d1: np.ndarray, tokens: int) -> Callable:
    """Per history log10 of alpha and of the count it divides by; summed up over the unseen tokens of documents."""
    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        stats, asked = [], []
        for batch in batches:
            rows = batch.to_pydict()
            for kind, _, part, seq, payload in zip(*(rows[n] for n in _BLOB_NAMES)):
                x = _unpack(payload)
                if kind == "pairs":
                    stats.append(x)
                else:
                    asked.append((part, seq, x))
        if not asked:
            return
        if stats:
            every, at = np.unique(np.concatenate([x["before"] for x in stats]), return_inverse=True)
            total = {k: np.bincount(at, np.concatenate([x[k] for x in stats]), len(every))
                     for k in stats[0] if k != "before"}
            count, kept, lower = total["mass"].copy(), total["mass"].copy(), total["words"].copy()
            for k in range(1, DISCOUNTED + 1):
                count += k * total[f"p{k}"]
                kept += d[k] * k * total[f"p{k}"]
                lower += d1[k] * k * total[f"w{k}"]
            term = np.log10(1 - kept / (count + 1)) - np.log10(1 - lower / (tokens + 1)) + np.log10(count + 1)
        else:
            every, term = np.zeros(0, np.uint64), np.zeros(0)
        out = []
        for part, seq, x in asked:
            value = np.zeros(len(x["before"]))
            if len(every):
                at = np.minimum(np.searchsorted(every, x["before"]), len(every) - 1)
                there = every[at] == x["before"]
                value[there] = term[at[there]]
            docs, place = np.unique(x["doc"], return_inverse=True)
            out.append(("backoff", 0, part, seq, _pack(doc=docs, logs=np.bincount(place, value[x["h"]], len(docs)))))
        yield _blobs(out)
    return weigh


# ---------------------------------------------------------------- scores

RESULT = "doc_id long, held_out boolean, n_tokens long, n_known long, base_score double, score double"


def add_up(d: np.ndarray, d1: np.ndarray, tokens: int, vocabulary: int, documents: int, unknown: float) -> Callable:
    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        blocks: dict[tuple[int, int], dict] = {}
        waiting: dict[tuple[int, int], list] = {}
        for batch in batches:
            rows = batch.to_pydict()
            for kind, _, part, seq, payload in zip(*(rows[n] for n in _BLOB_NAMES)):
                x = _unpack(payload)
                if kind == "docs":
                    blocks[part, seq] = x | {"base": np.zeros(len(x["ids"])), "score": np.zeros(len(x["ids"])),
                                             "known": np.zeros(len(x["ids"]))}
                    for at, values in waiting.pop((part, seq), []):
                        _add(blocks[part, seq], at, values)
                    continue
                values = {"score": x["logs"]}
                if kind == "partials":
                    score = x["logs"] - x["backed"] * np.log10(tokens + 1) + x["unknown"] * np.log10(unknown)
                    for k in range(1, DISCOUNTED + 1):
                        score = score + x[f"p{k}"] * np.log10(d[k]) + x[f"w{k}"] * np.log10(d1[k])
                    values = {"score": score, "base": x["base"], "known": x["known"]}
                if (part, seq) in blocks:
                    _add(blocks[part, seq], x["doc"], values)
                else:
                    waiting.setdefault((part, seq), []).append((x["doc"], values))
        for x in blocks.values():
            base = x["base"] - x["sizes"] * np.log10(tokens + 0.5 * (vocabulary + 1))
            score = x["score"] - (np.log10(documents + 1) if documents else 0.0)
            yield pa.RecordBatch.from_arrays(
                [pa.array(x["ids"].view(np.int64), mask=x["no_id"].astype(bool)), pa.array(x["held"].astype(bool)),
                 pa.array(x["sizes"].astype(np.int64)), pa.array(x["known"].astype(np.int64)), pa.array(base),
                 pa.array(score)], [f.split()[0] for f in RESULT.split(", ")])
    return finish


def _add(block: dict, at: np.ndarray, values: dict) -> None:
    for k, v in values.items():
        block[k][at] += v


class Trained:
    """The stored model: its folder and the few numbers that all scores share."""

    def __init__(self, spark: SparkSession, path: str, hot: dict[int, int], documents: int):
        self.spark, self.path, self.documents = spark, path, documents
        n_words, n_pairs, tokens = np.zeros(CLASSES + 2), np.zeros(CLASSES + 2), 0
        for r in self.kind("totals").collect():         # a row per bucket
            x = _unpack(bytes(r["payload"]))
            n_words, n_pairs, tokens = n_words + x["words"], n_pairs + x["pairs"], tokens + int(x["tokens"][0])
        for c in hot.values():
            n_words[min(c, CLASSES + 1)] += c > 0
            tokens += c
        self.tokens, self.vocabulary = tokens, int(n_words.sum())
        self.d, self.d1 = discounts(n_pairs), discounts(n_words)
        kept = sum(n_words[c] * c * (1 - self.d1[c]) for c in range(1, DISCOUNTED + 1))
        self.unknown = float(kept + 1) / (tokens + 1)

    def kind(self, *names: str) -> DataFrame:
        rows = self.spark.read.schema(BLOB).parquet(self.path)
        return rows.where(F.col("kind").isin(*names)).select(_BLOB_NAMES)

    def bigrams(self) -> DataFrame:
        """The stored table: hashes of history and word, the bigram's and the word's training counts."""
        def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for payload in batch.column("payload").to_pylist():
                    x = _unpack(payload)
                    w, cw = np.repeat(x["words"], x["pairs"]), np.repeat(x["word_counts"], x["pairs"])
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(v.view(np.int64) if v.dtype == np.uint64 else v.astype(np.int64))
                         for v in (x["before"][x["h"]], w, x["counts"], cw)], ["history", "word", "n", "word_n"])
        return self.kind("pairs").mapInArrow(rows, "history long, word long, n long, word_n long")


def score(docs: DataFrame, held_out: Column) -> tuple[DataFrame, Trained]:
    """Scores of all rows under the model learned from those not held out, and the stored model.

    Result: ``doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score``. A null or empty text is
    the end alone; a null id stays null; repeated rows count and are scored each; an empty table gives no
    rows. Other columns are not read.
    """
    spark = docs.sparkSession
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"),
                        held_out.alias("held"))
    total, documents, hot = hot_words(texts)
    buckets = max(1, -(-total // BUCKET_TOKENS))
    path = scratch_dir(spark)
    packed = texts.mapInArrow(to_buckets(buckets, hot), BLOB)
    counted = packed.repartitionById(buckets, "bucket").mapInArrow(count_buckets(hot), BLOB)
    counted.write.partitionBy("kind").option("compression", "none").parquet(path)
    model = Trained(spark, path, hot, documents)

    backed = model.kind("pairs", "unseen").mapInArrow(histories_of(buckets), BLOB).repartitionById(
        buckets, "bucket").mapInArrow(back_off(model.d, model.d1, model.tokens), BLOB)
    # all parts of a block of documents meet; a block is one batch of one scan task
    rows = model.kind("docs", "partials").unionByName(backed).repartition("part", "seq").mapInArrow(
        add_up(model.d, model.d1, model.tokens, model.vocabulary, documents, model.unknown), RESULT)
    return rows.withColumn("train_tokens", F.lit(model.tokens).cast("long")), model
