"""Token ids as directly addressable codes: any token is read without decoding a block.

An id is cut into chunks of ``CHUNK_BITS`` bits, lowest first. Level k holds the k-th chunks of all ids that
have one, and a bitmap with a one where the id goes on in the next level. The place of a chunk in the next
level is the number of ones before it, which the rank directory gives: ones up to every ``RANK_BITS``-th bit.

The file format is a Parquet table without compression, one row per segment of consecutive documents. A
segment's row holds its documents' ids and token counts, and per level the chunks, the bitmap and the rank
directory. ``directory`` is a second small table with the tokens before each written part.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from diffgauge.llm.common import part_bases, partition_id, text_slices, texts_of
from diffgauge.llm.units import encoder

CHUNK_BITS = 8
RANK_BITS = 512
SEGMENT_IDS = 1 << 18       # a segment closes at the first document that reaches this
LOOKUP_SLICE = 1 << 18

SEGMENT = ("part int, seg int, first long, n_ids long, doc_ids array<long>, counts array<long>, "
           "chunks array<binary>, bitmaps array<binary>, ranks array<binary>")
_BINARIES = pa.list_(pa.binary())
_SEGMENT_TYPES = [pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()),
                  _BINARIES, _BINARIES, _BINARIES]
_POPCOUNT = np.array([bin(b).count("1") for b in range(256)], np.uint8)


class Dac:
    """The codes of one segment."""

    def __init__(self, chunks: list[bytes], bitmaps: list[bytes], ranks: list[bytes]):
        self.chunks = [np.frombuffer(c, np.uint8) for c in chunks]
        self.bitmaps = [np.frombuffer(b, np.uint8) for b in bitmaps]
        self.ranks = [np.frombuffer(r, "<u4") for r in ranks]

    @staticmethod
    def of(ids: np.ndarray) -> Dac:
        chunks, bitmaps, ranks = [], [], []
        rest = ids
        while True:
            chunks.append(rest.astype(np.uint8).tobytes())
            rest = rest >> CHUNK_BITS
            more = rest > 0
            bits = np.packbits(more, bitorder="little")
            ones = _POPCOUNT[bits]
            steps = np.add.reduceat(ones, np.arange(0, len(ones), RANK_BITS // 8), dtype=np.int64) if len(ones) else []
            bitmaps.append(bits.tobytes())
            ranks.append(np.concatenate([[0], np.cumsum(steps)]).astype("<u4").tobytes())
            rest = rest[more]
            if not len(rest):
                return Dac(chunks, bitmaps, ranks)

    def rank(self, level: int, at: int) -> int:
        """Ones before bit ``at``."""
        block, byte = at // RANK_BITS, at // 8
        found = int(self.ranks[level][block]) + int(_POPCOUNT[self.bitmaps[level][block * RANK_BITS // 8:byte]].sum())
        if at % 8:
            found += int(_POPCOUNT[self.bitmaps[level][byte] & ((1 << at % 8) - 1)])
        return found

    def get(self, at: int) -> int:
        """The id at one place: a chunk and a rank per level."""
        value = shift = level = 0
        while True:
            value |= int(self.chunks[level][at]) << shift
            if not self.bitmaps[level][at // 8] >> (at % 8) & 1:
                return value
            at, level, shift = self.rank(level, at), level + 1, shift + CHUNK_BITS

    def slice(self, start: int, end: int) -> np.ndarray:
        """Ids of a range: on every level a range again, between the ranks of its ends."""
        ids = np.zeros(end - start, "<u4")
        where, shift = slice(None), 0
        for level, chunk in enumerate(self.chunks):
            if start == end:
                break
            ids[where] |= chunk[start:end].astype("<u4") << shift
            bits = np.unpackbits(self.bitmaps[level][start // 8:(end + 7) // 8], bitorder="little")
            more = np.flatnonzero(bits[start % 8:start % 8 + end - start])
            where = more if level == 0 else where[more]
            start, end, shift = self.rank(level, start), self.rank(level, end), shift + CHUNK_BITS
        return ids


def write_store(docs: DataFrame, path: str, tokenizer: str, units: Callable[[str, str], str], end_id: int) -> None:
    """Encode every text, append ``end_id`` and write the store in ascending ``doc_id`` order.

    A null text is empty and gives the end id alone; a null ``doc_id`` comes first. Rows of one id follow
    each other by the hash of their text, which also spreads an id that repeats very often over parts.
    Other columns are not read. An empty table gives an empty store.
    """
    def segments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, seg, first = partition_id(), 0, 0
        ids: list[bytes] = []
        doc_ids: list[int | None] = []
        end = np.asarray([end_id], "<u4").tobytes()
        tool = encoder(tokenizer, units)

        def row() -> pa.RecordBatch:
            counts = [len(b) // 4 for b in ids]
            code = Dac.of(np.frombuffer(b"".join(ids), "<u4"))
            cells = [part, seg, first, sum(counts), list(doc_ids), counts, [c.tobytes() for c in code.chunks],
                     [b.tobytes() for b in code.bitmaps], [r.tobytes() for r in code.ranks]]
            return pa.RecordBatch.from_arrays([pa.array([c], t) for c, t in zip(cells, _SEGMENT_TYPES)],
                                              [f.split()[0] for f in SEGMENT.split(", ")])
        held = 0
        for batch in text_slices(batches):
            for doc_id, code in zip(batch.column("doc_id").to_pylist(), tool.encode(texts_of(batch.column("text")))):
                code += end
                ids.append(code)
                doc_ids.append(doc_id)
                held += len(code) // 4
                if held >= SEGMENT_IDS:
                    yield row()
                    seg, first, held = seg + 1, first + held, 0
                    ids.clear()
                    doc_ids.clear()
        if ids:
            yield row()

    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"),
                       F.xxhash64("text").alias("spread"))
    ordered = rows.repartitionByRange("doc_id", "spread").sortWithinPartitions("doc_id", "spread", "text")
    ordered.select("doc_id", "text").mapInArrow(segments, SEGMENT).write.option(
        "compression", "none").parquet(f"{path}/segments")
    parts = spark.read.schema(SEGMENT).parquet(f"{path}/segments")
    part_bases(parts, "part", "n_ids").coalesce(1).write.parquet(f"{path}/directory")


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """Every document with the tokens before it, its number of ids and the ids (little-endian, 32 bits)."""
    def decoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                code, at = Dac(row["chunks"], row["bitmaps"], row["ranks"]), 0
                starts, ids = [], []
                for n in row["counts"]:
                    starts.append(row["first"] + at)
                    ids.append(code.slice(at, at + n).tobytes())
                    at += n
                yield pa.RecordBatch.from_arrays(
                    [pa.array([row["part"]] * len(ids), pa.int32()), pa.array(row["doc_ids"], pa.int64()),
                     pa.array(starts, pa.int64()), pa.array(row["counts"], pa.int64()), pa.array(ids, pa.binary())],
                    ["part", "doc_id", "first", "n_tokens", "ids"])

    found = spark.read.schema(SEGMENT).parquet(f"{path}/segments").mapInArrow(
        decoded, "part int, doc_id long, first long, n_tokens long, ids binary")
    return found.join(_bases(spark, path), "part").select(
        "doc_id", (F.col("base") + F.col("first")).alias("start"), "n_tokens", "ids")


def read_tokens(positions: DataFrame, path: str) -> DataFrame:
    """Random access: the id at each global position (column ``position``); places outside give no row.

    Segments are found by an equi join on fixed slices of the position axis, and a segment's codes meet
    only the distinct places asked from it.
    """
    spark = positions.sparkSession
    segments = spark.read.schema(SEGMENT).parquet(f"{path}/segments")
    places = segments.select("part", "seg", "first", "n_ids").join(_bases(spark, path), "part").withColumn(
        "start", F.col("base") + F.col("first"))
    places = places.withColumn("slice", F.explode(F.sequence(
        F.expr(f"start div {LOOKUP_SLICE}"), F.expr(f"(start + n_ids - 1) div {LOOKUP_SLICE}"))))
    asked = positions.select(F.col("position").cast("long").alias("position")).where("position >= 0").distinct()
    asked = asked.withColumn("slice", F.expr(f"position div {LOOKUP_SLICE}")).join(places, "slice").where(
        "position >= start and position < start + n_ids")
    asked = asked.groupBy("part", "seg").agg(F.first("start").alias("start"),
                                             F.collect_list("position").alias("positions"))

    def picked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                code = Dac(row["chunks"], row["bitmaps"], row["ranks"])
                found = [code.get(p - row["start"]) for p in row["positions"]]
                yield pa.RecordBatch.from_arrays([pa.array(row["positions"], pa.int64()),
                                                  pa.array(found, pa.int64())], ["position", "token_id"])

    return segments.select("part", "seg", "chunks", "bitmaps", "ranks").join(asked, ["part", "seg"]).mapInArrow(
        picked, "position long, token_id long")


def _bases(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("part int, base long, total long").parquet(f"{path}/directory").select("part", "base")
