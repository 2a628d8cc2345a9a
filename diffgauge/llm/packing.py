"""Concatenate and cut: documents in a row, cut into windows of a fixed number of tokens.

Pass one encodes the documents where they lie and stores, with each, the tokens before it in its part. The
part totals, summed up, give every document its place in the whole row. Pass two cuts each document at the
window bounds. No text and no ids are shuffled; only the pieces that share a window meet when windows are
assembled (``sequences``), and a window holds at most ``length`` ids.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from diffgauge.llm.common import part_bases, partition_id, slices, store, text_slices, texts_of
from diffgauge.llm.units import encoder

PIECE = ("doc_id long, start long, length long, doc_tokens long, sequence_id long, offset long, "
         "boundary boolean, ids binary")
_PIECE_TYPES = [pa.int64()] * 6 + [pa.bool_(), pa.binary()]


def encoded(docs: DataFrame, tokenizer: str, units: Callable[[str, str], str], end_id: int) -> DataFrame:
    """Pass one: ids of each document and the tokens before it in its part, as a stored table."""
    def tokens(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, before, tool = partition_id(), 0, encoder(tokenizer, units)
        end = np.asarray([end_id], "<u4").tobytes()
        for batch in text_slices(batches):
            codes = [c + end for c in tool.encode(texts_of(batch.column("text")))]
            counts = np.array([len(c) // 4 for c in codes], np.int64)
            first = before + np.cumsum(counts) - counts
            before += int(counts.sum())
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array([part] * len(codes), pa.int32()), pa.array(first), pa.array(counts),
                 pa.array(codes, pa.binary())], ["doc_id", "part", "first", "n", "ids"])

    return store(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
                 .mapInArrow(tokens, "doc_id long, part int, first long, n long, ids binary"))


def pack(docs: DataFrame, tokenizer: str, units: Callable[[str, str], str], end_id: int,
         length: int = 2048) -> DataFrame:
    """Pieces of documents in windows of ``length`` tokens; every id lies in exactly one piece.

    Only the very last window can be shorter. ``boundary`` marks a piece that shares its window with others.
    A null or empty text is its end id alone; repeated rows and ids are packed once per row; a null
    ``doc_id`` stays null. An empty table gives no pieces. Other columns are not read.
    """
    coded = encoded(docs, tokenizer, units, end_id)
    # one small row per part, that is per scan task: bounded by the number of splits, and the ids stay in place
    bases = F.broadcast(part_bases(coded, "part", "n").select("part", "base"))
    placed = coded.join(bases, "part").select("doc_id", (F.col("base") + F.col("first")).alias("place"), "n", "ids")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            rows = []
            for doc_id, place, n, ids in zip(*(batch.column(k).to_pylist() for k in ("doc_id", "place", "n", "ids"))):
                at = 0
                while at < n:
                    window, offset = divmod(place + at, length)
                    k = min(length - offset, n - at)
                    rows.append((doc_id, at, k, n, window, offset, k < length, ids[4 * at:4 * (at + k)]))
                    at += k
            columns = list(zip(*rows)) or [()] * 8
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, _PIECE_TYPES)],
                                             [f.split()[0] for f in PIECE.split(", ")])

    return placed.mapInArrow(cut, PIECE)


def sequences(pieces: DataFrame, length: int = 2048, pad_id: int = 0) -> DataFrame:
    """The windows themselves: ``sequence_id`` and its ids, padded to ``length``.

    A document's whole windows pass through; only boundary pieces are shuffled to their window.
    """
    whole = pieces.where(~F.col("boundary")).select("sequence_id", "ids")
    joined = pieces.where("boundary").groupBy("sequence_id").agg(
        F.array_sort(F.collect_list(F.struct("offset", "ids"))).alias("p")).select(
        "sequence_id", F.expr("aggregate(p, cast('' as binary), (a, x) -> concat(a, x.ids))").alias("ids"))
    pad = F.lit(np.asarray([pad_id] * length, "<u4").tobytes())
    return whole.unionByName(joined).select("sequence_id", F.substring(F.concat("ids", pad), 1, 4 * length).alias("ids"))
