"""Best-fit packing: best-fit decreasing, with a segment tree over the remaining capacities of open sequences."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common
from .word_ids import encoder

#: Pieces that one task packs, and the fill below which a sequence of the first round is packed anew.
TASK_PIECES, REPACK_BELOW = 100_000, 0.97


class BestFit:
    """Open bins by remaining capacity 0..size; take(n) finds the tightest that holds n in O(log size).

    A perfect binary tree over capacities counts open bins; each capacity keeps its bins last in, first out."""

    def __init__(self, size: int):
        self.size, self.leaves = size, 1 << size.bit_length()
        self.count = [0] * (2 * self.leaves)
        self.bins: list[list[int]] = [[] for _ in range(size + 1)]
        self.opened = 0

    def _add(self, capacity: int, by: int) -> None:
        node = self.leaves + capacity
        while node:
            self.count[node] += by
            node >>= 1

    def _tightest(self, need: int) -> int | None:
        """The least capacity >= need with an open bin: up from the leaf to the first full right sibling, then down."""
        node = self.leaves + need
        if self.count[node]:
            return need
        while node > 1:
            if not node & 1 and self.count[node + 1]:
                node += 1
                while node < self.leaves:
                    node = 2 * node if self.count[2 * node] else 2 * node + 1
                return node - self.leaves
            node >>= 1
        return None

    def put(self, need: int) -> tuple[int, int]:
        """(bin, offset in it) for a piece of 1 <= need <= size tokens."""
        capacity = self._tightest(need)
        if capacity is None:
            bin_id, capacity = self.opened, self.size
            self.opened += 1
        else:
            bin_id = self.bins[capacity].pop()
            self._add(capacity, -1)
        left = capacity - need
        if left:
            self.bins[left].append(bin_id)
            self._add(left, 1)
        return bin_id, self.size - capacity


def pack_lengths(lengths: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Best-fit decreasing of pieces, ties in the given order: each piece's bin and offset."""
    bins, offsets, fit = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64), BestFit(size)
    for i in np.argsort(-lengths, kind="stable"):
        bins[i], offsets[i] = fit.put(int(lengths[i]))
    return bins, offsets


def pieces(docs: DataFrame, size: int = 2048, vocabulary: str = "word_bpe_49k.json", end_id: int = 0, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """Cuts each document's ids, end_id appended, into pieces of at most size: doc_id, row, piece, start, length, ids_crc32."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = encoder(vocabulary)
        for batch in common.chunks(batches, "text"):
            offsets, ids = coder.encode(batch.column("text"))
            out: list[tuple] = []
            for i, doc_id in enumerate(batch.column("doc_id").to_pylist()):
                own = np.append(ids[offsets[i] : offsets[i + 1]], np.uint32(end_id)).astype("<u4").tobytes()
                for p, at in enumerate(range(0, len(own), 4 * size)):
                    part = own[at : at + 4 * size]
                    out.append((doc_id, p, at // 4, len(part) // 4, zlib.crc32(part), part if with_ids else None))
            cols = list(zip(*out, strict=True))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary()), strict=True)], names=["doc_id", "piece", "start", "length", "ids_crc32", "ids"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    return rows.mapInArrow(cut, "doc_id long, piece int, start long, length long, ids_crc32 long, ids binary")


def _pack_round(rows: DataFrame, parts: int, size: int) -> DataFrame:
    """Each of `parts` groups, dealt by hash, is packed by itself: part, bin, offset and the bin's fill join the columns."""
    keys = ["doc_id", "piece", "start", "length", "ids_crc32"]

    def pack(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["doc_id", "piece", "ids_crc32"], kind="stable", na_position="first")
        bins, offsets = pack_lengths(pdf["length"].to_numpy(), size)
        fill = np.bincount(bins, weights=pdf["length"].to_numpy()).astype(np.int64)[bins]
        return pd.DataFrame({**{k: pdf[k] for k in keys}, "part": key[0], "bin": bins, "offset": offsets, "fill": fill})

    dealt = rows.select(*keys, (F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(parts))).cast("int").alias("part"))
    return dealt.groupBy("part").applyInPandas(pack, "doc_id long, piece int, start long, length long, ids_crc32 long, part int, bin long, offset long, fill long")


def pack(docs: DataFrame, size: int = 2048, vocabulary: str = "word_bpe_49k.json", end_id: int = 0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Packs every document's ids into sequences of at most size tokens: a row for each piece, with sequence_id and offset.

    Full pieces are sequences by themselves. The rest are dealt by hash to groups of about TASK_PIECES and each
    group is packed best-fit decreasing; pieces in sequences filled below REPACK_BELOW are then dealt to fewer
    groups and packed again, so that what many groups leave half open meets. Null and empty texts are end_id
    alone; a null identifier stays null; repeated rows are packed each for itself; an empty table gives no row."""
    spark = docs.sparkSession
    cut = common.materialise(pieces(docs, size, vocabulary, end_id, id_col, text_col).drop("ids"), "pieces")
    n = cut.where(F.col("length") < size).count()
    parts = max(1, -(-n // TASK_PIECES))
    first = common.materialise(_pack_round(cut.where(F.col("length") < size), parts, size), "packed")
    poor = first.where(F.col("fill") < REPACK_BELOW * size)
    again = max(1, -(-poor.count() // TASK_PIECES))
    second = _pack_round(poor, again, size)
    number = lambda kind, part, of: ((F.col(part).cast("long") * F.lit(1 << 36) + F.col(of)) * 3 + kind).alias("sequence_id")
    keys = ["doc_id", "piece", "start", "length", "ids_crc32"]
    whole = cut.where(F.col("length") == size).select(*keys, (F.monotonically_increasing_id() * 3).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    kept = first.where(F.col("fill") >= REPACK_BELOW * size).select(*keys, number(1, "part", "bin"), "offset")
    redone = second.select(*keys, number(2, "part", "bin"), "offset")
    return whole.unionByName(kept).unionByName(redone)
