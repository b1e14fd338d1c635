"""Vector bin packing of examples under limits on tokens, segments and loss-bearing tokens.

A sequence is filled one at a time. Of the pieces that fit it in all three dimensions, the one whose vector (tokens, one
segment, loss-bearing tokens) has the largest dot product with what the sequence has left comes next, both scaled by the
limits. Where nothing fits whole, the head of a longer piece fills the gap and its tail stays for another sequence. A
sequence that ends short is divided at powers of two, which need no padding either.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common
from .word_ids import encoder

#: Pieces that one task packs.
TASK_PIECES = 100_000

#: What a group's packing gives; `begin` is the place in the piece that was cut, whose crc is then open.
PACKED = "row long, doc_id long, doc_tokens long, start long, begin long, length long, crc long, loss long, part int, bin long, offset long"
RESULT = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "loss_tokens"]


class Pool:
    """Pieces not yet placed, by class: all of one length and one number of loss-bearing tokens."""

    def __init__(self, limits: tuple[int, int, int]):
        self.size, self.segments, self.loss = limits
        self.items: list[tuple[int, int, int]] = []  # example, first token, length
        self.place: dict[tuple[int, int], int] = {}
        self.stacks: list[list[int]] = []
        self.length, self.bears, self.count = np.zeros(64, np.int64), np.zeros(64, np.int64), np.zeros(64, np.int64)
        self.left = 0

    def add(self, example: int, start: int, length: int, loss: int) -> None:
        at = self.place.setdefault((length, loss), len(self.stacks))
        if at == len(self.stacks):
            self.stacks.append([])
            if at == len(self.count):
                self.length, self.bears, self.count = (np.concatenate((x, np.zeros_like(x))) for x in (self.length, self.bears, self.count))
            self.length[at], self.bears[at] = length, loss
        self.stacks[at].append(len(self.items))
        self.items.append((example, start, length))
        self.count[at] += 1
        self.left += 1

    def take(self, at: int) -> tuple[int, int, int]:
        self.count[at] -= 1
        self.left -= 1
        return self.items[self.stacks[at].pop()]

    def best(self, tokens: int, segments: int, loss: int) -> int | None:
        """The class of the largest dot product among those that fit; the longer one of two alike."""
        n = len(self.stacks)
        length, bears = self.length[:n], self.bears[:n]
        fits = (self.count[:n] > 0) & (length <= tokens) & (bears <= loss)
        if not segments or not fits.any():
            return None
        # The segment's share of the product is the same for all.
        value = np.where(fits, length * (tokens / self.size**2) + bears * (loss / self.loss**2), -1.0)
        top = np.flatnonzero(value == value.max())
        return int(top[np.argmax(length[top])])

    def longer(self, tokens: int) -> list[int]:
        """Classes of more than so many tokens, the longest first."""
        n = len(self.stacks)
        found = np.flatnonzero((self.count[:n] > 0) & (self.length[:n] > tokens))
        return found[np.lexsort((self.bears[found], -self.length[found]))].tolist()


class Loss:
    """loss(example, a, b): loss-bearing tokens of an example's tokens a..b-1, by its runs' ends and marks."""

    def __init__(self, ends: list, bears: list):
        # None where all tokens bear loss: nothing to look up.
        self.runs = [None if len(e) == 1 and b[0] else self._sums(e, b) for e, b in zip(ends, bears, strict=True)]

    @staticmethod
    def _sums(ends: list, bears: list) -> tuple[np.ndarray, np.ndarray]:
        ends = np.concatenate(([0], ends))
        return ends, np.concatenate(([0], np.cumsum(np.diff(ends) * bears)))

    def __call__(self, example: int, a: int, b: int) -> int:
        run = self.runs[example]
        if run is None:
            return b - a
        x, y = np.interp((a, b), *run)
        return round(y - x)


def pack_vectors(lengths: list[int], loss: Loss, limits: tuple[int, int, int]) -> list[tuple[int, int, int, int, int]]:
    """(example, start, length, sequence, offset) of every piece; each example must keep the limits by itself."""
    size, max_segments, max_loss = limits
    pool = Pool(limits)
    for i, n in enumerate(lengths):
        pool.add(i, 0, n, loss(i, 0, n))
    out: list[tuple[int, int, int, int, int]] = []
    sequence = 0
    while pool.left:
        tokens, segments, left, own = size, max_segments, max_loss, []

        def put(example: int, start: int, length: int) -> None:
            nonlocal tokens, segments, left
            own.append((example, start, length))
            tokens, segments, left = tokens - length, segments - 1, left - loss(example, start, start + length)

        def cut() -> bool:
            """Fills what is left with the head of a longer piece, if one's head keeps the limit on loss."""
            for at in pool.longer(tokens):
                example, start, length = pool.items[pool.stacks[at][-1]]
                if loss(example, start, start + tokens) <= left:
                    pool.take(at)
                    rest = start + tokens, length - tokens
                    pool.add(example, *rest, loss(example, rest[0], start + length))
                    put(example, start, tokens)
                    return True
            return False

        while tokens and segments:
            at = pool.best(tokens, segments, left)
            if at is None or segments == 1 and pool.length[at] < tokens:  # the last segment has to fill the rest
                if cut():
                    break
            if at is None:
                break
            put(*pool.take(at))
        # Divided where a power of two of tokens ends; one part only if the sequence is full or a power of two long.
        room, total, offset = 0, size - tokens, 0
        for example, start, length in own:
            while length:
                if not room:
                    room, offset = (size, 0) if total == size else (1 << (total.bit_length() - 1), 0)
                    total -= room
                    sequence += 1
                part = min(length, room)
                out.append((example, start, part, sequence - 1, offset))
                start, length, room, offset = start + part, length - part, room - part, offset + part
    return out


def _runs(marks: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ends and marks of runs of segments with the same mark; empty segments make none."""
    marks, ends = marks[sizes > 0], np.cumsum(sizes[sizes > 0])
    last = np.append(marks[1:] != marks[:-1], True)
    return ends[last], marks[last]


def _cuts(ends: np.ndarray, marks: np.ndarray, size: int, max_loss: int) -> list[int]:
    """Where pieces end: as late as the limits allow."""
    total, loss, out, start = int(ends[-1]), Loss([ends], [marks]), [], 0
    while start < total:
        stop = min(start + size, total)
        if loss(0, start, stop) > max_loss:
            low, high = start + 1, stop  # the last stop that keeps the limit
            while low < high:
                middle = (low + high + 1) // 2
                low, high = (middle, high) if loss(0, start, middle) <= max_loss else (low, middle - 1)
            stop = low
        out.append(stop)
        start = stop
    return out


PIECE = "doc_id long, doc_tokens long, start long, length long, crc long, loss long, ids binary, ends array<int>, bears array<boolean>"
PIECE_TYPES = (*[pa.int64()] * 6, pa.binary(), pa.list_(pa.int32()), pa.list_(pa.bool_()))
PIECE_NAMES = [x.split()[0] for x in PIECE.split(", ")]


def _all_bear(doc_ids: pa.Array, ids: np.ndarray, sizes: np.ndarray, size: int) -> pa.RecordBatch:
    """The pieces of examples of so many ids, one after the other, all of which bear loss: cut at each `size` tokens."""
    count = -(-sizes // size)
    of = np.repeat(np.arange(len(sizes)), count)
    start = (np.arange(len(of)) - np.repeat(np.cumsum(count) - count, count)) * size
    length = np.minimum(size, sizes[of] - start)
    full = length == size
    stops = np.cumsum(length) * 4
    data = memoryview(ids.tobytes())
    crc = [zlib.crc32(data[a:b]) for a, b in zip((stops - 4 * length).tolist(), stops.tolist(), strict=True)]
    rest = ids[np.repeat(~full, length)].tobytes()
    places = np.concatenate(([0], np.cumsum(np.where(full, 0, 4 * length)))).astype(np.int32)
    valid = pa.py_buffer(np.packbits(~full, bitorder="little").tobytes())
    kept = pa.BinaryArray.from_buffers(pa.binary(), len(of), [valid, pa.py_buffer(places), pa.py_buffer(rest)])
    each, none = pa.array(np.arange(len(of) + 1), pa.int32()), pa.array(full)
    ends = pa.ListArray.from_arrays(each, pa.array(length, pa.int32()), mask=none)
    bears = pa.ListArray.from_arrays(each, pa.array(np.ones(len(of), bool)), mask=none)
    columns = [doc_ids.take(pa.array(of)), *(pa.array(x, pa.int64()) for x in (sizes[of], start, length, crc, length)), kept, ends, bears]
    return pa.RecordBatch.from_arrays(columns, names=PIECE_NAMES)


def encoded(examples: DataFrame, size: int, max_loss: int, vocabulary: str, end_id: int) -> DataFrame:
    """Of each example (id, texts, loss): its length and its pieces, with ids and runs of those that are not full."""

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = encoder(vocabulary)
        end = np.array([end_id], np.uint32)
        for whole in batches:
            for batch in common.chunks(iter([whole]), "texts"):
                texts, marks = batch.column("texts"), batch.column("loss")
                offsets, ids = coder.encode(texts.flatten())
                of = texts.offsets.to_numpy() - texts.offsets[0].as_py()
                flags = marks.flatten().to_numpy(zero_copy_only=False).astype(bool)
                if flags.all() and max_loss >= size:
                    stops = offsets[of]
                    yield _all_bear(batch.column("id"), np.insert(ids, stops[1:], end_id).astype("<u4"), np.diff(stops) + 1, size)
                    continue
                rows: list[tuple] = []
                for i, doc_id in enumerate(batch.column("id").to_pylist()):
                    a, b = of[i], of[i + 1]
                    own = np.concatenate((ids[offsets[a] : offsets[b]], end)).astype("<u4")
                    sizes = np.append(np.diff(offsets[a : b + 1]), 1)
                    ends, bears = _runs(np.append(flags[a:b], flags[b - 1] if b > a else True), sizes)
                    runs, start = Loss([ends], [bears]), 0
                    for stop in _cuts(ends, bears, size, max_loss):
                        part = own[start:stop].tobytes()
                        full = stop - start == size
                        at = np.searchsorted(ends, start, side="right"), np.searchsorted(ends, stop)
                        own_ends = np.minimum(ends[at[0] : at[1] + 1], stop) - start
                        rows.append((doc_id, len(own), start, stop - start, zlib.crc32(part), runs(0, start, stop), *((None, None, None) if full else (part, own_ends.tolist(), bears[at[0] : at[1] + 1].tolist()))))
                        start = stop
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), PIECE_TYPES, strict=True)], names=PIECE_NAMES)

    return examples.select("id", "texts", "loss").mapInArrow(encode, PIECE).withColumn("row", F.monotonically_increasing_id())


def pack(
    docs: DataFrame, texts: Column | None = None, loss: Column | None = None, size: int = 4096, max_segments: int = 64, max_loss: int | None = None, vocabulary: str = "word_bpe_49k.json", end_id: int = 2, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """Packs every example's ids, end_id appended, into sequences of at most `size` tokens, `max_segments` pieces and
    `max_loss` loss-bearing tokens: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, loss_tokens of each piece.

    An example is a document, all of whose tokens bear loss, or what `texts` gives, an array of texts encoded one by
    one, with `loss`, an array of as many booleans (null: false). Pieces of `size` tokens are sequences by themselves;
    the rest are dealt by hash to groups of about TASK_PIECES and each is packed by itself, without padding. Null texts
    count as empty; an empty example is end_id alone; a null identifier stays null; repeated rows are packed each for
    itself; pieces alike are taken in the order of the groups' rows; an empty table gives no row."""
    max_loss = max_loss or size
    if min(size, max_segments, max_loss) < 1:
        raise ValueError("limits must be 1 at least")
    texts = F.array(F.col(text_col)) if texts is None else F.coalesce(texts, F.array())
    loss = F.transform(texts, lambda _: F.lit(True)) if loss is None else F.coalesce(loss, F.array())
    examples = docs.select(F.col(id_col).cast("long").alias("id"), F.transform(texts, lambda t: F.coalesce(t, F.lit(""))).alias("texts"), F.transform(texts, lambda _, i: F.coalesce(F.get(loss, i), F.lit(False))).alias("loss"))
    coded = common.materialise(encoded(examples, size, max_loss, vocabulary, end_id), "vector-pieces")
    rest = coded.where(F.col("length") < size)
    parts = max(1, -(-rest.count() // TASK_PIECES))
    limits = size, max_segments, max_loss

    def fill(key: tuple, rows: pa.Table) -> pa.Table:
        rows = rows.sort_by("row").combine_chunks()
        of = Loss(*(rows.column(c).to_pylist() for c in ("ends", "bears")))
        made = np.array(pack_vectors(rows.column("length").to_pylist(), of, limits), np.int64).reshape(-1, 5)
        at, begin, length = made[:, 0], made[:, 1], made[:, 2]
        taken = rows.take(pa.array(at))
        cut = length < taken.column("length").to_numpy()
        loss = [of(*x) for x in zip(at.tolist(), begin.tolist(), (begin + length).tolist(), strict=True)]
        crc = pa.array(taken.column("crc").to_numpy(), pa.int64(), mask=cut)
        start = taken.column("start").to_numpy() + begin
        columns = [*(taken.column(c) for c in ("row", "doc_id", "doc_tokens")), start, begin, length, crc, loss, np.full(len(at), key[0].as_py(), np.int32), made[:, 3], made[:, 4]]
        return pa.table([pa.array(c) if not isinstance(c, pa.ChunkedArray | pa.Array) else c for c in columns], names=[x.split()[0] for x in PACKED.split(", ")])

    dealt = rest.drop("ids").withColumn("part", F.pmod(F.xxhash64("row"), F.lit(parts)).cast("int"))
    placed = common.materialise(dealt.groupBy("part").applyInArrow(fill, PACKED), "vector-packed")

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            begin, length = (batch.column(c).to_numpy() for c in ("begin", "length"))
            crc = [zlib.crc32(ids[4 * a : 4 * (a + n)]) for ids, a, n in zip(batch.column("ids").to_pylist(), begin, length, strict=True)]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in RESULT[:3]), pa.array(crc, pa.int64()), *(batch.column(c) for c in RESULT[4:])], names=RESULT)

    number = ((F.col("part").cast("long") * F.lit(1 << 36) + F.col("bin")) * 2).alias("sequence_id")
    columns = ["doc_id", "start", "length", F.col("crc").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset", F.col("loss").alias("loss_tokens")]
    packed = placed.select("*", number)
    cut = packed.where("crc IS NULL").join(coded.select("row", "ids"), "row").select(*columns, "begin", "ids")
    cut = cut.mapInArrow(digest, "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, loss_tokens long")
    full = coded.where(F.col("length") == size).select("*", (F.col("row") * 2 + 1).alias("sequence_id"), F.lit(0).cast("long").alias("offset")).select(*columns)
    return full.unionByName(packed.where("crc IS NOT NULL").select(*columns)).unionByName(cut)
