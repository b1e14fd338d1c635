"""Katz backoff scores: Good-Turing discounted n-gram counts with exactly normalised backoff weights.

P(w | h) = d(c) c(h, w) / c(h) for a seen n-gram, else alpha(h) P(w | h without its oldest word), down to single
words: P(w) = d(c) c(w) / N for a known word, and what is left for the one unknown word. Counts come from training
documents, all documents are scored. A text starts after as many START words as the order needs.

Words are 64-bit hashes. Texts are packed to blocks of tokens, each with its distinct words; blocks learn their words'
numbers (their ranks) and counts from ranges of the hash space. Each block then sends its distinct n-grams, once each,
to buckets of a table that is partitioned by the word before the last one: all contexts that an n-gram backs off to end
with that word, so that a bucket evaluates them all recursively by itself; it asks the ranges for the counts of single
words. A frequent word has buckets of its own, split by the word after it; they add up what they know of a context in
common. Each bucket answers with the probabilities of the n-grams that a block asked for, and the block adds them up by
document.

So an n-gram that many documents share travels once for each block, and no document's tokens meet in one place but
its block. There are as many messages as a shuffle between blocks and buckets has segments, and never more than n-grams.
"""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.fs as pafs
import pyarrow.parquet as pq
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common

#: Tokens of a block, tokens for one bucket (it holds fewer n-grams), words or contexts of one range.
BLOCK_TOKENS, BUCKET_TOKENS, RANGE_KEYS = 2_000_000, 1_500_000, 2_000_000
K = 5
U = np.uint64
START, END = U(0x0123456789ABCDEF), U(0xFEDCBA9876543210)


def dump(*arrays: np.ndarray) -> bytes:
    """Arrays as compressed byte planes."""
    codec = pa.Codec("zstd", compression_level=3)
    out = []
    for a in arrays:
        raw = np.ascontiguousarray(a).view(np.uint8).reshape(len(a), a.itemsize).T.tobytes()
        out.append((a.dtype.str, len(a), codec.compress(raw, asbytes=True) if raw else b""))
    return pickle.dumps(out)


def load(data: bytes) -> list[np.ndarray]:
    codec, out = pa.Codec("zstd"), []
    for kind, n, packed in pickle.loads(data):
        kind = np.dtype(kind)
        raw = codec.decompress(packed, n * kind.itemsize, asbytes=True) if n else b""
        out.append(np.frombuffer(raw, np.uint8).reshape(kind.itemsize, n).T.copy().view(kind).reshape(n))
    return out


def dump_sorted(columns: list[np.ndarray], *others: np.ndarray) -> bytes:
    """Rows sorted by non-negative columns, as differences to the row before where all earlier columns agree with it."""
    out, same = [], np.ones(len(columns[0]), bool)
    for c in columns:
        step = np.diff(c, prepend=c.dtype.type(0))
        out.append(np.where(same, step, c).astype(np.uint32))
        same &= step == 0
    return dump(*out, *others)


def load_sorted(data: bytes, n: int) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """The n sorted columns, and the others."""
    loaded = load(data)
    out, same = [], np.ones(len(loaded[0]), bool)
    for c in loaded[:n]:
        total = np.cumsum(c.astype(np.int64))
        start = np.maximum.accumulate(np.where(same, 0, np.arange(len(c))))
        value = total - np.where(start > 0, total[start] - c[start], 0)
        out.append(value)
        same &= np.diff(value, prepend=0) == 0
    return out, loaded[n:]


def hash_words(words: pa.Array) -> np.ndarray:
    return np.fromiter((xxhash.xxh3_64_intdigest(w) for w in words.cast(pa.binary()).to_pylist()), U, len(words))


def discounts(n: np.ndarray) -> np.ndarray:
    """d[0..K-1] for counts 1..K from the numbers n[r-1] of types seen r times, r to K + 1: Katz's from Good-Turing
    where they lie in (0, 1), else one absolute discount for all."""
    n = n.astype(float)
    if (n[: K + 1] > 0).all():
        top = (K + 1) * n[K] / n[0]
        r = np.arange(1, K + 1)
        d = ((r + 1) * n[1 : K + 1] / n[:K] / r - top) / (1 - top) if top != 1 else np.full(K, -1.0)
        if ((d > 0) & (d < 1)).all():
            return d
    step = min(0.9, max(0.1, n[0] / (n[0] + 2 * n[1]))) if n[0] else 0.5
    return (np.arange(1, K + 1) - step) / np.arange(1, K + 1)


def discounted(c: np.ndarray, d: np.ndarray) -> np.ndarray:
    """d(c) c for counts c."""
    return np.where((c > 0) & (c <= K), d[np.clip(c, 1, K) - 1], 1.0) * c


@dataclass
class Statistics:
    """What all blocks and buckets share."""

    tokens: int = 0  # N, ends included
    words: int = 0  # V
    word_d: np.ndarray = field(default_factory=lambda: np.ones(K))
    left: float = 1.0  # probability of the unknown word
    plus: int = 0  # 1 where no word is discounted
    gram_d: dict[int, np.ndarray] = field(default_factory=dict)  # discounts by order

    @classmethod
    def of(cls, tokens: int, words: int, word_n: np.ndarray) -> Statistics:
        out = cls(tokens, words, discounts(word_n))
        small = float((word_n[:K] * np.arange(1, K + 1) * (1 - out.word_d)).sum())
        if small > 0:
            out.left = small / tokens
        elif tokens:
            out.plus, out.left = 1, 1 / (tokens + 1)
        return out

    def unigram(self, c: np.ndarray) -> np.ndarray:
        """P(w) by count; a count of 0 is the unknown word."""
        return np.where(c > 0, (c if self.plus else discounted(c, self.word_d)) / max(self.tokens + self.plus, 1), self.left)


def _code(columns: list[np.ndarray], sizes: list[int]) -> np.ndarray:
    """One integer for each row of columns with values below sizes, in the order of the rows."""
    out, n = columns[0].astype(np.int64), sizes[0]
    for c, size in zip(columns[1:], sizes[1:], strict=True):
        if n * size >= 1 << 63:
            values, out = np.unique(out, return_inverse=True)
            n = len(values)
        out = out * size + c
        n *= size
    return out


def _range_of(keys: np.ndarray, ranges: int) -> np.ndarray:
    return ((keys >> U(32)) * U(ranges) >> U(32)).astype(np.int64)


def _slices(keys: np.ndarray, ranges: int) -> Iterator[tuple[int, slice]]:
    """(range, its slice) of sorted keys."""
    ends = np.searchsorted(_range_of(keys, ranges), np.arange(ranges + 1))
    for r, (a, b) in enumerate(zip(ends[:-1], ends[1:], strict=True)):
        if b > a:
            yield r, slice(int(a), int(b))


def _mixed(numbers: np.ndarray) -> np.ndarray:
    x = numbers.astype(U)
    with np.errstate(over="ignore"):
        x = (x ^ (x >> U(15))) * U(0x9E3779B97F4A7C15)
        return (x ^ (x >> U(32))) >> U(8)


def _dealer(buckets: int, hot: dict[int, tuple[int, int]]) -> Callable[[np.ndarray, np.ndarray], np.ndarray]:
    """Bucket of (number of the word before, number of the word): by the word before, or a frequent one's own buckets by
    the word."""
    keys = np.array(sorted(hot), np.int64)
    first = np.array([hot[int(k)][0] for k in keys], np.int64)
    parts = np.array([hot[int(k)][1] for k in keys], np.int64)

    def deal(before: np.ndarray, word: np.ndarray) -> np.ndarray:
        out = (_mixed(before) % U(buckets)).astype(np.int64)
        if len(keys):
            at = np.minimum(np.searchsorted(keys, before), len(keys) - 1)
            own = keys[at] == before
            out[own] = first[at[own]] + (_mixed(word[own]) % parts[at[own]].astype(U)).astype(np.int64)
        return out

    return deal


BLOCK_TABLE = "part long, words binary, tokens binary, docs binary, n_words long, n_tokens long, n_docs long"


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Documents to blocks: distinct words (sorted hashes; counts in training documents and in all), each token's word
    with an end for every document, and the documents' identifiers (and whether they have one), training flags, lengths."""
    at, part = 0, TaskContext.get().partitionId()

    def flush(held: list[tuple]) -> Iterator[pa.RecordBatch]:
        nonlocal at
        words = np.unique(np.concatenate([x[0] for x in held]))
        tokens = np.concatenate([np.searchsorted(words, x[0]).astype(np.uint32)[x[1]] for x in held])
        ids, has_id, train, sizes = (np.concatenate([x[i] for x in held]) for i in range(2, 6))
        learned = np.bincount(tokens[np.repeat(train, sizes)], minlength=len(words))
        row = [
            (part << 32) + at, dump(words, learned.astype(np.uint32), np.bincount(tokens, minlength=len(words)).astype(np.uint32)),
            dump(tokens), dump(ids, has_id, train, sizes.astype(np.uint32)), len(words), len(tokens), len(ids),
        ]
        at += 1
        types = [pa.int64(), pa.binary(), pa.binary(), pa.binary(), pa.int64(), pa.int64(), pa.int64()]
        yield pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(row, types, strict=True)], names=[c.split()[0] for c in BLOCK_TABLE.split(", ")])

    held, size = [], 0
    for batch in common.chunks(batches, "text"):
        offsets, index, distinct = common.split_words(batch.column("text"), lower=True)
        words = np.r_[hash_words(distinct), END]
        ids = batch.column("doc_id")
        held.append((words, np.insert(index, offsets[1:], len(distinct)).astype(np.uint32), ids.fill_null(0).to_numpy(), ids.is_valid().to_numpy(zero_copy_only=False), batch.column("train").to_numpy(zero_copy_only=False), np.diff(offsets) + 1))
        size += len(held[-1][1])
        if size >= BLOCK_TOKENS:
            yield from flush(held)
            held, size = [], 0
    if held:
        yield from flush(held)


def _read_raw(path: str, part: int, columns: list[str]) -> list[bytes]:
    """Columns of one partition of a table, which is one row."""
    fs, root = pafs.FileSystem.from_uri(path)
    files = [f.path for f in fs.get_file_info(pafs.FileSelector(f"{root}/part={part}")) if f.path.endswith(".parquet")]
    for f in files:
        with fs.open_input_file(f) as source:
            t = pq.ParquetFile(source).read(columns=columns)
        if t.num_rows:
            return [t.column(c)[0].as_py() for c in columns]
    raise FileNotFoundError(f"partition {part} of {path}")


def _read(path: str, part: int, columns: list[str]) -> list[list[np.ndarray]]:
    return [load(x) for x in _read_raw(path, part, columns)]


class Grams:
    """A block's distinct n-grams in the order of their buckets: columns of word numbers, the last word first. token_gram
    is the place of each token's n-gram."""

    def __init__(self, numbers: np.ndarray, tokens: np.ndarray, sizes: np.ndarray, order: int, deal: Callable):
        """numbers: those of the block's words, ascending, and of START behind them."""
        within = np.arange(len(tokens), dtype=np.int32) - np.repeat((np.cumsum(sizes) - sizes).astype(np.int32), sizes)
        start = np.uint32(len(numbers) - 1)
        columns = [tokens]
        for k in range(1, order):
            before = np.r_[np.full(min(k, len(tokens)), start), tokens[:-k]]
            columns.append(np.where(within >= k, before, start))
        codes = _code(columns[1:] + columns[:1], [len(numbers)] * order)
        by_code = np.argsort(codes, kind="stable")
        codes = codes[by_code]
        new = np.flatnonzero(np.diff(codes, prepend=-1))
        del codes
        columns = [numbers[c[by_code[new]]] for c in columns]
        buckets = deal(columns[1], columns[0])
        place = np.argsort(buckets, kind="stable")
        self.columns, buckets = [c[place] for c in columns], buckets[place]
        rank = np.empty(len(place), np.int32)
        rank[place] = np.arange(len(place), dtype=np.int32)
        self.token_gram = np.empty(len(tokens), np.int32)
        self.token_gram[by_code] = np.repeat(rank, np.diff(new, append=len(tokens)))
        starts = np.flatnonzero(np.diff(buckets, prepend=-1))
        self.parts = [(int(buckets[a]), slice(int(a), int(b))) for a, b in zip(starts, np.r_[starts[1:], len(buckets)], strict=True)]


BUCKET_TABLE = "bucket int, words binary, grams binary, asked binary, gram_n array<array<long>>, n_contexts long"
MESSAGE = "source long, target int, payload binary"


class Levels:
    """The n-grams of a bucket by order. Rows are sorted by the words before the last (nearest first), then the last, so
    that contexts of any order are runs of rows."""

    def __init__(self, columns: list[np.ndarray], counts: np.ndarray):
        n_words = int(columns[0].max()) + 1
        self.order = len(columns)
        self.grams, self.contexts = {}, {}  # by order: (each row's n-gram, first row of each n-gram, counts), each row's context
        change = np.zeros(len(counts), bool)
        for o in range(2, self.order + 1):
            before = columns[1:o]
            change |= np.diff(before[-1], prepend=-1) != 0
            self.contexts[o] = np.cumsum(change) - 1
            if o == self.order:
                rows = np.arange(len(counts))
                self.grams[o] = rows, rows, counts
            else:
                _, first, of = np.unique(self.contexts[o] * np.int64(n_words) + columns[0], return_index=True, return_inverse=True)
                self.grams[o] = of, first, np.bincount(of, counts, minlength=len(first)).astype(np.int64)

    def sums(self, unigram: np.ndarray, last: np.ndarray, stats: Statistics) -> dict[int, np.ndarray]:
        """By order, for each context: count, least count, discounted counts, and the sum over its seen n-grams of the
        discounted count one order below (of order 2: of the words' probabilities)."""
        out = {}
        for o, (_, first, c) in self.grams.items():
            context, seen = self.contexts[o][first], c > 0
            n = int(self.contexts[o][-1]) + 1
            least = np.full(n, np.inf)
            np.minimum.at(least, context[seen], c[seen])
            if o == 2:
                below = unigram[last[first]]
            else:
                of, _, lower = self.grams[o - 1]
                below = discounted(lower, stats.gram_d[o - 1])[of[first]]
            add = lambda x: np.bincount(context[seen], x[seen], minlength=n)  # noqa: E731, B023
            out[o] = np.stack((add(c), least, add(discounted(c, stats.gram_d[o])), add(below)))
        return out

    def log_probabilities(self, unigram: np.ndarray, last: np.ndarray, sums: dict[int, np.ndarray], stats: Statistics) -> np.ndarray:
        """log10 P of each row's n-gram."""
        of_lower, lower_p, lower_total = last, unigram, None
        for o, (of, first, c) in self.grams.items():
            count, least, mass, seen = sums[o]
            context = self.contexts[o][first]
            total = np.maximum(1, count + (least > K) * (count > 0))
            if lower_total is not None:
                starts = np.flatnonzero(np.diff(self.contexts[o], prepend=-1))
                seen = seen / lower_total[self.contexts[o - 1][starts]]
            alpha = np.where(count > 0, (total - mass) / total / np.maximum(1e-300, 1 - seen), 1.0)
            p = np.where(c > 0, discounted(c, stats.gram_d[o]) / total[context], alpha[context] * lower_p[of_lower[first]])
            of_lower, lower_p, lower_total = of, p, total
        with np.errstate(divide="ignore"):
            return np.log10(lower_p[of_lower])

    def keys(self, columns: list[np.ndarray]) -> np.ndarray:
        """A hash of every context of every order."""
        out = []
        with np.errstate(over="ignore"):
            for o in range(2, self.order + 1):
                starts = np.flatnonzero(np.diff(self.contexts[o], prepend=-1))
                key = np.full(len(starts), o << 40, U)
                for c in columns[1:o]:
                    key = (key + c[starts].astype(U) + U(0x9E3779B97F4A7C15)) * U(0xBF58476D1CE4E5B9)
                    key = (key ^ (key >> U(29))) * U(0x94D049BB133111EB)
                    key ^= key >> U(32)
                out.append(key)
        return np.concatenate(out)


def _count(order: int) -> Callable[[tuple, pd.DataFrame], pd.DataFrame]:
    """One bucket's messages to its table row."""

    def count(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("source")
        loaded = [load_sorted(p, order) for p in pdf["payload"]]
        columns = [np.concatenate([x[0][k] for x in loaded]) for k in range(order)]
        learned, sizes = np.concatenate([x[1][0] for x in loaded]), [len(x[1][0]) for x in loaded]
        del loaded
        _, at, of = np.unique(_code(columns, [int(c.max()) + 1 for c in columns]), return_index=True, return_inverse=True)
        columns = [c[at] for c in columns]
        counts = np.bincount(of, learned, minlength=len(at)).astype(np.int64)
        levels = Levels(columns[-1:] + columns[:-1], counts)
        gram_n = [[int((c == r).sum()) for r in range(1, K + 2)] for _, _, c in levels.grams.values()]
        n_contexts = sum(int(levels.contexts[o][-1]) + 1 for o in levels.contexts)
        asked = dump(pdf["source"].to_numpy(), np.array(sizes, np.int64), *[np.diff(x, prepend=0).astype(np.uint32) for x in np.split(of, np.cumsum(sizes)[:-1])])
        row = (int(key[0]), dump_sorted([np.unique(columns[-1])]), dump_sorted(columns, counts.astype(np.uint32)), asked, gram_n, n_contexts)
        return pd.DataFrame([row], columns=["bucket", "words", "grams", "asked", "gram_n", "n_contexts"])

    return count


RESULT = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"


def katz_scores(docs: DataFrame, learn_from: Column, id_col: str = "doc_id", text_col: str = "text", order: int = 3) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score of every row's whole text; counts of
    n-grams up to the order come from the rows that learn_from admits.

    A null or empty text is its end token alone. Every row is scored for itself, whether its identifier is null or
    repeated; rows for which learn_from is null are held out. Texts may have any length. Other columns are not read;
    an empty table gives no row. With no training token every word is unknown and has probability 1. Orders from 2."""
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"), F.coalesce(learn_from, F.lit(False)).alias("train"))
    blocks_at = common.shared_dir(spark, "katz-blocks")
    rows.mapInArrow(_blocks, BLOCK_TABLE).write.partitionBy("part").parquet(blocks_at)
    blocks = spark.read.schema(BLOCK_TABLE).parquet(blocks_at)
    n_words, n_tokens = blocks.agg(F.coalesce(F.sum("n_words"), F.lit(0)), F.coalesce(F.sum("n_tokens"), F.lit(0))).first()
    if not n_tokens:
        return spark.createDataFrame([], RESULT)
    words, stats, bases, frequent = _word_counts(blocks, max(1, -(-n_words // RANGE_KEYS)))
    known, start = words.where("source >= 0").select(*MESSAGE_COLUMNS), int(bases[-1])
    buckets, hot = max(1, -(-n_tokens // BUCKET_TOKENS)), {}
    n_docs = blocks.agg(F.sum("n_docs")).first()[0]
    if n_docs >= BUCKET_TOKENS // 2:
        frequent[start] = n_docs
    last = buckets
    for word, n in sorted(frequent.items()):
        parts = -(-2 * n // BUCKET_TOKENS)
        hot[word] = (last, parts)
        last += parts
    deal = _dealer(buckets, hot)

    def grams_of(block: int, numbers: np.ndarray) -> tuple[Grams, np.ndarray, list[np.ndarray]]:
        (tokens,), docs = _read(blocks_at, block, ["tokens", "docs"])
        return Grams(np.r_[numbers, start], tokens, docs[3].astype(np.int64), order, deal), tokens, docs

    def send(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        """A block's n-grams to their buckets, with their counts."""
        grams, _, (_, _, train, sizes) = grams_of(int(key[0]), _known(pdf, bases)[0])
        learned = np.bincount(grams.token_gram[np.repeat(train, sizes)], minlength=len(grams.columns[0])).astype(np.uint32)
        out = [(int(key[0]), bucket, dump_sorted([c[part] for c in grams.columns[1:] + grams.columns[:1]], learned[part])) for bucket, part in grams.parts]
        return pd.DataFrame(out, columns=MESSAGE_COLUMNS)

    table_at = common.shared_dir(spark, "katz")
    counted = known.groupBy("source").applyInPandas(send, MESSAGE).groupBy("target").applyInPandas(_count(order), BUCKET_TABLE)
    counted.withColumn("part", F.col("bucket")).write.partitionBy("part").parquet(table_at)
    table = spark.read.schema(f"{BUCKET_TABLE}, part int").parquet(table_at)
    sums = table.agg(*[F.sum(F.col("gram_n")[o][r]) for o in range(order - 1) for r in range(K + 1)], F.sum(F.when(F.col("bucket") >= buckets, F.col("n_contexts")))).first()
    for o in range(2, order + 1):
        stats.gram_d[o] = discounts(np.array(sums[(o - 2) * (K + 1) : (o - 1) * (K + 1)], np.int64))
    numbers = table.select("bucket")

    def ask(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for bucket, payload in zip(pdf["bucket"], pdf["words"], strict=True):
                own = load_sorted(payload, 1)[0][0]
                ends = np.searchsorted(own, bases)
                yield pd.DataFrame([(int(bucket), r, dump_sorted([own[a:b] - bases[r]])) for r, (a, b) in enumerate(zip(ends[:-1], ends[1:], strict=True)) if b > a], columns=MESSAGE_COLUMNS)

    def tell(key: tuple, asked: pd.DataFrame, of: pd.DataFrame) -> pd.DataFrame:
        (counts,) = load(of["payload"].iloc[0])
        return pd.DataFrame([(int(s), int(key[0]), dump(counts[load_sorted(p, 1)[0][0]])) for s, p in zip(asked["source"], asked["payload"], strict=True)], columns=MESSAGE_COLUMNS)

    asked = table.select("bucket", "words").mapInPandas(ask, MESSAGE)
    told = common.materialise(asked.groupBy("target").cogroup(words.where("source < 0").select(*MESSAGE_COLUMNS).groupBy("target")).applyInPandas(tell, MESSAGE), "katz-counts")

    def bucket_of(bucket: int, counts: pd.DataFrame) -> tuple[Levels, list[np.ndarray], np.ndarray, np.ndarray]:
        """The n-grams; their columns, the last word first as a place in the bucket's words; these words' probabilities."""
        words, grams = _read_raw(table_at, bucket, ["words", "grams"])
        columns, (c,) = load_sorted(grams, order)
        columns = [np.searchsorted(load_sorted(words, 1)[0][0], columns[-1]), *columns[:-1]]
        return Levels(columns, c.astype(np.int64)), columns, stats.unigram(_joined(counts).astype(np.int64))

    def share(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        """A frequent word's bucket tells what it knows of its contexts."""
        levels, columns, unigram = bucket_of(int(key[0]), pdf)
        keys, own = levels.keys(columns), np.concatenate(list(levels.sums(unigram, columns[0], stats).values()), axis=1)
        place = np.argsort(keys)
        out = [(int(key[0]), r, dump(keys[place][part], *own[:, place[part]])) for r, part in _slices(keys[place], ranges)]
        return pd.DataFrame(out, columns=MESSAGE_COLUMNS)

    def add_up(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        loaded = [load(p) for p in pdf["payload"]]
        keys, of = np.unique(np.concatenate([x[0] for x in loaded]), return_inverse=True)
        count, least, mass, seen = (np.concatenate([x[1 + i] for x in loaded]) for i in range(4))
        low = np.full(len(keys), np.inf)
        np.minimum.at(low, of, least)
        total = [np.bincount(of, count), low, np.bincount(of, mass), np.bincount(of, seen)]
        ends = np.cumsum([len(x[0]) for x in loaded])
        out = [(int(s), int(key[0]), dump(*[t[of[b - len(x[0]) : b]] for t in total])) for s, x, b in zip(pdf["source"], loaded, ends, strict=True)]
        return pd.DataFrame(out, columns=["source", "target", "payload"])

    ranges = max(1, -(-(sums[-1] or 0) // RANGE_KEYS))
    told = told.withColumn("context", F.lit(False))
    if hot:
        shared = told.where(F.col("source") >= buckets).groupBy("source").applyInPandas(share, MESSAGE)
        told = told.unionByName(common.materialise(shared.groupBy("target").applyInPandas(add_up, MESSAGE), "katz-contexts").withColumn("context", F.lit(True)))

    def answer(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        """A bucket's probabilities for every block that asked, in the order of its question."""
        bucket, is_context = int(key[0]), pdf["context"].to_numpy()
        levels, columns, unigram = bucket_of(bucket, pdf[~is_context])
        if bucket >= buckets:
            place = np.argsort(levels.keys(columns))
            own = np.empty((4, len(place)))
            own[:, place] = np.concatenate([np.stack(x) for x in _in_order(pdf[is_context])], axis=1)
            cuts = np.cumsum([int(c[-1]) + 1 for c in levels.contexts.values()])
            sums = dict(zip(levels.contexts, np.split(own, cuts[:-1], axis=1), strict=True))
        else:
            sums = levels.sums(unigram, columns[0], stats)
        p = levels.log_probabilities(unigram, columns[0], sums, stats)
        ((sources, _, *of),) = _read(table_at, bucket, ["asked"])
        return pd.DataFrame([(int(s), bucket, _coded(p[np.cumsum(x.astype(np.int64))])) for s, x in zip(sources, of, strict=True)], columns=MESSAGE_COLUMNS)

    def finish(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        """A block's documents: the sums over their tokens."""
        is_word = pdf["words"].to_numpy()
        numbers, c = _known(pdf[is_word], bases)
        grams, tokens, (ids, has_id, train, sizes) = grams_of(int(key[0]), numbers)
        first, c, p = np.cumsum(sizes.astype(np.int64)) - sizes, c[tokens].astype(np.int64), np.concatenate([values[code] for values, code in _in_order(pdf[~is_word])])
        base = np.log10((c + 0.5) / (stats.tokens + 0.5 * (stats.words + 1)))
        add = lambda x: np.add.reduceat(x, first)
        return pd.DataFrame({
            "doc_id": pd.arrays.IntegerArray(ids.astype(np.int64), ~has_id), "held_out": ~train, "n_tokens": sizes.astype(np.int64), "n_known": add((c > 0).astype(np.int64)),
            "train_tokens": stats.tokens, "base_score": add(base), "score": add(p[grams.token_gram]),
        })

    answers = told.groupBy("source").applyInPandas(answer, MESSAGE)
    back = answers.withColumn("words", F.lit(False)).unionByName(known.withColumn("words", F.lit(True)))
    return back.groupBy("source").applyInPandas(finish, RESULT)


MESSAGE_COLUMNS = ["source", "target", "payload"]


def _in_order(pdf: pd.DataFrame) -> list[list[np.ndarray]]:
    """The answers of all targets, in their order."""
    return [load(p) for _, p in sorted(zip(pdf["target"], pdf["payload"], strict=True), key=lambda x: x[0])]


def _coded(p: np.ndarray) -> bytes:
    """Probabilities, of which most n-grams share a few, as their values and places."""
    values, code = np.unique(p, return_inverse=True)
    return dump(values, code.astype(np.uint32))


def _joined(pdf: pd.DataFrame) -> np.ndarray:
    return np.concatenate([x[0] for x in _in_order(pdf)])


def _known(pdf: pd.DataFrame, bases: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(numbers, counts) of a block's words from the answers of the ranges."""
    targets, loaded = sorted(pdf["target"]), _in_order(pdf)
    return np.concatenate([np.cumsum(x[0].astype(np.int64)) + bases[t] for t, x in zip(targets, loaded, strict=True)]), np.concatenate([x[1] for x in loaded])


def _word_counts(blocks: DataFrame, ranges: int) -> tuple[DataFrame, Statistics, np.ndarray, dict[int, int]]:
    """For each block and range the numbers within the range (as differences) and training counts of the block's words,
    and with source -1 for each range the counts of all its words (source, target, payload); the statistics of words;
    the number of the first word of each range, and of all words; and the words that fill half a bucket or more, with
    their tokens in all documents."""

    def ask(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for part, payload in zip(pdf["part"], pdf["words"], strict=True):
                columns = load(payload)
                yield pd.DataFrame([(int(part), r, dump(*[c[own] for c in columns])) for r, own in _slices(columns[0], ranges)], columns=MESSAGE_COLUMNS)

    def answer(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        loaded = [load(p) for p in pdf["payload"]]
        words, of = np.unique(np.concatenate([x[0] for x in loaded]), return_inverse=True)
        learned, tokens = (np.bincount(of, np.concatenate([x[i] for x in loaded]), minlength=len(words)).astype(np.int64) for i in (1, 2))
        out, end = [], 0
        for source, x in zip(pdf["source"], loaded, strict=True):
            own = of[end : end + len(x[0])]
            end += len(own)
            out.append((int(source), int(key[0]), dump(np.diff(own, prepend=0).astype(np.uint32), learned[own]), None, None, None))
        often = np.flatnonzero(tokens >= BUCKET_TOKENS // 2)
        facts = [len(words), int(learned.sum()), int((learned > 0).sum()), *[int((learned == r).sum()) for r in range(1, K + 2)]]
        out.append((-1, int(key[0]), dump(learned), facts, often.tolist(), tokens[often].tolist()))
        return pd.DataFrame(out, columns=[*MESSAGE_COLUMNS, "facts", "often", "often_n"])

    asked = blocks.select("part", "words").mapInPandas(ask, MESSAGE)
    found = common.materialise(asked.groupBy("target").applyInPandas(answer, f"{MESSAGE}, facts array<long>, often array<long>, often_n array<long>"), "katz-words")
    facts = found.where("source < 0")
    n, v, *word_n = facts.agg(*[F.sum(F.col("facts")[i]) for i in range(1, K + 4)]).first()
    sizes = np.zeros(ranges, np.int64)
    for r in facts.select("target", F.col("facts")[0].alias("n")).toLocalIterator():
        sizes[r.target] = r.n
    bases = np.r_[0, np.cumsum(sizes)]
    often = facts.select("target", F.explode(F.arrays_zip("often", "often_n")).alias("x")).select("target", "x.often", "x.often_n")
    frequent = {int(bases[r.target] + r.often): r.often_n for r in often.toLocalIterator()}
    return found, Statistics.of(n, v, np.array(word_n, np.int64)), bases, frequent
