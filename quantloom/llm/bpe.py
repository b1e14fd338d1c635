"""Byte-level BPE in numpy: merge rounds over the symbols of many words in one flat array.

A round looks every adjacent pair up in the sorted pair keys by binary search, takes each word's lowest rank
and merges that pair wherever it stands in the word, left to right. Words without a known pair leave.
"""

from __future__ import annotations

import heapq
import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common
from .word_ids import vocabulary_path

#: Fixed value: the pre-tokenizer's pattern, with \s spelt as the Unicode property.
PIECES = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\p{White_Space}\p{L}\p{N}]+|\p{White_Space}+(?!\P{White_Space})|\p{White_Space}+")
#: Texts in which a space touches other white space, or an end, are cut by PIECES as a whole.
UNEVEN = r"^ | $|[\s\x0B\x85\pZ] | [\s\x0B\x85\pZ]"
#: Symbols beyond which a word is merged with a heap instead: rounds would be as many as its distinct merges.
LONG_WORD = 2048
CACHE_UNITS = 200_000
NONE = np.iinfo(np.int64).max


def byte_letters() -> list[str]:
    """The letter that stands for each byte: printable ones for themselves, the rest from U+0100 on in order."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = iter(range(256, 512))
    return [chr(b) if b in printable else chr(next(rest)) for b in range(256)]


class Merges:
    """The vocabulary, its merges as sorted pair keys, and the bytes of each id."""

    def __init__(self, name: str):
        with open(vocabulary_path(name), encoding="utf-8") as f:
            spec = json.load(f)
        vocab = spec["model"]["vocab"]
        letters = byte_letters()
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.size = max([*vocab.values(), *self.special.values()]) + 1
        self.byte_ids = np.array([vocab[x] for x in letters], np.int64)
        pairs = [m if isinstance(m, list) else m.split(" ") for m in spec["model"]["merges"]]
        keys = np.array([vocab[a] * self.size + vocab[b] for a, b in pairs], np.int64)
        order = np.argsort(keys, kind="stable")
        self.keys, self.ranks = keys[order], order.astype(np.int64)
        self.merged = np.array([vocab[a + b] for a, b in pairs], np.int64)  # by rank
        byte_of = {x: b for b, x in enumerate(letters)}
        tokens = [b""] * self.size
        for t, i in vocab.items():
            tokens[i] = bytes(byte_of[x] for x in t)
        for t, i in self.special.items():
            tokens[i] = t.encode()
        self.token_bytes = np.frombuffer(b"".join(tokens), np.uint8)
        self.token_sizes = np.fromiter(map(len, tokens), np.int64, self.size)
        self.token_starts = np.cumsum(self.token_sizes) - self.token_sizes

    def rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        keys = left * self.size + right
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        return np.where(self.keys[at] == keys, self.ranks[at], NONE)

    def _merge_long(self, symbols: list[int]) -> list[int]:
        """One long word: a heap of (rank, place) over a linked list."""
        n = len(symbols)
        after, before = [*range(1, n), -1], [-1, *range(n - 1)]
        all_ranks = self.rank(np.array(symbols[:-1], np.int64), np.array(symbols[1:], np.int64))
        heap = [(int(r), i, symbols[i], symbols[i + 1]) for i, r in enumerate(all_ranks) if r != NONE]
        heapq.heapify(heap)
        known: dict[tuple[int, int], int] = {}

        def push(i: int) -> None:
            if i < 0 or after[i] < 0:
                return
            pair = symbols[i], symbols[after[i]]
            if pair not in known:
                known[pair] = int(self.rank(np.array([pair[0]], np.int64), np.array([pair[1]], np.int64))[0])
            if known[pair] != NONE:
                heapq.heappush(heap, (known[pair], i, *pair))

        while heap:
            r, i, a, b = heapq.heappop(heap)
            j = after[i]
            if symbols[i] != a or j < 0 or symbols[j] != b:
                continue
            symbols[i], symbols[j] = int(self.merged[r]), -1
            after[i] = after[j]
            if after[j] >= 0:
                before[after[j]] = i
            push(before[i])
            push(i)
        return [s for s in symbols if s >= 0]

    def encode_words(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(sizes, ids) of all words."""
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        symbols = self.byte_ids[np.frombuffer(b"".join(words), np.uint8)]
        word = np.repeat(np.arange(len(words)), sizes)
        done_words, done_symbols = [], []
        if (long := np.flatnonzero(sizes > LONG_WORD)).size:
            for w in long:
                got = self._merge_long(symbols[word == w].tolist())
                done_words.append(np.full(len(got), w))
                done_symbols.append(np.array(got, np.int64))
            keep = ~np.isin(word, long)
            symbols, word = symbols[keep], word[keep]
        while len(symbols):
            rank = np.full(len(symbols), NONE)
            same = word[:-1] == word[1:]
            rank[:-1][same] = self.rank(symbols[:-1][same], symbols[1:][same])
            firsts = np.flatnonzero(np.r_[True, ~same])
            lengths = np.diff(np.r_[firsts, len(symbols)])
            least = np.repeat(np.minimum.reduceat(rank, firsts), lengths)
            active = least != NONE
            done_words.append(word[~active])
            done_symbols.append(symbols[~active])
            hit = active & (rank == least)
            # Of a run of overlapping hits, every second one, from the first.
            at = np.arange(len(hit))
            run_start = np.maximum.accumulate(np.where(hit & ~np.r_[False, hit[:-1]], at, 0))
            hit &= (at - run_start) % 2 == 0
            symbols = np.where(hit, self.merged[np.where(hit, rank, 0)], symbols)
            keep = active & ~np.r_[False, hit[:-1]]
            symbols, word = symbols[keep], word[keep]
        word, symbols = np.concatenate([*done_words, np.zeros(0, np.int64)]), np.concatenate([*done_symbols, np.zeros(0, np.int64)])
        return np.bincount(word, minlength=len(words)), symbols[np.argsort(word, kind="stable")].astype(np.uint32)


class ByteCoder:
    """encode(texts) and decode(offsets, ids) of whole texts.

    A text is cut before each single space between non-spaces; such units fall into pieces by themselves as
    they do in the text, and each distinct unit is encoded once. Uneven texts are cut into pieces as a whole;
    special tokens' strings become their ids."""

    def __init__(self, name: str):
        self.merges = Merges(name)
        self._clear()

    def _clear(self) -> None:
        self.place: dict[str, int] = {}
        self.starts, self.sizes, self.flat = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint32)

    def _encode_units(self, units: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(sizes, ids) of units, through their distinct pieces."""
        places: dict[str, int] = {}
        counts, index = np.zeros(len(units), np.int64), []
        for u, unit in enumerate(units):
            found = PIECES.findall(unit)
            counts[u] = len(found)
            index += [places.setdefault(p, len(places)) for p in found]
        if not index:
            return counts, np.zeros(0, np.uint32)
        sizes, ids = self.merges.encode_words([p.encode() for p in places])
        starts = np.cumsum(sizes) - sizes
        at = np.array(index, np.int64)
        ends = np.r_[0, np.cumsum(sizes[at])][np.r_[0, np.cumsum(counts)]]
        return np.diff(ends), ids[common.segments(starts[at], sizes[at])]

    def _learn(self, units: list[str]) -> None:
        if len(self.place) + len(units) > CACHE_UNITS:
            self._clear()
        new = [u for u in units if u not in self.place]
        if new:
            sizes, ids = self._encode_units(new)
            self.starts = np.r_[self.starts, len(self.flat) + np.cumsum(sizes) - sizes]
            self.sizes = np.r_[self.sizes, sizes]
            self.flat = np.r_[self.flat, ids]
            self.place.update(zip(new, range(len(self.place), len(self.place) + len(new)), strict=True))

    def _encode_special(self, text: str) -> np.ndarray:
        parts = regex.split("(" + "|".join(map(regex.escape, self.merges.special)) + ")", text) if self.merges.special else [text]
        out = [np.array([self.merges.special[p]], np.uint32) if p in self.merges.special else self._encode_units([p])[1] for p in parts if p]
        return np.concatenate([*out, np.zeros(0, np.uint32)])

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(offsets, ids): the ids of text i are ids[offsets[i]:offsets[i+1]]; a null text is empty."""
        texts = pc.fill_null(texts, "")
        uneven = pc.match_substring_regex(texts, UNEVEN)
        for s in self.merges.special:
            uneven = pc.or_(uneven, pc.match_substring(texts, s))
        lists = pc.split_pattern(pc.if_else(uneven, "", texts), " ")
        offsets = lists.offsets.to_numpy().astype(np.int64)
        offsets -= offsets[0]
        words = lists.flatten()
        first = np.zeros(len(words), bool)
        first[offsets[:-1][np.diff(offsets) > 0]] = True
        coded = pc.binary_join_element_wise(pc.if_else(pa.array(first), "", " "), words, "").dictionary_encode()
        units = coded.dictionary.to_pylist()
        self._learn(units)
        place = np.fromiter((self.place[u] for u in units), np.int64, len(units))[coded.indices.to_numpy(zero_copy_only=False)]
        sizes = self.sizes[place]
        ids = self.flat[common.segments(self.starts[place], sizes)]
        ends = np.r_[0, np.cumsum(sizes)][offsets]
        odd = np.flatnonzero(uneven.to_numpy(zero_copy_only=False))
        if not len(odd):
            return ends, ids
        own = {int(i): self._encode_special(texts[int(i)].as_py()) for i in odd}
        parts = [own[i] if i in own else ids[ends[i] : ends[i + 1]] for i in range(len(texts))]
        return np.r_[0, np.cumsum(np.fromiter(map(len, parts), np.int64, len(parts)))], np.concatenate(parts)

    def decode(self, offsets: np.ndarray, ids: np.ndarray) -> list[str]:
        """The texts of id sequences; ids outside the vocabulary are left out, broken UTF-8 becomes U+FFFD."""
        m = self.merges
        known = ids < m.size
        safe = np.where(known, ids, 0).astype(np.int64)
        sizes = np.where(known, m.token_sizes[safe], 0)
        data = m.token_bytes[common.segments(m.token_starts[safe], sizes)].tobytes()
        ends = np.r_[0, np.cumsum(sizes)][offsets]
        return [data[a:b].decode("utf-8", "replace") for a, b in zip(ends[:-1], ends[1:], strict=True)]


_CODERS: dict[str, ByteCoder] = {}


def coder(name: str) -> ByteCoder:
    """The worker's coder of this vocabulary file."""
    if name not in _CODERS:
        _CODERS[name] = ByteCoder(name)
    return _CODERS[name]


def encode(docs: DataFrame, vocabulary: str = "byte_bpe_50k.json", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_tokens and the ids, as little-endian 4-byte integers, of every whole text (null: empty).

    One row per input row, repeated rows included; a null identifier stays null; other columns are not read."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in common.chunks(batches, "text"):
            offsets, ids = coder(vocabulary).encode(batch.column("text"))
            data = ids.astype("<u4").tobytes()
            out = [data[4 * a : 4 * b] for a, b in zip(offsets[:-1], offsets[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(np.diff(offsets), pa.int64()), pa.array(out, pa.binary())], names=["doc_id", "n_tokens", "ids"])

    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    return rows.mapInArrow(run, f"doc_id {docs.schema[id_col].dataType.simpleString()}, n_tokens long, ids binary")


def decode(encoded: DataFrame, vocabulary: str = "byte_bpe_50k.json") -> DataFrame:
    """encoded with its text: the inverse of encode()."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in common.chunks(batches, "ids"):
            data = [x or b"" for x in batch.column("ids").to_pylist()]
            offsets = np.r_[0, np.cumsum(np.fromiter((len(x) // 4 for x in data), np.int64, len(data)))]
            texts = coder(vocabulary).decode(offsets, np.frombuffer(b"".join(data), "<u4"))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], names=[*batch.schema.names, "text"])

    return encoded.mapInArrow(run, ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in encoded.schema) + ", text string")
