"""Phrase collocations: candidates from sketch upper bounds, counted exactly by Aho-Corasick automata.

Counts of hashed phrases, summed into a sketch, are upper bounds of the phrases' counts; a phrase is a candidate if its
own bound and those of all phrases within it reach the least count. Word counts are exact, bounds of pairs come next, then
those of three to five words where all pairs within can still be frequent. Candidates are compiled into automata of a
bounded size, whose letters are words; they begin anew where a piece ends or a word is in no candidate. Every shard of the
texts is scanned for overlapping matches, the counts are summed, and only then thresholds and scores apply.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import common

#: Text bytes of a shard; buckets of a sketch at least and at most (a bit of each is broadcast: 16 MB); a sketch has a
#: bucket for so many words; buckets that travel as one row; phrases of an automaton; phrases that a task remembers before it
#: sends them on; parts that a language's phrases are dealt to, a row for each task and part; words that an automaton reads
#: one after the other, other stretches beside them; phrases of which the counts travel as one row.
SHARD_BYTES, BUCKETS, WORDS_PER_BUCKET, CELL, AUTOMATON, REMEMBERED, GROUPS = 4 << 20, (1 << 16, 1 << 27), 8, 1 << 16, 1_000_000, 300_000, 1024
STRETCH, NUMBERS = 64, 1 << 12

#: Words are runs without space and tab; pieces end at `.,;:!?` and at ends of lines.
KINDS = common.byte_classes(spaces=" \t", delimiters=".,;:!?\n\x0b\x0c\r")

#: Fixed odd multipliers of the hash.
STEP, MIX = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)


def _hashes(words: list[str]) -> np.ndarray:
    return pd.util.hash_array(np.array(words, object), categorize=False) if words else np.zeros(0, np.uint64)


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * MIX
    return h ^ (h >> np.uint64(29))


@dataclass
class Shard:
    """Words of some texts in order: code of the word and of the language, and the piece."""

    words: pa.Array
    languages: list[str]
    word: np.ndarray
    language: np.ndarray
    piece: np.ndarray

    @staticmethod
    def of(batch: pa.RecordBatch) -> Shard:
        offsets, word, words, piece = common.byte_words(batch.column("text"), KINDS)
        language = batch.column("lang").dictionary_encode()
        each = language.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        return Shard(words, language.dictionary.to_pylist(), word, np.repeat(each, np.diff(offsets)), piece)

    def hashes(self, most: int) -> list[np.ndarray]:
        """Hashes of the phrases of 1, 2, ... most words that begin at each word; those over a piece's end mean nothing."""
        own, out = _hashes(self.words.to_pylist())[self.word], []
        language = _hashes(self.languages)[self.language] if len(self.languages) else own
        h = own
        for k in range(1, most + 1):
            if k > 1:
                h = h[:-1] * STEP + own[k - 1 :]
            out.append(_mixed(h ^ language[: len(h)] ^ np.uint64(k)))
        return out

    def within(self, k: int) -> np.ndarray:
        """Where a phrase of k words lies in one piece."""
        return self.piece[: len(self.piece) - k + 1] == self.piece[k - 1 :]


def shards(batches: Iterator[pa.RecordBatch]) -> Iterator[Shard]:
    for batch in common.chunks(common.joined(batches, "text", SHARD_BYTES), "text", SHARD_BYTES):
        yield Shard.of(batch)


class Sketch:
    """Bits of the buckets whose counts reach the least count; a set of phrases not known to be rarer."""

    def __init__(self, bits: np.ndarray, n_buckets: int):
        self.bits, self.shift = bits, np.uint64(64 - (n_buckets.bit_length() - 1))

    def may(self, h: np.ndarray) -> np.ndarray:
        bucket = (h >> self.shift).astype(np.int64)
        return (self.bits[bucket >> 3] >> (bucket & 7).astype(np.uint8) & 1).astype(bool)


def passing(shard: Shard, h: list[np.ndarray], sketches: list[Sketch], most: int) -> list[np.ndarray]:
    """For 1, 2, ... words: where a phrase begins whose bounds, and those of the phrases within it, reach the least count.
    Beyond the sketches given only the phrases within count."""
    out: list[np.ndarray] = []
    for k in range(1, most + 1):
        if len(shard.word) < k:
            out.append(np.zeros(0, bool))
            continue
        ok = shard.within(k) if k == 1 else out[-1][:-1] & out[-1][1:] & shard.within(k)
        if k <= len(sketches):
            at = np.flatnonzero(ok)
            ok[at] = sketches[k - 1].may(h[k - 1][at])
        out.append(ok)
    return out


def _messages(bucket: np.ndarray, count: np.ndarray | None, level: int, least: int) -> pa.RecordBatch:
    """Rows (level, cell, places, counts) of the buckets that occur; counts beyond `least` are cut to it, which keeps every
    comparison of their sum with it."""
    if count is None:
        bucket, count = np.unique(bucket, return_counts=True)
    cells, begins = np.unique(bucket // CELL, return_index=True)
    ends = pa.array(np.append(begins, len(bucket)).astype(np.int32))
    place, number = pa.array((bucket % CELL).astype(np.uint16).view(np.int16)), pa.array(np.minimum(count, least).astype(np.int32))
    return pa.RecordBatch.from_arrays([pa.array(np.full(len(cells), level, np.int32)), pa.array(cells.astype(np.int64)), pa.ListArray.from_arrays(ends, place), pa.ListArray.from_arrays(ends, number)], names=["level", "cell", "places", "counts"])


MESSAGES = "level int, cell long, places array<short>, counts array<int>"


def _sketches(messages: DataFrame, levels: list[int], n_buckets: int, least: int) -> list[Sketch]:
    """Sums the messages of each cell; only the bits of sums that reach `least` come to the driver, BUCKETS / 8 bytes a level."""

    def total(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, own = None, np.zeros(CELL, np.int32)
        for batch in batches:
            for level, cell, places, counts in zip(*(batch.column(c) for c in ("level", "cell", "places", "counts")), strict=True):
                if (level, cell) != at:
                    if at:
                        yield done(at, own)
                    at, own = (level, cell), np.zeros(CELL, np.int32)
                of = places.values.to_numpy().view(np.uint16)
                own[of] = np.minimum(own[of] + counts.values.to_numpy(), least)
        if at:
            yield done(at, own)

    def done(at: tuple, own: np.ndarray) -> pa.RecordBatch:
        bits = np.packbits(own >= least, bitorder="little").tobytes()
        return pa.RecordBatch.from_arrays([pa.array([at[0].as_py()], pa.int32()), pa.array([at[1].as_py()], pa.int64()), pa.array([bits], pa.binary())], names=["level", "cell", "bits"])

    out = {level: np.zeros(n_buckets // 8, np.uint8) for level in levels}
    dealt = messages.repartition("level", "cell").sortWithinPartitions("level", "cell")
    for r in dealt.mapInArrow(total, "level int, cell long, bits binary").collect():
        out[r.level][r.cell * CELL // 8 : (r.cell + 1) * CELL // 8] = np.frombuffer(r.bits, np.uint8)
    return [Sketch(out[level], n_buckets) for level in levels]


def word_counts(texts: DataFrame) -> DataFrame:
    """lang, phrase, a of every word."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for shard in shards(batches):
            size = max(len(shard.words), 1)
            pairs, n = np.unique(shard.language * size + shard.word, return_counts=True)
            names = pa.array(shard.languages, pa.string()).take(pa.array(pairs // size))
            yield pa.RecordBatch.from_arrays([names, shard.words.take(pa.array(pairs % size)), pa.array(n, pa.int64())], names=["lang", "phrase", "a"])

    return texts.mapInArrow(count, "lang string, phrase string, a long").groupBy("lang", "phrase").agg(F.sum("a").alias("a"))


def candidates(texts: DataFrame, words: DataFrame, n_words: int, most: int, least: int) -> DataFrame:
    """lang, phrase, words of every phrase of 2 to `most` words whose bounds reach `least`, and some that are rarer."""
    n_buckets = min(max(1 << (n_words // WORDS_PER_BUCKET).bit_length(), BUCKETS[0]), BUCKETS[1])
    shift = np.uint64(64 - (n_buckets.bit_length() - 1))
    spark = texts.sparkSession

    def of_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            h = _mixed(_hashes(batch.column("phrase").to_pylist()) ^ _hashes(batch.column("lang").to_pylist()) ^ np.uint64(1))
            bucket = (h >> shift).astype(np.int64)
            order = np.argsort(bucket, kind="stable")
            unique, begins = np.unique(bucket[order], return_index=True)
            if len(unique):
                yield _messages(unique, np.add.reduceat(batch.column("a").to_numpy()[order], begins), 1, least)

    def of_phrases(known: list[Sketch], levels: list[int]):
        shared = spark.sparkContext.broadcast([s.bits for s in known])

        def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            own = [Sketch(bits, n_buckets) for bits in shared.value]
            for shard in shards(batches):
                h = shard.hashes(levels[-1])
                ok = passing(shard, h, own, levels[-1])
                for k in levels:
                    if ok[k - 1].any():
                        yield _messages((h[k - 1][ok[k - 1]] >> shift).astype(np.int64), None, k, least)

        return _sketches(texts.mapInArrow(sketch, MESSAGES), levels, n_buckets, least)

    sketches = _sketches(words.where(F.col("a") >= least).select("lang", "phrase", "a").mapInArrow(of_words, MESSAGES), [1], n_buckets, least)
    sketches += of_phrases(sketches, [2])
    if most > 2:
        sketches += of_phrases(sketches, list(range(3, most + 1)))
    shared = spark.sparkContext.broadcast([s.bits for s in sketches])

    def collect(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, seen = [Sketch(bits, n_buckets) for bits in shared.value], set()

        def packed() -> pa.RecordBatch:
            rows: dict[tuple[str, int], list[str]] = {}
            for lang, phrase in seen:
                rows.setdefault((lang, zlib.crc32(phrase.encode()) % GROUPS), []).append(phrase)
            return pa.RecordBatch.from_arrays([pa.array([k[0] for k in rows], pa.string()), pa.array([k[1] for k in rows], pa.int32()), pa.array(list(rows.values()), pa.list_(pa.string()))], names=["lang", "part", "phrases"])

        for shard in shards(batches):
            ok, size, names = passing(shard, shard.hashes(most), own, most), max(len(shard.words), 1), shard.words.to_pylist()
            code = shard.language * size + shard.word  # codes of the phrases of one word less, the same for the same words
            for k in range(2, most + 1):
                at = np.flatnonzero(ok[k - 1])
                _, first, same = np.unique(code[at] * size + shard.word[at + k - 1], return_index=True, return_inverse=True)
                code = np.zeros(len(shard.word), np.int64)
                code[at] = same
                seen.update((shard.languages[shard.language[i]], " ".join([names[w] for w in shard.word[i : i + k].tolist()])) for i in at[first].tolist())
            if len(seen) > REMEMBERED:
                yield packed()
                seen.clear()
        yield packed()

    def distinct(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Each phrase of a part once; parts come one after the other."""
        at, phrases = None, set()
        for batch in batches:
            for lang, part, own in zip(*(batch.column(c).to_pylist() for c in ("lang", "part", "phrases")), strict=True):
                if (lang, part) != at:
                    if at:
                        yield listed(at[0], phrases)
                    at, phrases = (lang, part), set()
                phrases.update(own)
        if at:
            yield listed(at[0], phrases)

    def listed(lang: str, phrases: set[str]) -> pa.RecordBatch:
        own = sorted(phrases)
        return pa.RecordBatch.from_arrays([pa.array([lang] * len(own), pa.string()), pa.array(own, pa.string()), pa.array([p.count(" ") + 1 for p in own], pa.int32())], names=["lang", "phrase", "words"])

    dealt = texts.mapInArrow(collect, "lang string, part int, phrases array<string>").repartition("lang", "part").sortWithinPartitions("lang", "part")
    return dealt.mapInArrow(distinct, "lang string, phrase string, words int")


class Automaton:
    """An Aho-Corasick automaton over words, so that neither parts of words nor words of two pieces or languages match.

    State 0 is the root; a state of one word is that word's code in its language; longer states follow by length and are
    numbered as their edges (state and code of the next word) are sorted, which needs a number an edge and no pointer."""

    def __init__(self, phrases: pa.Array, languages: pa.Array):
        split = pc.split_pattern(phrases, " ")
        word, language = split.flatten().dictionary_encode(), languages.dictionary_encode()
        self.words, self.languages = word.dictionary, language.dictionary
        lengths = np.diff(split.offsets.to_numpy()).astype(np.int64)
        begins = np.cumsum(lengths) - lengths
        key = np.repeat(language.indices.to_numpy(), lengths).astype(np.int64) * len(self.words) + word.indices.to_numpy()
        self.roots, code = np.unique(key, return_inverse=True)
        code += 1
        self.base, self.depths = len(self.roots) + 1, [1, len(self.roots) + 1]
        self.edges, self.fail = np.zeros(0, np.int64), np.zeros(self.base, np.int32)
        self.ends = code[begins]
        for k in range(1, int(lengths.max(initial=0))):
            longer = np.flatnonzero(lengths > k)
            edges, same = np.unique(self.ends[longer] * self.base + code[begins[longer] + k], return_inverse=True)
            fail = self.step(self.fail[edges // self.base], edges % self.base)
            self.ends[longer] = self.depths[-1] + same
            self.edges, self.fail = np.append(self.edges, edges), np.append(self.fail, fail)
            self.depths.append(len(self.fail))

    def step(self, state: np.ndarray, code: np.ndarray) -> np.ndarray:
        """The states after one more word each: along an edge of the state or of the first of its failure states that has one."""
        out = code.astype(np.int32)  # what the root leads to
        at = np.flatnonzero(state)
        state, code = state[at], code[at]
        while len(at) and len(self.edges):
            edge = state.astype(np.int64) * self.base + code
            found = np.searchsorted(self.edges, edge)
            hit = self.edges[np.minimum(found, len(self.edges) - 1)] == edge
            out[at[hit]] = found[hit] + self.base
            state = self.fail[state]
            left = np.flatnonzero(~hit & (state > 0))
            at, state, code = at[left], state[left], code[left]
        return out

    def codes(self, shard: Shard) -> np.ndarray:
        """The code of each word of the shard, 0 for those in no phrase of their language."""
        word, language = (pc.fill_null(pc.index_in(own, value_set=of), -1).to_numpy(zero_copy_only=False).astype(np.int64) for own, of in ((shard.words, self.words), (pa.array(shard.languages, pa.string()), self.languages)))
        at = np.flatnonzero((word[shard.word] >= 0) & (language[shard.language] >= 0)) if len(word) else np.zeros(0, np.int64)
        key = language[shard.language[at]] * len(self.words) + word[shard.word[at]]
        found = np.searchsorted(self.roots, key)
        hit = self.roots[np.minimum(found, len(self.roots) - 1)] == key
        out = np.zeros(len(shard.word), np.int64)
        out[at[hit]] = found[hit] + 1
        return out

    def visits(self, shard: Shard) -> np.ndarray:
        """How often each state is reached. Stretches of at most STRETCH words, each after as many words before it as a
        state can hold, go through the automaton side by side."""
        code = self.codes(shard)
        same = shard.piece[1:] == shard.piece[:-1]
        begins = np.flatnonzero(np.r_[True, ~(same & (code[1:] > 0) & (code[:-1] > 0))][: len(code)])
        lengths = np.diff(np.append(begins, len(code)))
        begins, lengths = begins[lengths > 1], lengths[lengths > 1]  # no phrase has one word
        parts = -(-lengths // STRETCH)
        inner = common.segments(np.zeros(len(parts), np.int64), parts) * STRETCH
        first, size = np.repeat(begins, parts) + inner, np.minimum(np.repeat(lengths, parts) - inner, STRETCH)
        before = np.minimum(inner, len(self.depths) - 2)
        order = np.argsort(-(size + before), kind="stable")
        first, before, size = (first - before)[order], before[order], (size + before)[order]
        reached, state = np.zeros(len(code), np.int32), np.zeros(len(first), np.int32)
        for t in range(int(size.max(initial=0))):
            active = int(np.searchsorted(-size, -t))
            at = first[:active] + t
            state[:active] = self.step(state[:active], code[at])
            own = before[:active] <= t
            reached[at[own]] = state[:active][own]
        return np.bincount(reached, minlength=len(self.fail))

    def counts(self, visits: np.ndarray) -> np.ndarray:
        """How often each phrase occurs, overlapping ones too: a state's visits are those of its failure states as well."""
        total = visits.copy()
        for low, high in reversed(list(zip(self.depths[1:-1], self.depths[2:], strict=True))):
            np.add.at(total, self.fail[low:high], total[low:high])
        return total[self.ends]


def phrase_counts(texts: DataFrame, found: DataFrame) -> DataFrame:
    """lang, phrase, words, a: exact counts of the candidates that occur. Automata hold about AUTOMATON phrases, one is
    broadcast after the other, and each scans all shards; tasks send counts of phrases by number, a row for NUMBERS of them."""
    spark = texts.sparkSession
    groups = max(1, -(-found.count() // AUTOMATON))
    out = spark.createDataFrame([], "lang string, phrase string, words int, a long")
    for g in range(groups):
        rows = found.where(F.pmod(F.xxhash64("lang", "phrase"), F.lit(groups)) == g).toArrow().combine_chunks()
        if not rows.num_rows:
            continue
        lang, phrase, words = (rows.column(c).combine_chunks() for c in ("lang", "phrase", "words"))
        shared, named = spark.sparkContext.broadcast(Automaton(phrase, lang)), spark.sparkContext.broadcast((lang, phrase, words))

        def scan(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            own = shared.value
            visits = np.zeros(len(own.fail), np.int64)
            for shard in shards(batches):
                visits += own.visits(shard)
            total = own.counts(visits)
            at = np.flatnonzero(total)
            cells, begins = np.unique(at // NUMBERS, return_index=True)
            ends = pa.array(np.append(begins, len(at)).astype(np.int32))
            yield pa.RecordBatch.from_arrays([pa.array(cells, pa.int64()), pa.ListArray.from_arrays(ends, pa.array((at % NUMBERS).astype(np.int16))), pa.ListArray.from_arrays(ends, pa.array(total[at]))], names=["cell", "places", "counts"])

        def total(batches: Iterator[pa.RecordBatch], named=named) -> Iterator[pa.RecordBatch]:
            sums: dict[int, np.ndarray] = {}
            for batch in batches:
                for cell, places, counts in zip(*(batch.column(c) for c in ("cell", "places", "counts")), strict=True):
                    own = sums.setdefault(cell.as_py(), np.zeros(NUMBERS, np.int64))
                    own[places.values.to_numpy()] += counts.values.to_numpy()
            for cell, own in sums.items():
                at = np.flatnonzero(own)
                yield pa.RecordBatch.from_arrays([*(x.take(pa.array(at + cell * NUMBERS)) for x in named.value), pa.array(own[at])], names=["lang", "phrase", "words", "a"])

        counted = texts.mapInArrow(scan, "cell long, places array<short>, counts array<long>").repartition("cell")
        out = out.unionByName(counted.mapInArrow(total, "lang string, phrase string, words int, a long"))
    return out


def products() -> tuple[Column, Column]:
    """1000 * a * n and l * r of longs, exact up to 38 digits."""
    wide = lambda c: F.col(c).cast("decimal(20,0)")
    return (F.lit(1000).cast("decimal(4,0)") * wide("a") * wide("n")).alias("above"), (wide("l") * wide("r")).alias("below")


def mine(docs: DataFrame, least: int = 100, most: int = 5, top: int = 2000, contained: int = 100, text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """Each language's `top` phrases of 2 to `most` words that occur `least` times or more: lang, rank, phrase, a, l, r, n, score.

    The score is the lowest floor(1000 * a * n / (l * r)) of all cuts in two, at ties the shorter first part counts.
    Phrases within a longer one that occurs at least `contained` per cent as often go. Every whole text counts, repeated
    ones repeatedly; null texts are empty; a null language is `und`, together with rows marked so; equal scores go by
    the count, then by the phrase's bytes; an empty table gives no row."""
    if least < 1 or most < 2:
        raise ValueError("least must be 1 and most 2 at least")
    texts = docs.select(F.coalesce(F.col(text_col), F.lit("")).alias("text"), F.coalesce(F.col(lang_col), F.lit("und")).alias("lang"))
    words = common.materialise(word_counts(texts), "phrase-words")
    n_words = words.agg(F.sum("a")).first()[0] or 0
    found = common.materialise(candidates(texts, words, n_words, most, least), "phrase-candidates")
    phrases = common.materialise(phrase_counts(texts, found).where(F.col("a") >= least), "phrase-counts")

    counted = words.where(F.col("a") >= least).select("lang", "phrase", "a").unionByName(phrases.select("lang", "phrase", "a"))
    of = lambda side, name: counted.select("lang", F.col("phrase").alias(side), F.col("a").alias(name))
    own = F.split("phrase", " ", -1)
    part = lambda start, n: F.array_join(F.slice(own, start, n), " ")
    cuts = phrases.select("lang", "phrase", "words", "a", F.explode(F.sequence(F.lit(1), F.col("words") - 1)).alias("cut"))
    cuts = cuts.select("lang", "phrase", "a", "cut", part(1, F.col("cut")).alias("left"), part(F.col("cut") + 1, F.col("words")).alias("right"))
    cuts = cuts.join(of("left", "l"), ["lang", "left"]).join(of("right", "r"), ["lang", "right"]).join(words.groupBy("lang").agg(F.sum("a").alias("n")), "lang")
    above, below = products()
    cuts = cuts.select("*", above, below)
    lowest = F.min(F.struct(F.expr("above div below").alias("score"), "cut", "l", "r"))
    scored = cuts.groupBy("lang", "phrase").agg(F.first("a").alias("a"), F.first("n").alias("n"), lowest.alias("low")).select("lang", "phrase", "a", "low.l", "low.r", "n", "low.score")

    inner = F.flatten(F.transform(F.sequence(F.lit(2), F.col("words") - 1), lambda n: F.transform(F.sequence(F.lit(1), F.col("words") - n + 1), lambda i: part(i, n))))
    longer = phrases.where("words > 2").select("lang", F.explode(F.array_distinct(inner)).alias("phrase"), F.col("a").alias("longest")).groupBy("lang", "phrase").agg(F.max("longest").alias("longest"))
    kept = scored.join(longer, ["lang", "phrase"], "left").where(F.col("longest").isNull() | (100 * F.col("longest") < contained * F.col("a")))
    best = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    return kept.withColumn("rank", F.row_number().over(best).cast("long")).where(F.col("rank") <= top).select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
