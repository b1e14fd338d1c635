"""Ranked lexical search by three-phase uniform thresholds over term-partitioned postings.

The index holds, for each term and block of documents, a list of places and weights of the occurrences, largest weight
first, and is partitioned by term. For each query: (1) the heads of its lists give partial scores, the k-th best of them
a lower bound; (2) that bound divided by the number of lists is a uniform threshold: every list gives its entries
down to it, from which come a better lower bound and, with what the other lists can still hold, an upper bound of each
document; (3) documents whose upper bound reaches the lower bound are candidates, whose lists are looked up for exact
scores. A document that no list gave in (2) stays below the lower bound.
"""

from __future__ import annotations

import math
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common

#: Text bytes of a block of documents; queries that are answered together; places that the rows of a frequent term are dealt to.
BLOCK_BYTES, QUERY_BLOCK, SPREAD = 16 << 20, 1024, 64

#: Terms are runs of ASCII letters and digits and of all characters beyond ASCII.
KINDS = common.byte_classes(words="0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz", default=1)

LISTS = "block long, term string, at array<int>, weight array<int>, doc_ids array<long>"


@dataclass
class Index:
    """`lists` by term and block; a row without term has a block's identifiers. Documents with a term, and all their terms."""

    lists: DataFrame
    n_docs: int
    n_terms: int


def totals(texts: DataFrame) -> tuple[int, int]:
    """Texts with a term, and all their terms with repeats."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in common.chunks(batches, "text"):
            n = np.diff(common.byte_words(batch.column("text"), KINDS)[0])
            yield pa.RecordBatch.from_arrays([pa.array([np.count_nonzero(n)], pa.int64()), pa.array([n.sum()], pa.int64())], names=["docs", "terms"])

    row = texts.mapInArrow(count, "docs long, terms long").agg(F.sum("docs"), F.sum("terms")).first()
    return row[0] or 0, row[1] or 0


def build(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", block_bytes: int = BLOCK_BYTES) -> Index:
    """Indexes every whole text. A term has a row for each block it occurs in, so that no row grows with its documents,
    and the rows of a term are dealt to at most SPREAD places."""
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    n_docs, n_terms = totals(texts.select("text"))

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get().partitionId() << 32
        for number, batch in enumerate(common.chunks(common.joined(batches, "text", block_bytes), "text", block_bytes)):
            offsets, words, distinct, _ = common.byte_words(batch.column("text"), KINDS)
            n = np.diff(offsets)
            size = max(len(distinct), 1)
            pairs, tf = np.unique(np.repeat(np.arange(len(n)), n) * size + words, return_counts=True)
            at, term = pairs // size, pairs % size
            weight = 1_000_000_000 * tf // (1000 * tf + 8 * (25 + 75 * n[at] * n_docs // max(n_terms, 1)))
            order = np.lexsort((at, -weight, term))
            ends = pa.array(np.append(0, np.cumsum(np.bincount(term, minlength=len(distinct)))).astype(np.int32))
            lists = [pa.ListArray.from_arrays(ends, pa.array(x[order].astype(np.int32))) for x in (at, weight)]
            yield pa.RecordBatch.from_arrays([pa.array([task + number] * len(distinct), pa.int64()), distinct, *lists, pa.nulls(len(distinct), pa.list_(pa.int64()))], names=NAMES)
            ids = pa.ListArray.from_arrays(pa.array([0, batch.num_rows], pa.int32()), batch.column("doc_id"))
            yield pa.RecordBatch.from_arrays([pa.array([task + number], pa.int64()), pa.nulls(1, pa.string()), *(pa.nulls(1, pa.list_(pa.int32())) for _ in lists), ids], names=NAMES)

    NAMES = ["block", "term", "at", "weight", "doc_ids"]
    lists = texts.mapInArrow(index, LISTS).repartition("term", F.col("block") % SPREAD).sortWithinPartitions("term", "block")
    return Index(common.materialise(lists, "postings"), n_docs, n_terms)


class Plan:
    """What the tasks know of a block of queries: for each query the codes of its lists, their factors (repeats in the
    query times the term's weight), thresholds on an entry's weight, and what an entry below the threshold can add."""

    def __init__(self, queries: list[dict[str, int]], heads: dict[str, list[tuple[int, int, int]]], idf: dict[str, int], k: int):
        self.k, self.code = k, {t: i for i, t in enumerate(heads)}
        self.lists: list[tuple[np.ndarray, ...]] = []
        self.lower: list[int] = []
        for terms in queries:
            own = [(t, n * idf[t]) for t, n in terms.items() if idf.get(t)]
            partial: defaultdict[tuple[int, int], int] = defaultdict(int)
            for t, factor in own:
                for block, at, weight in heads[t]:
                    partial[block, at] += factor * weight
            lower = sorted(partial.values(), reverse=True)[k - 1] if len(partial) >= k else 0
            threshold = max(1, -(-lower // max(len(own), 1)))
            factors = np.array([f for _, f in own], np.int64)
            below = np.minimum(threshold - 1, factors * np.array([heads[t][0][2] for t, _ in own], np.int64))
            self.lists.append((np.array([self.code[t] for t, _ in own], np.int64), factors, -(-threshold // np.maximum(factors, 1)), below))
            self.lower.append(lower)

    def floors(self) -> dict[str, int]:
        """The least threshold of each list over the queries."""
        least: dict[int, int] = {}
        for codes, _, floors, _ in self.lists:
            for c, f in zip(codes.tolist(), floors.tolist(), strict=True):
                least[c] = min(f, least.get(c, f))
        return {t: least[c] for t, c in self.code.items() if c in least}


class Block:
    """A block's lists by code, with weights negated for searching, and its identifiers."""

    def __init__(self, rows: pa.Table):
        rows = rows.combine_chunks()
        self.at, self.weight = {}, {}
        for code, at, weight, ids in zip(*(rows.column(c) for c in ("code", "at", "weight", "doc_ids")), strict=True):
            if code.as_py() < 0:
                self.ids = ids.values
            else:
                self.at[code.as_py()], self.weight[code.as_py()] = at.values.to_numpy(), weight.values.to_numpy()
        self.n = len(self.ids)

    def bounds(self, lists: tuple[np.ndarray, ...]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Places that the query's lists give down to the thresholds, their partial scores and upper bounds."""
        partial, open_, rest = np.zeros(self.n, np.int64), np.zeros(self.n, np.int64), int(lists[3].sum())
        for code, factor, floor, below in zip(*(x.tolist() for x in lists), strict=True):
            if code in self.at:
                stop = np.searchsorted(-self.weight[code], -floor, side="right")
                at = self.at[code][:stop]
                partial[at] += factor * self.weight[code][:stop].astype(np.int64)
                open_[at] -= below
        seen = np.flatnonzero(partial)
        return seen, partial[seen], partial[seen] + open_[seen] + rest

    def exact(self, lists: tuple[np.ndarray, ...]) -> np.ndarray:
        score = np.zeros(self.n, np.int64)
        for code, factor in zip(lists[0].tolist(), lists[1].tolist(), strict=True):
            if code in self.at:
                score[self.at[code]] += factor * self.weight[code].astype(np.int64)
        return score


def _answer(spark: SparkSession, index: Index, queries: list[dict[str, int]], k: int) -> DataFrame:
    """query int, doc_id, score: the k best of each query, more where blocks agree."""
    terms = sorted({t for q in queries for t in q})
    asked = spark.createDataFrame([(t,) for t in terms], "term string")
    own = index.lists.join(F.broadcast(asked), "term")
    df = {r.term: r.n for r in own.groupBy("term").agg(F.sum(F.size("at")).alias("n")).collect()}
    idf = {t: math.floor(1000 * math.log((2 * index.n_docs + 2) / (2 * n + 1))) for t, n in df.items()}
    first = own.select("term", "block", F.inline(F.slice(F.arrays_zip("at", "weight"), 1, k)))
    best = Window.partitionBy("term").orderBy(F.desc("weight"), "block", "at")
    heads: dict[str, list[tuple[int, int, int]]] = {}
    for r in first.withColumn("i", F.row_number().over(best)).where(F.col("i") <= k).orderBy("term", "i").collect():
        heads.setdefault(r.term, []).append((r.block, r.at, r.weight))
    plan = Plan(queries, heads, idf, k)

    floors = spark.createDataFrame([(t, plan.code[t], f) for t, f in plan.floors().items()], "term string, code int, floor long")
    whole = index.lists.join(F.broadcast(floors), "term")
    long_enough = F.size(F.filter("weight", lambda w: w >= F.col("floor")))
    given = whole.withColumn("n", long_enough).where("n > 0").select("block", "code", F.slice("at", 1, F.col("n")).alias("at"), F.slice("weight", 1, F.col("n")).alias("weight"), F.lit(None).cast("array<long>").alias("doc_ids"))
    ids = index.lists.where("term IS NULL").select("block", F.lit(-1).alias("code"), "at", "weight", "doc_ids")
    given = common.materialise(given.unionByName(ids), "given")

    def better(key: tuple, rows: pa.Table) -> pa.Table:
        """The k best partial scores of each query above its lower bound."""
        block, out = Block(rows), []
        for q, lists in enumerate(plan.lists):
            partial = block.bounds(lists)[1]
            partial = partial[partial > plan.lower[q]]
            out += [(q, int(x)) for x in np.partition(partial, -plan.k)[-plan.k :]] if len(partial) > plan.k else [(q, int(x)) for x in partial]
        return pa.table([pa.array([x[0] for x in out], pa.int32()), pa.array([x[1] for x in out], pa.int64())], names=["query", "partial"])

    found = given.groupBy("block").applyInArrow(better, "query int, partial long")
    rank = Window.partitionBy("query").orderBy(F.desc("partial"))
    lower = list(plan.lower)
    for r in found.withColumn("i", F.row_number().over(rank)).where(F.col("i") <= k).where(F.col("i") == k).collect():
        lower[r.query] = r.partial

    def candidates(key: tuple, rows: pa.Table) -> pa.Table:
        block, out = Block(rows), []
        for q, lists in enumerate(plan.lists):
            at, _, upper = block.bounds(lists)
            at = at[upper >= lower[q]]
            if len(at):
                out.append((key[0].as_py(), q, at.astype(np.int32), block.ids.take(pa.array(at))))
        block_id, query, at, doc_ids = zip(*out, strict=True) if out else ((), (), (), ())
        return pa.table([pa.array(block_id, pa.int64()), pa.array(query, pa.int32()), pa.array(list(at), pa.list_(pa.int32())), pa.array([x.to_pylist() for x in doc_ids], pa.list_(pa.int64()))], names=["block", "query", "at", "doc_ids"])

    left = common.materialise(given.groupBy("block").applyInArrow(candidates, "block long, query int, at array<int>, doc_ids array<long>"), "candidates")
    codes = spark.createDataFrame([(q, int(c)) for q, lists in enumerate(plan.lists) for c in lists[0]], "query int, code int")
    wanted = left.select("block", "query").join(F.broadcast(codes), "query").select("block", "code").distinct()
    names = spark.createDataFrame([(t, c) for t, c in plan.code.items()], "term string, code int")
    looked_up = index.lists.join(F.broadcast(names), "term").join(wanted, ["block", "code"]).select("block", "code", "at", "weight", F.lit(None).cast("array<long>").alias("doc_ids"))
    lists = looked_up.unionByName(ids)

    def exact(key: tuple, asked: pa.Table, rows: pa.Table) -> pa.Table:
        out: list[tuple] = []
        block = Block(rows) if asked.num_rows else None
        for row in asked.to_pylist():
            at = np.array(row["at"], np.int64)
            score = block.exact(plan.lists[row["query"]])[at]
            known = np.array([-(1 << 63) if x is None else x for x in row["doc_ids"]], np.int64)
            for i in np.lexsort((known, -score))[: plan.k].tolist():
                out.append((row["query"], row["doc_ids"][i], int(score[i])))
        query, doc_id, score = zip(*out, strict=True) if out else ((), (), ())
        return pa.table([pa.array(query, pa.int32()), pa.array(doc_id, pa.int64()), pa.array(score, pa.int64())], names=["query", "doc_id", "score"])

    return left.groupBy("block").cogroup(lists.groupBy("block")).applyInArrow(exact, "query int, doc_id long, score long")


def search(docs: DataFrame, queries: DataFrame, k: int = 10, id_col: str = "doc_id", text_col: str = "text", query_id_col: str = "item_id", query_text_col: str = "text") -> DataFrame:
    """item_id, rank, doc_id, score: each query's k documents of the highest scores above 0, ties to smaller identifiers.

    Every document is searched; queries are answered in blocks of about QUERY_BLOCK. Null and empty texts have no
    terms, are counted in no statistic and found by no query; a null identifier stays null and is the smallest;
    repeated documents are ranked each for itself; of repeated query rows each is answered; an empty table gives no row."""
    spark = docs.sparkSession
    asked = queries.select(F.col(query_id_col).cast("long").alias("item_id"), F.col(query_text_col).alias("text")).where("text IS NOT NULL").withColumn("row", F.monotonically_increasing_id())
    asked = common.materialise(asked, "queries")
    n_blocks = max(1, -(-asked.count() // QUERY_BLOCK))
    index = build(docs, id_col, text_col)
    out = spark.createDataFrame([], "item_id long, rank int, doc_id long, score long")
    for b in range(n_blocks):
        rows = asked.where(F.pmod(F.xxhash64("row"), F.lit(n_blocks)) == b).orderBy("row").collect()
        offsets, words, distinct, _ = common.byte_words(pa.array([r.text for r in rows], pa.string()), KINDS)
        names = distinct.to_pylist()
        terms = [dict(Counter(names[w] for w in words[x:y].tolist())) for x, y in zip(offsets[:-1], offsets[1:], strict=True)]
        if not names:
            continue
        found = _answer(spark, index, terms, k)
        best = Window.partitionBy("query").orderBy(F.desc("score"), "doc_id")
        ranked = found.where("score > 0").withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
        items = spark.createDataFrame([(q, r.item_id) for q, r in enumerate(rows)], "query int, item_id long")
        out = out.unionByName(ranked.join(F.broadcast(items), "query").select("item_id", "rank", "doc_id", "score"))
    return out
