"""Exact top-k inner-product search by pivot-table elimination.

Every vector has a table row of squared distances to the pivots. For a query, |d(q, p) - d(v, p)| is a lower
bound of d(q, v), the largest over the pivots so far the best; as q.v = (|q|^2 + |v|^2 - d(q, v)^2) / 2, it
bounds the score from above. Candidates whose bound is below a known k-th best score are never evaluated, the rest in
the order of their bounds until no bound reaches the k-th best; where bounds exclude little of a block, the block is
evaluated at once by a matrix product.

Vectors are dealt to blocks, one in a task at a time, and each block of queries travels to all of them as a row. So
neither the number of queries nor that of vectors meets the driver. The table is scanned four times: for its size, a sample,
the query blocks and the vector blocks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import common

N_PIVOTS, PIVOT_SAMPLE = 48, 2000
#: Queries that travel as one row; vectors of a block; queries and vectors whose bounds are in memory together.
QUERY_BLOCK, VECTOR_BLOCK, QUERY_TILE, VECTOR_TILE = 2048, 65536, 64, 4096
#: Share of a tile's pairs with sufficient bounds from which the whole tile is evaluated at once.
DENSE = 0.25


def scaled(embedding: Column, scale: int = 1024) -> Column:
    """floor(scale * x) of each component, x as double; null where the vector takes no part."""
    whole = F.forall(embedding, lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < F.lit(float("inf"))))
    return F.when(embedding.isNotNull() & whole, F.transform(embedding, lambda x: F.floor(x.cast("double") * scale)))


def _matrix(column: pa.ListArray, dims: int) -> np.ndarray:
    """Rows of equal length; shorter vectors are filled up with zeros."""
    flat, ends = column.flatten().to_numpy(zero_copy_only=False), column.offsets.to_numpy()
    lengths = np.diff(ends)
    if (lengths == dims).all():
        return flat.reshape(len(column), dims).astype(np.float64)
    out = np.zeros((len(column), dims))
    out[np.repeat(np.arange(len(column)), lengths), np.arange(len(flat)) - np.repeat(ends[:-1] - ends[0], lengths)] = flat
    return out


def choose_pivots(sample: np.ndarray, n: int) -> np.ndarray:
    """Farthest-first rows of a sample: each new pivot is the row farthest from those before."""
    if not len(sample):
        return sample
    x = sample.astype(np.float64)
    norms = (x * x).sum(1)
    at = [int(np.argmax(norms))]
    near = norms + norms[at[0]] - 2 * x @ x[at[0]]
    while len(at) < min(n, len(x)) and near.max() > 0:
        at.append(int(np.argmax(near)))
        near = np.minimum(near, norms + norms[at[-1]] - 2 * x @ x[at[-1]])
    return sample[at]


def _distances(x: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    """Distances of rows to pivots; squares below 2^53 are exact before the root."""
    a, b = x.astype(np.float64), pivots.astype(np.float64)
    return np.sqrt(np.maximum(0.0, (a * a).sum(1)[:, None] + (b * b).sum(1)[None, :] - 2 * a @ b.T))


class Best:
    """The k best (score, smaller id first) of one query so far."""

    def __init__(self, k: int):
        self.k, self.scores, self.ids = k, np.zeros(0, np.int64), np.zeros(0, np.int64)

    @property
    def floor(self) -> float:
        return float(self.scores[-1]) if len(self.scores) == self.k else -np.inf

    def add(self, scores: np.ndarray, ids: np.ndarray) -> None:
        scores, ids = np.concatenate((self.scores, scores)), np.concatenate((self.ids, ids))
        order = np.lexsort((ids, -scores))
        scores, ids = scores[order], ids[order]
        new = np.r_[True, (scores[1:] != scores[:-1]) | (ids[1:] != ids[:-1])]  # a repeated row counts once
        self.scores, self.ids = scores[new][: self.k], ids[new][: self.k]


class Block:
    """Vectors in a task, with their rows of the pivot table."""

    def __init__(self, ids: np.ndarray, x: np.ndarray, pivots: np.ndarray):
        self.ids, self.x = ids, x
        self.norms = (x * x).sum(1)
        self.table = np.ascontiguousarray(_distances(x, pivots).T.astype(np.float32))

    def search(self, q: np.ndarray, q_ids: np.ndarray, q_table: np.ndarray, floors: np.ndarray, k: int) -> tuple[list[Best], np.ndarray]:
        """The best of each query among the vectors, and the vectors evaluated for it. floors are scores that the
        queries' k-th best are known to reach. Bounds carry margins for rounding, so that none is too low."""
        bests, evaluated = [Best(k) for _ in q_ids], np.zeros(len(q_ids), np.int64)
        for a in range(0, len(q_ids), QUERY_TILE):
            rows = slice(a, a + QUERY_TILE)
            for b in range(0, len(self.ids), VECTOR_TILE):
                self._tile(q[rows], q_ids[rows], q_table[:, rows], floors[rows], slice(b, b + VECTOR_TILE), bests[rows], evaluated[rows])
        return bests, evaluated

    def _tile(self, q: np.ndarray, q_ids: np.ndarray, q_table: np.ndarray, floors: np.ndarray, part: slice, bests: list[Best], evaluated: np.ndarray) -> None:
        x, ids, table = self.x[part], self.ids[part], self.table[:, part]
        lower = np.zeros((len(q), len(x)), np.float32)
        for mine, theirs in zip(q_table, table, strict=True):
            gap = mine[:, None] - theirs
            np.maximum(lower, np.abs(gap, out=gap), out=lower)
        slack = 2.0**-20 * max(q_table.max(initial=0), table.max(initial=0))
        gap = np.maximum(lower.astype(np.float64) - slack, 0)
        bound = ((q * q).sum(1)[:, None] + self.norms[part]) * (0.5 + 1e-9) - gap * gap * (0.5 - 1e-9) + 1
        least = np.maximum(floors, [best.floor for best in bests])
        alive = (bound >= least[:, None]) & (ids != q_ids[:, None])
        asked = np.flatnonzero(alive.any(1))
        if alive.sum() > DENSE * alive.size:
            scores = q @ x.T
            evaluated += len(x)
            i, j = np.nonzero(alive & (scores >= least[:, None]))
            ends = np.searchsorted(i, np.arange(len(q) + 1))
            for at in np.unique(i):
                own = j[ends[at] : ends[at + 1]]
                bests[at].add(scores[at, own].astype(np.int64), ids[own])
            return
        for at in asked:
            best, step, done = bests[at], 4 * bests[at].k, 0
            own = np.flatnonzero(alive[at])
            own = own[np.argsort(-bound[at, own], kind="stable")]
            while done < len(own) and bound[at, own[done]] >= max(floors[at], best.floor):
                some = own[done : done + step]
                best.add((x[some] @ q[at]).astype(np.int64), ids[some])
                done += len(some)
                step *= 2
            evaluated[at] += done


def _floors(queries: np.ndarray, query_ids: np.ndarray, seeds: np.ndarray, seed_ids: np.ndarray, k: int) -> np.ndarray:
    """For each query the k-th best score among distinct sampled rows, which the true k-th best reaches."""
    _, first = np.unique(seed_ids, return_index=True)
    scores = np.where(seed_ids[first] != query_ids[:, None], queries @ seeds[first].T, -np.inf)
    return np.partition(scores, scores.shape[1] - k, axis=1)[:, scores.shape[1] - k] if scores.shape[1] >= k else np.full(len(queries), -np.inf)


def top_k(vectors: DataFrame, is_query: Column, k: int = 10, scale: int = 1024, id_col: str = "vec_id", vector_col: str = "embedding", n_pivots: int = N_PIVOTS) -> DataFrame:
    """query_id, rank, vec_id, score: each query row's k highest scores over all rows but those with its identifier;
    evaluated: the vectors that were evaluated for the query, of all.

    Ties go to the smaller identifier; fewer than k candidates give fewer rows. Null vectors, and those that hold
    a null or non-finite component, take no part, nor do null identifiers; shorter vectors count as filled up
    with zeros; a row repeated in every column named counts once; extra columns are not read; an empty table
    gives no row. Scores need |v|^2 below 2^53 after scaling; a larger one raises.

    The pivots are rows of a bounded sample, which also gives each query a first k-th best score."""
    spark = vectors.sparkSession
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), scaled(F.col(vector_col), scale).alias("v"), F.coalesce(is_query, F.lit(False)).alias("q")).where("vec_id is not null and v is not null")
    norm = F.aggregate("v", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double"))
    facts = rows.agg(F.max(F.size("v")), F.max(norm), F.sum(F.col("q").cast("long")), F.count(F.lit(1))).first()
    dims, largest, n_queries, total = int(facts[0] or 0), facts[1] or 0.0, int(facts[2] or 0), int(facts[3])
    if largest >= 2.0**53:
        raise ValueError("scaled vectors are too long for exact scores")
    if not n_queries:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long, evaluated long")
    sampled = rows.sample(min(1.0, 2 * PIVOT_SAMPLE / total), seed=7).limit(PIVOT_SAMPLE).select("vec_id", "v").toArrow().combine_chunks()
    seeds = np.concatenate([_matrix(c, dims) for c in sampled.column("v").chunks] or [np.zeros((0, dims))])
    shared = spark.sparkContext.broadcast((seeds, sampled.column("vec_id").to_numpy(), choose_pivots(seeds, n_pivots)))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seeds, seed_ids, _ = shared.value
        for batch in batches:
            for at in range(0, batch.num_rows, QUERY_BLOCK):
                part = batch.slice(at, QUERY_BLOCK)
                ids, q = part.column("vec_id").to_numpy(), _matrix(part.column("v"), dims)
                packed = [ids.tobytes(), q.astype(np.int32).tobytes(), _floors(q, ids, seeds, seed_ids, k).tobytes()]
                yield pa.RecordBatch.from_arrays([pa.array([x], pa.binary()) for x in packed], names=["q_ids", "q", "floors"])

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Each vector block's rows, then the query blocks."""
        _, _, pivots = shared.value
        held: list[tuple[np.ndarray, np.ndarray]] = []
        block, number = None, None
        for batch in batches:
            numbers, is_block = batch.column("block").to_numpy(), batch.column("q").is_valid().to_numpy(zero_copy_only=False)
            cuts = np.flatnonzero(np.r_[True, (numbers[1:] != numbers[:-1]) | (is_block[1:] != is_block[:-1])])
            for a, b in zip(cuts, np.r_[cuts[1:], batch.num_rows], strict=True):
                part = batch.slice(a, b - a)
                if numbers[a] != number:
                    held, block, number = [], None, numbers[a]
                if not is_block[a]:
                    held.append((part.column("vec_id").to_numpy(), _matrix(part.column("v"), dims)))
                    continue
                if not held:
                    continue
                block = block or Block(np.concatenate([h[0] for h in held]), np.concatenate([h[1] for h in held]), pivots)
                for q_ids, q, floors in zip(part.column("q_ids"), part.column("q"), part.column("floors"), strict=True):
                    q_ids = np.frombuffer(q_ids.as_py(), np.int64)
                    q = np.frombuffer(q.as_py(), np.int32).reshape(len(q_ids), dims).astype(np.float64)
                    bests, evaluated = block.search(q, q_ids, np.ascontiguousarray(_distances(q, pivots).T.astype(np.float32)), np.frombuffer(floors.as_py(), np.float64), k)
                    sizes = [len(x.ids) for x in bests]
                    columns = [
                        np.r_[q_ids, np.repeat(q_ids, sizes)], np.concatenate([np.zeros_like(q_ids), *[x.ids for x in bests]]),
                        np.concatenate([np.zeros_like(q_ids), *[x.scores for x in bests]]), np.r_[evaluated, np.full(sum(sizes), -1)],
                    ]
                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["query_id", "vec_id", "score", "evaluated"])

    cores = spark.sparkContext.defaultParallelism
    blocks = max(-(-total // VECTOR_BLOCK), min(4 * cores, -(-total // 1024)))
    none = lambda kind: F.lit(None).cast(kind)
    dealt = rows.select(F.pmod(F.monotonically_increasing_id(), F.lit(blocks)).cast("int").alias("block"), "vec_id", "v", none("binary").alias("q_ids"), none("binary").alias("q"), none("binary").alias("floors"))
    asked = rows.where("q").select("vec_id", "v").distinct().mapInArrow(pack, "q_ids binary, q binary, floors binary")
    everywhere = asked.select(F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"), none("long").alias("vec_id"), none("array<long>").alias("v"), "q_ids", "q", "floors")
    met = dealt.unionByName(everywhere).repartition(blocks, "block").sortWithinPartitions("block", F.col("q").isNotNull())
    found = common.materialise(met.mapInArrow(search, "query_id long, vec_id long, score long, evaluated long"), "found")
    counts = found.where("evaluated >= 0").groupBy("query_id").agg(F.sum("evaluated").alias("evaluated"))
    ranks = Window.partitionBy("query_id").orderBy(F.desc("score"), F.asc("vec_id"))
    unique = found.where("evaluated < 0").select("query_id", "vec_id", "score").distinct()
    best = unique.withColumn("rank", F.row_number().over(ranks)).where(F.col("rank") <= k)
    return best.join(counts, "query_id").select("query_id", "rank", "vec_id", "score", "evaluated")
