"""Exact n-gram Jaccard join with count-vector R-trees.

A text's set holds the distinct hashes of its word shingles. Shingles fall into GROUPS by hash; the counts per
group are the set's point, and the sum of two points' coordinate minima bounds their overlap from above.

Sets that can link meet in tiles: two sets of similarity s or more differ in at most D shingles, D following from
their sizes, so of m bands of the hash range at least m - D hold the same shingles in both. A tile is a band with one
content. A set with D + 1 non-empty bands or more needs its D + 1 rarest alone: put all bands in order of their number
of sets, and the rarest band that two linked sets share has as many shared ones behind it as either of them leaves
out. So what many texts have in common brings together only those that have little else. Sets with fewer non-empty
bands (they are few) keep all their bands, empty ones too, for each other.

In each tile, an R-tree over the points finds the sets whose bound reaches the needed overlap, and the surviving pairs
are verified on the full sets. Counts say little where several shingles fall into a group, so of what the tree finds only
those go on whose parities, of more groups, differ in no more places than linked sets can differ in shingles. A pair that
meets in many tiles of a task is sent on once. A long set fills the groups so evenly that its bound says little, so pairs
first meet with finer points, of about two shingles a group.

Components need no link between sets that are connected already. So a first round verifies a star for each
tile, a second one a star over the components left in it, and a last one all surviving pairs between different
components: no link between components is missed. No task compares more than a block of a tile with another block.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import AtomicType

from . import common

#: More groups let fewer differing shingles hide each other in the bound: fewer pairs are verified in vain.
GROUPS, CLASS_RATIO, LEAF, FANOUT = 128, 1.5, 32, 16
#: Bands for each one in which a linked set can't differ: more of them leave out more of the frequent ones.
SPARE = 1.5
#: Members of a tile in a block; larger tiles are compared block by block.
TILE_MEMBERS = 256
#: Parities of a set at least and at most: two a shingle within that. Pairs that a task remembers as sent on.
PARITIES, REMEMBERED = (256, 2048), 200_000
#: Spokes that one task verifies against a hub.
STAR = 256
#: Size of a filter that is broadcast (16 MB); more identifiers than it serves meet their rows by a shuffle instead.
MAX_FILTER_BITS = 1 << 27
U = np.uint64


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    x = x ^ (x >> U(30))
    x = x * U(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U(27))
    x = x * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def shingle_sets(texts: pa.Array, k: int) -> list[np.ndarray]:
    """Each text's distinct shingle hashes, sorted: of k words, or of all words if there are fewer; none without words."""
    offsets, index, distinct = common.split_words(texts, lower=True)
    hashes = np.fromiter((xxhash.xxh3_64_intdigest(w) for w in distinct.cast(pa.binary()).to_pylist()), U, len(distinct))
    with np.errstate(over="ignore"):
        powers = mix(np.arange(1, k + 1).astype(U) * U(0x9E3779B97F4A7C15)) | U(1)
        h = hashes[index] if len(index) else np.zeros(0, U)
        n = max(0, len(h) - k + 1)
        full = np.zeros(n, U)
        for j in range(k):
            full += h[j : j + n] * powers[j]
        full = mix(full)
        out = []
        for a, b in zip(offsets[:-1], offsets[1:], strict=True):
            if b - a >= k:
                out.append(np.unique(full[a : b - k + 1]))
            elif b > a:
                out.append(mix(np.array([(h[a:b] * powers[: b - a]).sum() + U(b - a)], U)))
            else:
                out.append(np.zeros(0, U))
    return out


class Bands:
    """Size classes and their numbers of bands for a similarity of percent/100 or more."""

    def __init__(self, percent: int):
        self.percent = percent
        self.bounds = [1]
        while self.bounds[-1] < 1 << 40:
            self.bounds.append(max(self.bounds[-1] + 1, int(self.bounds[-1] * CLASS_RATIO)))
        self.edges = np.array(self.bounds)

    def differ(self, c: int) -> int:
        """The shingles in which two linked sets can differ, the larger of them in class c."""
        return 2 * (self.bounds[c + 1] - 1) * (100 - self.percent) // (100 + self.percent)

    def keys(self, s: np.ndarray) -> list[tuple[int, int, np.ndarray]]:
        """(class, how many of the most frequent tiles can be left out, tiles) of a set: for its own class, and for
        the next ones if a linked set may lie there."""
        n, out = len(s), []
        c = int(np.searchsorted(self.edges, n, side="right")) - 1
        with np.errstate(over="ignore"):
            sums = np.r_[U(0), np.cumsum(mix(s ^ U(0xA5A5A5A55A5A5A5A)), dtype=U)]
            while c + 1 < len(self.bounds) and (self.bounds[c] <= n or self.bounds[c] * self.percent <= 100 * n):
                least = self.differ(c) + 1
                m = int(np.ceil(SPARE * least))
                band = ((s >> U(32)) * U(m) >> U(32)).astype(np.int64)
                starts = np.flatnonzero(np.diff(band, prepend=-1))
                own = band[starts]
                content = sums[np.r_[starts[1:], n]] - sums[starts]
                if len(own) < least:
                    full = np.zeros(m, U)
                    full[own] = content
                    own, content = np.arange(m), full
                    spare = 0
                else:
                    spare = len(own) - least
                out.append((c, spare, mix(content + mix(own.astype(U) + U(c << 40)))))
                c += 1
        return out


def needed(a: np.ndarray, b: np.ndarray | int, percent: int) -> np.ndarray:
    """The least overlap of linked sets of sizes a and b."""
    return -(-(a + b) * percent // (100 + percent))


class RTree:
    """A packed R-tree: leaves of LEAF neighbouring points, then FANOUT nodes to a node, with coordinate maxima and least sizes."""

    def __init__(self, points: np.ndarray, percent: int):
        self.percent = percent
        self.order = self._tile(points, np.arange(len(points)))
        self.points = points[self.order]
        self.sizes = self.points.sum(1)
        self.levels = [(self.points, self.sizes)]
        step = LEAF
        while len(self.levels[-1][0]) > 1:
            high, least = self.levels[-1]
            at = np.arange(0, len(high), step)
            self.levels.append((np.maximum.reduceat(high, at), np.minimum.reduceat(least, at)))
            step = FANOUT

    def _tile(self, points: np.ndarray, rows: np.ndarray) -> np.ndarray:
        """Sort-tile: halves along the widest coordinate until a leaf is left."""
        if len(rows) <= LEAF:
            return rows
        own = points[rows]
        wide = int(np.argmax(own.max(0) - own.min(0)))
        half = -(-len(rows) // (2 * LEAF)) * LEAF
        rows = rows[np.argsort(own[:, wide], kind="stable")]
        return np.concatenate((self._tile(points, rows[:half]), self._tile(points, rows[half:])))

    def search(self, point: np.ndarray) -> np.ndarray:
        """Rows whose summed coordinate minima with the point reach the needed overlap."""
        size = point.sum()
        nodes = np.zeros(1, np.int64)
        for level in range(len(self.levels) - 1, -1, -1):
            high, least = self.levels[level]
            bound = np.minimum(high[nodes], point).sum(1)
            nodes = nodes[bound >= needed(least[nodes], size, self.percent)]
            if level:
                width = LEAF if level == 1 else FANOUT
                nodes = (nodes[:, None] * width + np.arange(width)).ravel()
                nodes = nodes[nodes < len(self.levels[level - 1][0])]
        return self.order[nodes]


def may_link(points: np.ndarray, bits: np.ndarray, i: int, near: np.ndarray, percent: int) -> np.ndarray:
    """Those of near whose parities differ from i's in no more places than linked sets differ in shingles: every place in
    which they differ holds a shingle of one set alone."""
    size, sizes = points[i].sum(), points[near].sum(1)
    return near[np.bitwise_count(bits[near] ^ bits[i]).sum(1, dtype=np.int64) <= size + sizes - 2 * needed(sizes, size, percent)]


def _star(points: np.ndarray, bits: np.ndarray, ids: np.ndarray, percent: int) -> list[tuple[int, int]]:
    """(hub, spoke) of one tile: the smallest free identifier takes all free sets that its bounds reach, and so on."""
    free = np.ones(len(ids), bool)
    tree, out = RTree(points, percent), []
    for i in np.argsort(ids, kind="stable"):
        if free[i]:
            free[i] = False
            near = tree.search(points[i])
            near = may_link(points, bits, i, near[free[near]], percent)
            free[near] = False
            out += [(int(ids[i]), int(j)) for j in ids[near]]
    return out


def _texts(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))


def _hashes(s: np.ndarray) -> tuple[int, int]:
    return int(mix(s ^ U(0x1234567)).sum().view(np.int64)), int(mix(s ^ U(0x89ABCDEF0)).sum().view(np.int64))


def _batch(rows: list[tuple], names: list[str], types: list[pa.DataType]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(types)], names=names)


def signatures(docs: DataFrame, k: int, id_col: str, text_col: str) -> DataFrame:
    """doc_id, n_shingles, two hashes of the set, its two points and its parities (null for an empty set)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, types = ["n_shingles", "h1", "h2", "point", "fine", "bits"], [pa.int64()] * 3 + [pa.binary()] * 3
        for batch in common.chunks(batches, "text"):
            with np.errstate(over="ignore"):
                rows = [(len(s), *_hashes(s), pack_point(s), pack_fine(s), pack_bits(s)) if len(s) else (0, None, None, None, None, None) for s in shingle_sets(batch.column("text"), k)]
            made = _batch(rows, names, types)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *made.columns], names=["doc_id", *names])

    return _texts(docs, id_col, text_col).mapInArrow(run, "doc_id long, n_shingles long, h1 long, h2 long, point binary, fine binary, bits binary")


def tile_keys(docs: DataFrame, k: int, percent: int, id_col: str, text_col: str) -> DataFrame:
    """doc_id, the set's size and hashes, and for each of its classes: class, spare, keys (see Bands.keys)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bands = Bands(percent)
        names = ["doc_id", "n_shingles", "h1", "h2", "class", "spare", "keys"]
        types = [pa.int64()] * 4 + [pa.int32()] * 2 + [pa.list_(pa.int64())]
        for batch in common.chunks(batches, "text"):
            rows = []
            with np.errstate(over="ignore"):
                for i, s in zip(batch.column("doc_id").to_pylist(), shingle_sets(batch.column("text"), k), strict=True):
                    if len(s):
                        rows += [(i, len(s), *_hashes(s), c, spare, keys.view(np.int64)) for c, spare, keys in bands.keys(s)]
            yield _batch(rows, names, types)

    named = _texts(docs, id_col, text_col).where("doc_id is not null")
    return named.mapInArrow(run, "doc_id long, n_shingles long, h1 long, h2 long, class int, spare int, keys array<long>")


def _groups(batches: Iterator[pd.DataFrame], key: str) -> Iterator[pd.DataFrame]:
    """The groups of rows that come sorted by key."""
    held: pd.DataFrame | None = None
    for pdf in batches:
        if held is not None:
            pdf = pd.concat([held, pdf], ignore_index=True)
        if not len(pdf):
            continue
        k = pdf[key].to_numpy()
        starts = np.flatnonzero(np.r_[True, k[1:] != k[:-1]])
        for a, b in zip(starts[:-1], starts[1:], strict=True):
            yield pdf.iloc[a:b]
        held = pdf.iloc[starts[-1] :]
    if held is not None and len(held):
        yield held


def pack_point(s: np.ndarray, groups: int = GROUPS) -> bytes:
    """The shingles in each group (a power of two), in half a byte a group or as many bytes as the largest count takes; that
    width first, 0 for half a byte."""
    counts = np.bincount((s & U(groups - 1)).astype(np.int64), minlength=groups)
    if counts.max() < 1 << 4:
        return bytes([0]) + (counts[::2] | counts[1::2] << 4).astype(np.uint8).tobytes()
    width = 1 if counts.max() < 1 << 8 else 2 if counts.max() < 1 << 16 else 4
    return bytes([width]) + counts.astype(f"<u{width}").tobytes()


def pack_fine(s: np.ndarray) -> bytes:
    """A point of groups in proportion to the set."""
    return pack_point(s, max(GROUPS, 1 << (len(s) // 4).bit_length()))


def read_point(data: bytes) -> np.ndarray:
    if not data[0]:
        both = np.frombuffer(data, np.uint8, offset=1)
        return np.stack((both & 15, both >> 4), 1).ravel().astype(np.int64)
    return np.frombuffer(data, f"<u{data[0]}", offset=1).astype(np.int64)


def pack_bits(s: np.ndarray) -> bytes:
    """Whether the number of shingles is odd, for groups in proportion to the set."""
    groups = min(max(1 << (2 * len(s)).bit_length(), PARITIES[0]), PARITIES[1])
    odd = np.bincount((s & U(groups - 1)).astype(np.int64), minlength=groups) & 1
    return np.packbits(odd.astype(bool), bitorder="little").tobytes()


def read_bits(column: Iterable[bytes]) -> np.ndarray:
    """Parities of some sets, those of more groups folded to as many as the others have."""
    least, out = min(map(len, column)), []
    for data in column:
        own = np.frombuffer(data, np.uint8)
        out.append(np.bitwise_xor.reduce(own.reshape(-1, least)))
    return np.stack(out)


def _points(column: pd.Series) -> np.ndarray:
    return np.stack([read_point(p) for p in column])


def _pairs(rows: DataFrame, percent: int, crossing: bool) -> DataFrame:
    """Candidate pairs (a < b) of rows (tile, rep, comp, home, probe, point, bits), each tile's rows in one task.

    Stars over the tile's rows; or, crossing, each probe with the members of other components. Every set outside the
    tile's main component (home) is a probe as well as a member, so that of two such sets the smaller asks."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sent: set[tuple[int, int]] = set()
        for g in _groups(batches, "tile"):
            if len(g) < 2:
                continue
            ids, points, bits, out = g["rep"].to_numpy(), _points(g["point"]), read_bits(g["bits"]), []
            if not crossing:
                if len(ids) == 2:
                    if np.minimum(points[0], points[1]).sum() >= needed(points[0].sum(), int(points[1].sum()), percent) and len(may_link(points, bits, 0, np.array([1]), percent)):
                        out.append((int(ids.min()), int(ids.max())))
                else:
                    out = _star(points, bits, ids, percent)
            else:
                comps, home, probe = g["comp"].to_numpy(), g["home"].to_numpy(), g["probe"].to_numpy()
                member = np.flatnonzero(~probe)
                tree = RTree(points[member], percent)
                for i in np.flatnonzero(probe) if len(member) else ():
                    near = member[tree.search(points[i])]
                    near = near[(comps[near] != comps[i]) & (~home[near] | (ids[near] > ids[i]))]
                    out += [(int(min(ids[i], j)), int(max(ids[i], j))) for j in ids[may_link(points, bits, i, near, percent)]]
            if fresh := set(out) - sent:
                if len(sent) > REMEMBERED:
                    sent.clear()
                sent |= fresh
                yield pd.DataFrame(sorted(fresh), columns=["a", "b"])

    cols = ["tile", "rep", "comp", "home", "probe", "point", "bits"]
    dealt = rows.select(*cols).repartition("tile").sortWithinPartitions("tile", "rep")
    return dealt.mapInPandas(run, "a long, b long").where("a <> b").distinct()


def _place(ids: np.ndarray, bits: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        return (mix(ids.astype(np.int64).view(U)) & U(bits - 1)).astype(np.int64)


def _filter_of(ids: DataFrame, count: int) -> tuple[int, bytes] | None:
    """A Bloom filter of one hash over identifiers: false positives only cost work. None if it were too large."""
    bits = 1 << max(10, (16 * count).bit_length())
    if bits > MAX_FILTER_BITS:
        return None

    def part(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own = np.zeros(bits, bool)
        for pdf in batches:
            own[_place(pdf["id"].to_numpy(), bits)] = True
        yield pd.DataFrame({"bits": [np.packbits(own).tobytes()]})

    total = np.zeros(bits // 8, np.uint8)
    for row in ids.coalesce(8).mapInPandas(part, "bits binary").toLocalIterator():
        total |= np.frombuffer(row.bits, np.uint8)
    return bits, total.tobytes()


def verify(docs: DataFrame, pairs: DataFrame, k: int, percent: int, id_col: str, text_col: str) -> DataFrame:
    """The pairs (a, b) of identifiers whose sets link. Sets are made again from the texts of the pairs' documents
    alone, which a Bloom filter of bounded size picks while the texts are read; a semi-join where there are too many."""
    ids = pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct()
    found = _filter_of(ids, max(1, ids.count()))
    shared = docs.sparkSession.sparkContext.broadcast(found)

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted = np.unpackbits(np.frombuffer(shared.value[1], np.uint8)).astype(bool) if shared.value else None
        for batch in batches:
            if wanted is not None:
                keep = wanted[_place(batch.column("doc_id").to_numpy(zero_copy_only=False), shared.value[0])]
                batch = batch.filter(pa.array(keep))
            for chunk in common.chunks(iter([batch]), "text"):
                made = [s.tobytes() for s in shingle_sets(chunk.column("text"), k)]
                yield pa.RecordBatch.from_arrays([chunk.column("doc_id"), pa.array(made, pa.binary())], names=["id", "data"])

    def accept(x: bytes, y: bytes) -> bool:
        a, b = np.frombuffer(x, U), np.frombuffer(y, U)
        if not len(a) or not len(b):
            return False
        overlap = int((a[np.minimum(np.searchsorted(a, b), len(a) - 1)] == b).sum())
        return 100 * overlap >= percent * (len(a) + len(b) - overlap)

    rows = _texts(docs, id_col, text_col).where("doc_id is not null")
    if found is None:
        rows = rows.join(ids, F.col("doc_id") == F.col("id"), "left_semi")
    return _linked(pairs, rows.mapInArrow(sets, "id long, data binary"), accept)


def refine(pairs: DataFrame, fine: DataFrame, percent: int) -> DataFrame:
    """The pairs whose bound by finer points (id, data) still reaches the needed overlap."""

    def accept(x: bytes, y: bytes) -> bool:
        p, q = read_point(x), read_point(y)
        if len(p) < len(q):
            p, q = q, p
        p = p.reshape(-1, len(q)).sum(0)  # groups are low bits of the hash: the finer point folds into the coarser
        return bool(np.minimum(p, q).sum() >= needed(p.sum(), int(q.sum()), percent))

    return _linked(pairs, fine, accept)


def _linked(pairs: DataFrame, values: DataFrame, accept: Callable[[bytes, bytes], bool]) -> DataFrame:
    """The pairs (a, b) whose values (id, data) are accepted. Each value goes to the stars that it is a spoke of, and
    a hub to its own stars, of at most about STAR spokes each. An identifier may have several values: one is enough."""
    fans = pairs.groupBy("a").agg(F.ceil(F.count(F.lit(1)) / STAR).cast("int").alias("salts"))
    spokes = pairs.join(fans, "a").select("a", F.pmod(F.xxhash64("b"), F.col("salts")).cast("int").alias("salt"), F.col("b").alias("id"), F.lit(1).alias("spoke"))
    hubs = fans.select("a", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"), F.col("a").alias("id"), F.lit(0).alias("spoke"))
    met = spokes.unionByName(hubs).join(values, "id")

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        star, hubs = None, []
        for batch in batches:
            out = []
            for a, salt, spoke, i, data in zip(*[batch.column(c).to_pylist() for c in ("a", "salt", "spoke", "id")], batch.column("data"), strict=True):
                if star != (a, salt):
                    star, hubs = (a, salt), []
                if not spoke:
                    hubs.append(data.as_py())
                elif any(accept(hub, data.as_py()) for hub in hubs):
                    out.append((a, i))
            yield pa.RecordBatch.from_arrays([pa.array([o[j] for o in out], pa.int64()) for j in (0, 1)], names=["a", "b"])

    dealt = met.select("a", "salt", "spoke", "id", "data").repartition("a", "salt").sortWithinPartitions("a", "salt", "spoke", "id")
    return dealt.mapInArrow(meet, "a long, b long").distinct()


def components(edges: DataFrame) -> DataFrame:
    """node, comp: the smallest node each one reaches. Labels take the least of their neighbours' and jump to their
    label's label, until nothing changes; each round is written to the shared folder and replaces the one before."""
    both = common.materialise(edges.select("a", "b").union(edges.select("b", "a")).distinct(), "edges")
    step = common.materialise(both.groupBy(F.col("a").alias("node")).agg(F.least(F.col("node"), F.min("b")).alias("comp")), "labels")
    while True:
        labels, before = step.select("node", "comp"), step
        near = both.join(labels, F.col("b") == F.col("node")).groupBy("a").agg(F.min("comp").alias("near"))
        own = labels.join(near, F.col("node") == F.col("a"), "left").select("node", "comp", F.least("comp", F.coalesce("near", "comp")).alias("low"))
        jump = labels.select(F.col("node").alias("n"), F.col("comp").alias("next"))
        step = common.materialise(own.join(jump, F.col("low") == F.col("n"), "left").select("node", F.col("comp").alias("old"), F.least("low", F.coalesce("next", "low")).alias("comp")), "labels")
        common.discard(before)
        if step.where("old <> comp").isEmpty():
            common.discard(both)
            return step.select("node", "comp")


def _labelled(tiles: DataFrame, labels: DataFrame | None) -> DataFrame:
    """The tiles with their sets' components; with labels, only tiles of several components."""
    if labels is None:
        return tiles.withColumn("comp", F.col("rep"))
    out = tiles.join(labels, F.col("rep") == F.col("node"), "left").withColumn("comp", F.coalesce("comp", "rep")).drop("node")
    mixed = out.groupBy("tile").agg(F.min("comp").alias("low"), F.max("comp").alias("high")).where("low <> high").select("tile")
    return common.materialise(out.join(mixed, "tile", "left_semi"), "mixed-tiles")


def _blocks(size: str) -> Column:
    return F.ceil(F.col(size) / TILE_MEMBERS).cast("int")


def _salted(of: DataFrame) -> DataFrame:
    """All rows of a tile, in blocks."""
    salt = F.pmod(F.xxhash64("rep"), _blocks("size"))
    return of.select(F.xxhash64("tile", salt).alias("tile"), "rep", "comp", F.lit(False).alias("home"), F.lit(False).alias("probe"))


def _one_each(of: DataFrame) -> DataFrame:
    """One set of each component of a tile, in blocks."""
    least = of.groupBy("tile", "comp").agg(F.min("rep").alias("rep"))
    return _salted(least.join(least.groupBy("tile").agg(F.count(F.lit(1)).alias("size")), "tile"))


def _crossing(of: DataFrame) -> DataFrame:
    """The sets outside a tile's largest component against all its members: blocks of the ones with blocks of the others."""
    sizes = of.groupBy("tile", "comp").agg(F.count(F.lit(1)).alias("n"))
    best = sizes.groupBy("tile").agg(F.max_by("comp", F.struct("n", "comp")).alias("main"), F.sum("n").alias("all"), (F.sum("n") - F.max("n")).alias("outside"))
    marked = of.join(best, "tile").withColumn("home", F.col("comp") != F.col("main"))
    own = lambda blocks: F.pmod(F.xxhash64("rep"), _blocks(blocks)).cast("int")
    each = lambda blocks: F.explode(F.sequence(F.lit(0), _blocks(blocks) - 1))
    probes = marked.where("home").withColumn("i", own("outside")).withColumn("j", each("all")).withColumn("probe", F.lit(True))
    members = marked.withColumn("j", own("all")).withColumn("i", each("outside")).withColumn("probe", F.lit(False))
    return probes.unionByName(members).select(F.xxhash64("tile", "i", "j").alias("tile"), "rep", "comp", "home", "probe")


def _with_bands(members: DataFrame, shared: DataFrame) -> DataFrame:
    """rep, class, spare, key: the sets' bands that a bounded Bloom filter holds for shared ones, so that most bands,
    which are of one set alone, are not shuffled again; with too many for the filter all of them."""
    made = _filter_of(shared.select(F.col("key").alias("id")), max(1, shared.count()))
    if made is None:
        return members.select("rep", "class", F.col("own.spare").alias("spare"), F.explode("own.keys").alias("key"))
    held = members.sparkSession.sparkContext.broadcast(made)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits, packed = held.value
        wanted = np.unpackbits(np.frombuffer(packed, np.uint8)).astype(bool)
        for batch in batches:
            keys = batch.column("keys")
            flat, of = keys.flatten().to_numpy(zero_copy_only=False), np.repeat(np.arange(batch.num_rows), np.diff(keys.offsets.to_numpy()))
            hit = wanted[_place(flat, bits)]
            rows = pa.array(of[hit])
            yield pa.RecordBatch.from_arrays([*(batch.column(c).take(rows) for c in ("rep", "class", "spare")), pa.array(flat[hit], pa.int64())], names=["rep", "class", "spare", "key"])

    return members.select("rep", "class", "own.spare", "own.keys").mapInArrow(run, "rep long, class int, spare int, key long")


def _tiles(docs: DataFrame, k: int, percent: int, id_col: str, text_col: str) -> DataFrame:
    """tile, rep, size: the sets that meet in a tile, one for each content, for tiles of two sets or more.

    Bands and tiles are counted by aggregation, which combines before the shuffle, and the counts joined back: a band
    that very many sets share is a skewed join, which Spark splits, and no window in one task."""
    made = tile_keys(docs, k, percent, id_col, text_col)
    members = made.groupBy("h1", "h2", "n_shingles", "class").agg(F.min("doc_id").alias("rep"), F.first(F.struct("spare", "keys")).alias("own"))
    members = common.materialise(members.select("rep", "class", "own"), "bands")
    each = members.select("rep", F.explode("own.keys").alias("key"))
    shared = each.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64("rep")).alias("x"), F.min("rep").alias("low")).where("n > 1")
    shared = common.materialise(shared, "shared-bands")
    rows = _with_bands(members, shared)
    counted = rows.join(shared, "key")
    # A set leaves out its most frequent bands. Bands of one set alone are the rarest, and of no use.
    frequent = Window.partitionBy("rep", "class").orderBy(F.desc("n"), F.desc("key"))
    kept = counted.withColumn("place", F.row_number().over(frequent)).where("place > spare")
    met = kept.select(F.xxhash64("n", "x", "low").alias("tile"), "rep").distinct()  # bands with the same sets are one tile
    sizes = met.groupBy("tile").agg(F.count(F.lit(1)).alias("size")).where("size > 1")
    tiles = common.materialise(met.join(sizes, "tile"), "tiles")
    common.discard(members)
    common.discard(shared)
    return tiles


def similar(docs: DataFrame, k: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_shingles and component_id, the smallest identifier that links of Jaccard >= percent/100 reach.

    Sets of one content are one class, kept by its smallest identifier. Null and empty texts have no shingles and
    link with nothing: their component is their own identifier. Rows with a null identifier link with nothing
    either and keep a null component. Repeated rows give repeated result rows. Rows that share an identifier but not
    the text are each in the component of their own text; if the identifier is the smallest with both texts, the
    links of both are its. Other columns are not read; an empty table gives no row. Sets are compared by 64-bit
    shingle hashes."""
    sigs = common.materialise(signatures(docs, k, id_col, text_col), "signatures")
    key = ["h1", "h2", "n_shingles"]
    reps = common.materialise(sigs.where("n_shingles > 0 and doc_id is not null").groupBy(*key).agg(F.min("doc_id").alias("rep"), F.first(F.struct("point", "fine", "bits")).alias("p")), "classes")
    tiles = _tiles(docs, k, percent, id_col, text_col)
    met_reps = tiles.select("rep").distinct()
    points = common.materialise(reps.join(met_reps, "rep", "left_semi").select("rep", "p.point", "p.fine", "p.bits").distinct(), "points")
    edges: DataFrame | None = None
    labels: DataFrame | None = None
    for choose, cross in ((_salted, False), (_one_each, False), (_crossing, True)):
        mixed = _labelled(tiles, labels)
        rows = choose(mixed).join(points.select("rep", "point", "bits"), "rep")
        pairs = common.materialise(_pairs(rows, percent, cross), "pairs")
        if labels is not None:
            common.discard(mixed)
        if pairs.isEmpty():
            continue
        close = common.materialise(refine(pairs, points.select(F.col("rep").alias("id"), F.col("fine").alias("data")), percent), "close-pairs")
        common.discard(pairs)
        if close.isEmpty():
            continue
        found = common.materialise(verify(docs, close, k, percent, id_col, text_col), "links")
        common.discard(close)
        edges = found if edges is None else edges.unionByName(found)
        labels = components(edges)
    common.discard(tiles)
    common.discard(points)
    classes = reps.select(*key, "rep")
    if labels is not None:
        classes = classes.join(labels, F.col("rep") == F.col("node"), "left").select(*key, F.coalesce("comp", "rep").alias("component_id"))
    else:
        classes = classes.withColumnRenamed("rep", "component_id")
    joined = sigs.select("doc_id", *key).join(classes, key, "left")
    return joined.select("doc_id", "n_shingles", F.when(F.col("doc_id").isNull(), F.lit(None)).otherwise(F.coalesce("component_id", "doc_id")).cast("long").alias("component_id"))


def keep_one(docs: DataFrame, found: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Of each component in found (of similar()) the rows of its smallest identifier, one of those that repeat its
    text (the least by the other columns that have an order); rows without identifier stay. Different texts under one
    identifier all stay, unless all of them have a smaller identifier in their components.

    Only rows that a bounded Bloom filter holds for removed or repeated go through the exact join; the others, most
    as a rule, are not shuffled. With too many for the filter, all rows go through the join."""
    found = common.materialise(found.select("doc_id", "component_id"), "components")
    counts = found.where("doc_id is not null").groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"), F.max("component_id").alias("c"))
    marked = common.materialise(counts.where("n > 1 or c <> doc_id").select(F.col("doc_id").alias("id"), (F.col("c") != F.col("doc_id")).alias("gone")), "marked")
    made = _filter_of(marked.select("id"), max(1, marked.count()))
    shared = docs.sparkSession.sparkContext.broadcast(made)

    def part(wanted: bool):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held = np.unpackbits(np.frombuffer(shared.value[1], np.uint8)).astype(bool) if shared.value else None
            for batch in batches:
                ids = batch.column(id_col)
                hit = ids.is_valid().to_numpy(zero_copy_only=False)
                if held is not None:
                    hit = hit & held[_place(ids.fill_null(0).to_numpy(zero_copy_only=False), shared.value[0])]
                yield batch.filter(pa.array(hit == wanted))

        return docs.mapInArrow(run, docs.schema)

    ordered = [f.name for f in docs.schema.fields if f.name not in (id_col, text_col) and isinstance(f.dataType, AtomicType)]
    same = Window.partitionBy(id_col, text_col).orderBy(*(ordered or [id_col]))
    stay = part(True).join(marked.where("gone").select(F.col("id").alias(id_col)), id_col, "left_anti").select(*docs.columns)
    place = "_place_" + uuid.uuid4().hex
    return part(False).unionByName(stay.withColumn(place, F.row_number().over(same)).where(F.col(place) == 1).drop(place))
