"""Toxicity by a linear-chain conditional random field over tokens, two states: clean and toxic.

Labels mark documents; tokens are labelled from them: a token of a toxic document is toxic if one of its features
(word, prefixes, suffix) goes with toxic documents far beyond chance. The field learns from those tokens.
Forward-backward marginals give offending spans, and through a logistic fit the document's score.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

#: Bounds of the training sample: labelled documents, and characters of one of them.
TRAIN_DOCS, TRAIN_CHARS = 2500, 20_000
BUCKETS, MIN_G2, MIN_DOCS = 1 << 18, 20.0, 4
ROUNDS, RATE, PENALTY, CLIP = 40, 0.5, 1e-3, 25.0
CACHE_WORDS = 200_000
EDGE = re.compile(r"^[\W_]+|[\W_]+$")
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def features(word: str) -> list[int]:
    """Hashed features of a lower-case word without punctuation at its ends."""
    core = EDGE.sub("", word)
    found = [f"w{core}", *[f"{n}{core[:n]}" for n in (4, 5, 6) if len(core) >= n], *([f"s{core[-4:]}"] if len(core) >= 4 else [])]
    return [zlib.crc32(x.encode("utf-8", "surrogatepass")) & (BUCKETS - 1) for x in found]


def feature_table(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(owner, feature) of all features of all words."""
    lists = [features(w) for w in words]
    sizes = np.fromiter(map(len, lists), np.int64, len(lists))
    return np.repeat(np.arange(len(lists)), sizes), np.fromiter((f for x in lists for f in x), np.int64, int(sizes.sum()))


@dataclass
class Field:
    """Weights of the toxic state by feature, its bias, log transition and start scores, and the document fit."""

    weights: np.ndarray = field(default_factory=lambda: np.zeros(BUCKETS))
    bias: float = -3.0
    trans: np.ndarray = field(default_factory=lambda: np.zeros((2, 2)))
    start: np.ndarray = field(default_factory=lambda: np.zeros(2))
    fit: tuple[float, float, float] = (-2.0, 1.0, 0.0)

    def emissions(self, words: list[str]) -> np.ndarray:
        owner, feature = feature_table(words)
        return np.clip(self.bias + np.bincount(owner, self.weights[feature], minlength=len(words)), -CLIP, CLIP)

    def score(self, peak: np.ndarray, total: np.ndarray) -> np.ndarray:
        a, b, c = self.fit
        return 1 / (1 + np.exp(-np.clip(a + b * _logit(peak) + c * np.log1p(total), -30, 30)))


def _logit(p: np.ndarray) -> np.ndarray:
    p = np.clip(p, 1e-5, 1 - 1e-5)
    return np.log(p / (1 - p))


def _steps(emission: np.ndarray, first: np.ndarray, model: Field) -> np.ndarray:
    """The chain's 2 x 2 factors; one that starts a document does not depend on the state before it."""
    m = np.empty((len(emission), 2, 2))
    m[:] = np.exp(model.trans)
    m[first] = np.exp(model.start)[None, None, :]
    m[:, :, 1] *= np.exp(emission)[:, None]
    return m / m.max(axis=(1, 2), keepdims=True)


def marginals(emission: np.ndarray, first: np.ndarray, model: Field, edges: bool = False) -> tuple[np.ndarray, np.ndarray | None]:
    """Probability of the toxic state at each token (and of each pair of states), documents one after the other.

    All documents are one chain, cut into segments of equal length: the segments' products give the states
    between them, and all segments are then worked through at once, position by position."""
    n = len(emission)
    if not n:
        return np.zeros(0), None
    width = max(1, int(np.sqrt(n)))
    rows = -(-n // width)
    m = np.empty((rows * width, 2, 2))
    m[:n] = _steps(emission, first, model)
    m[n:] = np.eye(2)
    m = m.reshape(rows, width, 2, 2)
    product = np.broadcast_to(np.eye(2), (rows, 2, 2)).copy()
    for j in range(width):
        product = product @ m[:, j]
        product /= product.max(axis=(1, 2), keepdims=True)
    entry, exit_ = np.empty((rows, 2)), np.empty((rows, 2))
    a, b = np.full(2, 0.5), np.full(2, 0.5)
    for r in range(rows):
        entry[r] = a
        a = a @ product[r]
        a = a / a.sum()
    for r in range(rows - 1, -1, -1):
        exit_[r] = b
        b = product[r] @ b
        b = b / b.sum()
    alpha, beta = np.empty((rows, width, 2)), np.empty((rows, width, 2))
    state = entry
    for j in range(width):
        state = np.einsum("ra,rab->rb", state, m[:, j])
        state = state / state.sum(1, keepdims=True)
        alpha[:, j] = state
    state = exit_
    for j in range(width - 1, -1, -1):
        beta[:, j] = state
        state = np.einsum("rab,rb->ra", m[:, j], state)
        state = state / state.sum(1, keepdims=True)
    both = alpha * beta
    p = (both[..., 1] / both.sum(-1)).reshape(-1)[:n]
    if not edges:
        return p, None
    flat_alpha = alpha.reshape(-1, 2)
    before = np.vstack((entry[:1], flat_alpha[:-1]))[:n]
    pair = before[:, :, None] * m.reshape(-1, 2, 2)[:n] * beta.reshape(-1, 2)[:n][:, None, :]
    return p, pair / pair.sum(axis=(1, 2), keepdims=True)


def token_labels(owner: np.ndarray, feature: np.ndarray, index: np.ndarray, doc_of: np.ndarray, toxic: np.ndarray) -> np.ndarray:
    """Tokens of toxic documents with a feature whose document counts deviate from chance (G2 test)."""
    n_docs, n_toxic = len(toxic), int(toxic.sum())
    seen = np.unique(doc_of * np.int64(len(np.bincount(owner)) + 1) + index)
    words, docs = seen % (len(np.bincount(owner)) + 1), seen // (len(np.bincount(owner)) + 1)
    starts = np.searchsorted(owner, np.arange(owner.max() + 2 if len(owner) else 1))
    sizes = np.diff(starts)[words]
    f, d = feature[common.segments(starts[:-1][words], sizes)], np.repeat(docs, sizes)
    pairs = np.unique(d * np.int64(BUCKETS) + f)
    d, f = pairs // BUCKETS, pairs % BUCKETS
    df = np.bincount(f, minlength=BUCKETS).astype(float)
    t = np.bincount(f, toxic[d], minlength=BUCKETS)
    rate = max(n_toxic, 0.5) / max(n_docs, 1)
    c = df - t
    with np.errstate(divide="ignore", invalid="ignore"):
        g2 = 2 * (np.where(t > 0, t * np.log(t / (df * rate)), 0) + np.where(c > 0, c * np.log(c / (df * max(1 - rate, 1e-9))), 0))
    strong = (g2 >= MIN_G2) & (t >= MIN_DOCS) & (t >= 0.7 * df) & (t > df * rate)
    bad_word = np.zeros(int(owner.max()) + 1 if len(owner) else 1, bool)
    bad_word[owner[strong[feature]]] = True
    return bad_word[index] & (toxic[doc_of] > 0)


def train(texts: pa.Array, toxic: np.ndarray) -> Field:
    """Fits the field on two thirds of the documents and the document score on the others (on all, if few)."""
    model = Field()
    if not len(toxic):
        return model
    offsets, index, distinct = common.split_words(texts, lower=True)
    words = distinct.to_pylist()
    owner, feature = feature_table(words)
    doc_of = np.repeat(np.arange(len(toxic)), np.diff(offsets))
    first = np.zeros(len(index), bool)
    first[offsets[:-1][np.diff(offsets) > 0]] = True
    held = np.arange(len(toxic)) % 3 == 2 if toxic.sum() >= 30 else np.zeros(len(toxic), bool)
    if not len(index):
        return model
    y = token_labels(owner, feature, index, np.where(held[doc_of], 0, doc_of), np.where(held, 0, toxic)) if not held.any() else None
    if y is None:
        keep = ~held[doc_of]
        y = np.zeros(len(index), bool)
        renumber = np.cumsum(~held) - 1
        y[keep] = token_labels(owner, feature, index[keep], renumber[doc_of[keep]], toxic[~held])
    fit_on = ~held[doc_of]
    at, own_first, own_y = index[fit_on], first[fit_on], y[fit_on].astype(float)

    squares = np.full(BUCKETS, 1e-6)
    other = np.full(7, 1e-6)
    inner = ~own_first
    before = np.r_[0.0, own_y[:-1]]
    want = np.array([[((1 - before) * (1 - own_y))[inner].sum(), ((1 - before) * own_y)[inner].sum()], [(before * (1 - own_y))[inner].sum(), (before * own_y)[inner].sum()]])
    want_start = np.array([(1 - own_y)[own_first].sum(), own_y[own_first].sum()])
    scale = max(1.0, own_y.sum())
    for _ in range(ROUNDS):
        emission = np.clip(model.bias + np.bincount(owner, model.weights[feature], minlength=len(words)), -CLIP, CLIP)
        p, pair = marginals(emission[at], own_first, model, edges=True)
        by_word = np.bincount(at, p - own_y, minlength=len(words))
        g = np.bincount(feature, by_word[owner], minlength=BUCKETS) / scale + PENALTY * model.weights
        squares += g * g
        model.weights -= RATE * g / np.sqrt(squares)
        got, got_start = pair[inner].sum(0), pair[own_first].sum((0, 1)) if own_first.any() else np.zeros(2)
        rest = np.r_[by_word.sum(), (got - want).ravel(), got_start - want_start] / scale
        rest = rest + PENALTY * np.r_[model.bias, model.trans.ravel(), model.start]
        other += rest * rest
        move = RATE * rest / np.sqrt(other)
        model.bias -= move[0]
        model.trans = model.trans - move[1:5].reshape(2, 2)
        model.start = model.start - move[5:7]
    p, _ = marginals(model.emissions(words)[index], first, model)
    peak, total = document_sums(p, offsets)
    on = held if held.any() and 0 < toxic[held].sum() < held.sum() else np.ones(len(toxic), bool)
    x = np.column_stack((np.ones(int(on.sum())), _logit(peak[on]), np.log1p(total[on])))
    theta = np.array(model.fit)
    for _ in range(50):  # Newton steps of a penalised logistic regression
        q = 1 / (1 + np.exp(-np.clip(x @ theta, -30, 30)))
        h = (x * (q * (1 - q))[:, None]).T @ x + 0.1 * np.eye(3)
        theta = theta - np.clip(np.linalg.solve(h, x.T @ (q - toxic[on]) + 0.1 * (theta - np.array(model.fit))), -1, 1)
    model.fit = tuple(float(v) for v in theta)
    return model


def document_sums(p: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Highest and summed toxic probability of each document, 0 without tokens."""
    peak = np.zeros(len(offsets) - 1)
    full = np.diff(offsets) > 0
    if full.any():
        peak[full] = np.maximum.reduceat(p, offsets[:-1][full])
    sums = np.r_[0.0, np.cumsum(p)]
    return peak, np.maximum(0.0, sums[offsets[1:]] - sums[offsets[:-1]])


class Scorer:
    """A worker's field, with the emissions of words it has met."""

    def __init__(self, model: Field):
        self.model, self.known = model, {}

    def __call__(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(scores, token probabilities, offsets of the documents' tokens)."""
        offsets, index, distinct = common.split_words(texts, lower=True)
        words = distinct.to_pylist()
        if len(self.known) + len(words) > CACHE_WORDS:
            self.known.clear()
        new = [w for w in words if w not in self.known]
        self.known.update(zip(new, self.model.emissions(new).tolist(), strict=True))
        emission = np.fromiter((self.known[w] for w in words), float, len(words))[index]
        first = np.zeros(len(index), bool)
        first[offsets[:-1][np.diff(offsets) > 0]] = True
        p, _ = marginals(emission, first, self.model)
        return self.model.score(*document_sums(p, offsets)), p, offsets


def sample_and_train(docs: DataFrame, labels: DataFrame, learn_from, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", train_docs: int = TRAIN_DOCS, train_chars: int = TRAIN_CHARS) -> Field:
    """Trains on at most train_docs labelled documents of at most train_chars characters, the first by a hash of
    their identifier among the rows that learn_from (a Column over doc_id) admits. Rows with a null label, text or
    identifier are not learned from; a document with several labels counts by the highest, of several texts under one
    identifier the one with the least hash."""
    y = labels.select(F.col(id_col).cast("long").alias("doc_id"), F.col(label_col).alias("y")).where(learn_from & F.col("y").isNotNull())
    y = y.groupBy("doc_id").agg(F.max(F.col("y")).cast("int").alias("y"))
    x = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).where(F.col("text").isNotNull() & learn_from & (F.length("text") <= train_chars))
    ids = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.length(text_col).alias("n")).where(F.col("n") <= train_chars).select("doc_id").distinct()
    picked = y.join(ids, "doc_id").orderBy(F.xxhash64("doc_id"), "doc_id").limit(train_docs)
    chosen = {r.doc_id: r.y for r in picked.collect()}
    wanted = F.broadcast(docs.sparkSession.createDataFrame(list(chosen.items()), "doc_id long, y int"))  # at most train_docs rows
    rows = x.join(wanted, "doc_id").groupBy("doc_id", "y").agg(F.min_by("text", F.struct(F.xxhash64("text"), "text")).alias("text")).orderBy("doc_id").toArrow()
    return train(rows.column("text").combine_chunks(), rows.column("y").to_numpy().astype(float))


def score(docs: DataFrame, model: Field, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.3) -> DataFrame:
    """doc_id, score, predicted, and the offending spans (begin and end in characters, highest probability).

    Every whole text is scored; a null or empty one has no tokens and gets the fit's base value. One row per
    input row, repeated rows and null identifiers included; other columns are not read."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    span = pa.list_(pa.struct([("begin", pa.int32()), ("end", pa.int32()), ("p", pa.float64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(shared.value)
        for batch in common.chunks(batches, "text"):
            texts = batch.column("text")
            scores, p, offsets = scorer(texts)
            spans = [_spans(texts[i].as_py(), p[offsets[i] : offsets[i + 1]]) if s >= threshold else [] for i, s in enumerate(scores)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(scores), pa.array((scores >= threshold).astype(np.int32)), pa.array(spans, span)], names=["doc_id", "score", "predicted", "spans"])

    return rows.mapInArrow(run, "doc_id long, score double, predicted int, spans array<struct<begin: int, end: int, p: double>>")


def _spans(text: str, p: np.ndarray) -> list[dict]:
    """Runs of tokens that are toxic with more than even odds."""
    out: list[dict] = []
    last = -2
    for i, m in enumerate(WORD.finditer(text)):
        if p[i] > 0.5:
            if last == i - 1:
                out[-1] |= {"end": m.end(), "p": max(out[-1]["p"], float(p[i]))}
            else:
                out.append({"begin": m.start(), "end": m.end(), "p": float(p[i])})
            last = i
    return out


def keep_clean(docs: DataFrame, model: Field, text_col: str = "text", threshold: float = 0.3) -> DataFrame:
    """The rows of docs that score below the threshold, with all their columns."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(shared.value)
        for batch in common.chunks(batches, text_col):
            yield batch.filter(pa.array(scorer(batch.column(text_col).cast(pa.string()))[0] < threshold))

    return docs.mapInArrow(run, docs.schema)
