import datetime as dt  # noqa: F401
import hashlib
import math
import os
import random
import zlib

import brute
import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
from compare import SF, assert_same
from pyspark.sql import functions as F

from quantloom.llm import bpe, common, html_text, jaccard, katz, packing, quality, queries, roles, sstable, topk, toxicity, word_ids

os.environ["TOKENIZERS_PARALLELISM"] = "false"


def tokenizer(name):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(word_ids.vocabulary_path(name))


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_equals_sql(spark, duck, name):
    assert_same(queries.QUERIES[name](spark, SF), duck, queries.ORACLE_SQL[name])


# 1: top-k


def best_of(rows, k):
    out = {}
    for q, qv in rows:
        if q % 5:
            continue
        scores = sorted({(-sum(a * b for a, b in zip(qv, v)), i) for i, v in rows if i != q})[:k]
        out[q] = [(i, -s) for s, i in scores]
    return out


def test_top_k_matches_brute_force(spark):
    r = random.Random(1)
    vectors = [(i, [r.gauss(0, 1) for _ in range(8)]) for i in range(300)] + [(i, [0.5] * 8) for i in range(300, 340)]
    whole = [(i, [math.floor(1024 * x) for x in v]) for i, v in vectors]
    odd = [(1000, None), (1001, [float("nan")] * 8), (1002, [float("inf")] + [0.0] * 7), (None, [1.0] * 8), (5, None), (7, vectors[7][1])]
    df = spark.createDataFrame([(i, v, "x") for i, v in [*vectors, *odd]], "vec_id long, embedding array<double>, score string")
    got = {}
    for x in topk.top_k(df, F.col("vec_id") % 5 == 0, k=10).orderBy("query_id", "rank").collect():
        got.setdefault(x.query_id, []).append((x.vec_id, x.score))
    assert got == best_of(whole, 10)


def test_top_k_small_and_empty(spark):
    empty = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert topk.top_k(empty, F.col("vec_id") % 100 == 0).count() == 0
    two = spark.createDataFrame([(0, [1.0]), (1, [2.0, 3.0])], "vec_id long, embedding array<float>")
    assert [(r.query_id, r.vec_id, r.score) for r in topk.top_k(two, F.col("vec_id") == 0).collect()] == [(0, 1, 1024 * 2048)]


def test_top_k_bounds_exclude_most_of_clustered_vectors(spark, monkeypatch):
    """Vectors in clusters far from each other: most are never evaluated; many identical ones; several blocks of queries."""
    monkeypatch.setattr(topk, "VECTOR_BLOCK", 300)
    r = random.Random(21)
    centres = [[r.gauss(0, 3) for _ in range(6)] for _ in range(12)]
    vectors = [(i, [c + r.gauss(0, 0.02) for c in centres[i % 12]]) for i in range(1500)] + [(i, centres[0]) for i in range(1500, 1600)]
    df = spark.createDataFrame([(i, v) for i, v in vectors], "vec_id long, embedding array<double>")
    rows = topk.top_k(df, F.col("vec_id") % 5 == 0, k=10).orderBy("query_id", "rank").collect()
    got = {}
    for x in rows:
        got.setdefault(x.query_id, []).append((x.vec_id, x.score))
    assert got == best_of([(i, [math.floor(1024 * x) for x in v]) for i, v in vectors], 10)
    assert sum(x.evaluated for x in rows if x.rank == 1) < 0.5 * len(got) * len(vectors)


# 2: Katz


def katz_rows(spark, rows, order):
    df = spark.createDataFrame([(i, t, 1.0) for i, t in rows], "doc_id long, text string, score double").repartition(3)
    return katz.katz_scores(df, common.crc32_mod("doc_id", 5) != 1, order=order).collect()


def assert_katz(got, rows, order):
    """The same results, rows of one identifier in any order."""
    want, p, known = brute.katz(rows, order=order)
    plain = lambda i, x: (i is None, i or 0, x[0], x[1], x[2], x[3], round(x[4], 7), round(x[5], 7))
    mine = sorted(plain(g.doc_id, (g.held_out, g.n_tokens, g.n_known, g.train_tokens, g.base_score, g.score)) for g in got)
    theirs = sorted(plain(i, x) for (i, _), x in zip(rows, want, strict=True))
    assert len(mine) == len(theirs)
    for a, b in zip(mine, theirs, strict=True):
        assert a[:6] == b[:6] and a[6:] == pytest.approx(b[6:])
    return p, known


@pytest.mark.parametrize("order", [2, 3, 4])
@pytest.mark.parametrize("small", [False, True])
def test_katz_matches_brute_force(spark, texts, small, order, monkeypatch):
    """Small limits: many blocks, buckets and ranges, and frequent words (the start too) with buckets of their own."""
    if small:
        monkeypatch.setattr(katz, "BUCKET_TOKENS", 60)
        monkeypatch.setattr(katz, "RANGE_KEYS", 40)
    rows = [*enumerate(texts), (3, "one lo ka"), (None, texts[12]), (None, None), (4, texts[13]), (4, texts[13])]
    p, known = assert_katz(katz_rows(spark, rows, order), rows, order)
    for h in [("loka",), (("start",),), ("never",), ("loka", "rari"), (("start",), ("start",)), ("two", "words")]:
        if len(h) < order:
            assert sum(p(h, w) for w in known) + p(h, "unknown word") == pytest.approx(1.0)


def test_katz_blocks_of_many_batches(texts, monkeypatch):
    """A block holds several batches; a text longer than a block is one by itself."""
    import pyarrow as pa

    monkeypatch.setattr(katz, "BLOCK_TOKENS", 300)
    monkeypatch.setattr(katz.TaskContext, "get", staticmethod(lambda: type("T", (), {"partitionId": lambda self: 7})()))
    batches = [pa.RecordBatch.from_arrays([pa.array([i, None]), pa.array([t or "", "a b"]), pa.array([True, False])], names=["doc_id", "text", "train"]) for i, t in enumerate(texts)]
    blocks = [b.to_pylist()[0] for b in katz._blocks(iter(batches))]
    assert [b["part"] for b in blocks] == [(7 << 32) + i for i in range(len(blocks))] and len(blocks) > 3
    sizes, ids = [], []
    for b in blocks:
        words, learned, every = katz.load(b["words"])
        tokens, (own, has_id, train, n) = katz.load(b["tokens"])[0], katz.load(b["docs"])
        assert (np.diff(words.astype(object)) > 0).all() and every.sum() == len(tokens) == n.sum() == b["n_tokens"]
        assert learned.sum() == n[train].sum() and (words[tokens[np.cumsum(n) - 1]] == katz.END).all()
        sizes += n.tolist()
        ids += [int(i) if h else None for i, h in zip(own, has_id)]
    assert ids == [x for i in range(len(texts)) for x in (i, None)]
    assert sizes == [x for t in texts for x in (len(brute.words(t)) + 1, 3)]


def test_katz_edge_cases(spark, nothing):
    learn = common.crc32_mod("doc_id", 5) != 1
    assert katz.katz_scores(nothing, learn).count() == 0
    rows = [(None, "a b"), (3, None), (4, "a a a"), (4, "a a a"), (7, "x " * 50_000)]
    assert_katz(katz_rows(spark, rows, 3), rows, 3)
    none = spark.createDataFrame([(3, "a b")], "doc_id long, text string")
    r = katz.katz_scores(none, F.lit(False)).first()
    assert r.train_tokens == 0 and r.n_known == 0 and r.held_out and r.score == 0 and r.base_score == 0


# 3: quality


def test_quality_edge_cases(spark, docs, texts, nothing):
    got = {r.doc_id: r for r in quality.quality_rules(docs).collect()}
    assert len(got) == len(texts) and quality.quality_rules(nothing).count() == 0
    for i, t in enumerate(texts):
        w = brute.WORD.findall(t or "")
        windows = [tuple(w[j : j + 3]) for j in range(len(w) - 2)]
        repeated = {j + k for j, x in enumerate(windows) if windows.count(x) > 1 for k in range(3)} if len(w) < 500 else None
        assert got[i].n_words == len(w) and got[i].word_chars == sum(map(len, w))
        assert got[i].n_symbols == sum((t or "").count(c) for c in "#*$%&|<>")
        if repeated is not None:
            assert got[i].n_repeat_words == len(repeated)
    kept = quality.keep_quality(docs)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == {i for i, r in got.items() if r.kept}


def test_quality_repeated_rows(spark, docs):
    rows = lambda df: sorted(map(str, quality.quality_rules(df).collect()))
    assert rows(docs.unionByName(docs)) == sorted(rows(docs) * 2)


# 4 and 6: token ids


def test_tables_round_trip_and_lookup(spark, docs, texts, nothing, monkeypatch):
    monkeypatch.setattr(sstable, "BLOCK_BYTES", 256)
    path = common.shared_dir(spark, "sst")
    more = docs.unionByName(spark.createDataFrame([(None, "no id"), (3, "one"), (-7, "minus")], "doc_id long, text string"), allowMissingColumns=True)
    sstable.write_tables(more, path, shard_bytes=2000)
    t = tokenizer("word_bpe_49k.json")
    encode = lambda x: [*t.encode(x or "", add_special_tokens=False).ids, 1]
    rows = sorted([(i, x) for i, x in enumerate(texts)] + [(-7, "minus"), (3, "one")])
    want, start = [], len(encode("no id"))
    for i, x in sorted(rows, key=lambda r: (r[0], r[1] or "")):
        want.append((i, start, encode(x)))
        start += len(want[-1][2])
    got = [(r.doc_id, r.start, np.frombuffer(r.ids, "<u4").tolist()) for r in sstable.read_tables(spark, path).orderBy("start").collect()]
    assert got[0] == (None, 0, encode("no id")) and got[1:] == want
    assert sstable.manifest(spark, path).count() > 2
    asked = spark.createDataFrame([(5,), (-7,), (99999,), (None,)], "doc_id long")
    found = {r.doc_id: r.ids for r in sstable.lookup(asked, path).collect()}
    assert np.frombuffer(found[5], "<u4").tolist() == encode(texts[5]) and np.frombuffer(found[-7], "<u4").tolist() == encode("minus")
    assert found[99999] is None and found[None] is None
    empty = common.shared_dir(spark, "sst")
    assert sstable.write_tables(nothing, empty).count() == 0 and sstable.read_tables(spark, empty).count() == 0


def test_lookup_of_repeated_and_null_identifiers(spark):
    path = common.shared_dir(spark, "sst")
    sstable.write_tables(spark.createDataFrame([(4, "two words"), (4, "one"), (4, None), (5, "b"), (5, "a"), (None, "x")], "doc_id long, text string"), path, shard_bytes=4)
    found = sstable.lookup(spark.createDataFrame([(4,), (4,), (5,), (None,)], "doc_id long"), path).collect()
    t = tokenizer("word_bpe_49k.json")
    want = [(4, [1]), (4, [1]), (5, [*t.encode("a", add_special_tokens=False).ids, 1]), (None, None)]
    assert sorted(((r.doc_id, None if r.ids is None else np.frombuffer(r.ids, "<u4").tolist()) for r in found), key=repr) == sorted(want, key=repr)


def test_ids_of_every_letter_before_a_stop():
    import sys
    import unicodedata

    import pyarrow as pa

    t, coder = tokenizer("word_bpe_49k.json"), word_ids.WordEncoder("word_bpe_49k.json")
    letters = [c for c in map(chr, range(sys.maxunicode + 1)) if unicodedata.category(c)[0] == "L"]
    for at in range(0, len(letters), 20_000):
        texts = [f"a{c} {c}b. {c}, x{c}." for c in letters[at : at + 20_000]]
        offsets, ids = coder.encode(pa.array(texts))
        want = [e.ids for e in t.encode_batch(texts, add_special_tokens=False)]
        assert [ids[a:b].tolist() for a, b in zip(offsets[:-1], offsets[1:])] == want


def test_a_full_word_cache_keeps_its_ids(monkeypatch):
    import pyarrow as pa

    monkeypatch.setattr(word_ids, "GENERATION_WORDS", 60)
    t, coder, r = tokenizer("word_bpe_49k.json"), word_ids.WordEncoder("word_bpe_49k.json"), random.Random(4)
    vocabulary = [f"{a}{b}{c}" for a in ("un", "re", "Pre", "x1") for b in ("kind", "do", "Über", "3") for c in ("ly", ".", ",", "s", "'s", "ing")]
    for _ in range(60):
        texts = [" ".join(r.choices(vocabulary, k=r.randrange(40))) for _ in range(3)]
        offsets, ids = coder.encode(pa.array(texts))
        assert [ids[a:b].tolist() for a, b in zip(offsets[:-1], offsets[1:])] == [t.encode(x, add_special_tokens=False).ids for x in texts]


def test_shards_are_read_in_bounded_batches(tmp_path):
    with open(tmp_path / "a.sst", "wb") as sink:
        writer = sstable.Writer(sink, 2)
        for i in range(50):
            writer.add(sstable.key_of(i), np.full(20_000, i, np.uint32))
        writer.close()
    reader = sstable.Reader(f"file://{tmp_path}/a.sst")
    made = [b.to_pylist() for b in sstable._batches(reader, 7)]
    reader.close()
    assert max(sum(r["n_tokens"] for r in rows) for rows in made) < (1 << 18) + 20_000
    assert [(r["doc_id"], r["start"], r["n_tokens"], set(np.frombuffer(r["ids"], "<u4"))) for rows in made for r in rows] == [(i, 7 + 20_000 * i, 20_000, {i}) for i in range(50)]


def test_word_variants_are_encoded_once_with_the_library_s_ids():
    from tokenizers import Tokenizer

    coder = word_ids.WordEncoder("word_bpe_49k.json")
    coder.encode(pa.array(["Word word WORD*** word!! word ", "word (word ) "]))
    assert set(coder.new.place) == {"word", "***", "!!", "(word", ")"}
    texts = ["J\u030c j\u030c T\u0308x A*** b", "<|ENDOFTEXT|> a", "a<|endoftext|> B", "endoftext|> X's DON'T.' \u0130. \u0130\u0307!! ", None, "", "Aa." * 40 + " "]
    library = Tokenizer.from_file(word_ids.vocabulary_path("word_bpe_49k.json"))
    offsets, ids = coder.encode(pa.array(texts))
    assert [ids[a:b].tolist() for a, b in zip(offsets[:-1], offsets[1:], strict=True)] == [library.encode(t or "", add_special_tokens=False).ids for t in texts]


def test_packing_is_whole_gapless_and_tight(spark, docs, texts, nothing):
    size = 64
    t = tokenizer("word_bpe_49k.json")
    rows = packing.pack(docs, size=size).collect()
    brute.pieces_fit([(r.sequence_id, r.offset, r.length) for r in rows], size)
    by = {}
    for r in rows:
        by.setdefault(r.doc_id, []).append(r)
    total = 0
    for i, x in enumerate(texts):
        ids = np.array([*t.encode(x or "", add_special_tokens=False).ids, 0], "<u4")
        total += len(ids)
        cuts = [(p, at, min(size, len(ids) - at), zlib.crc32(ids[at : at + size].tobytes())) for p, at in enumerate(range(0, len(ids), size))]
        assert sorted((r.piece, r.start, r.length, r.ids_crc32) for r in by[i]) == cuts
    assert len({r.sequence_id for r in rows}) <= -(-total // size) + 2
    assert packing.pack(nothing).count() == 0


def test_packing_null_and_repeated_identifiers(spark):
    rows = [(None, "a b"), (None, "a b"), (1, "lo ka"), (1, "lo ka"), (1, "ri"), (2, None)]
    got = packing.pack(spark.createDataFrame(rows, "doc_id long, text string"), size=8).collect()
    brute.pieces_fit([(r.sequence_id, r.offset, r.length) for r in got], 8)
    t = tokenizer("word_bpe_49k.json")
    want = sorted((str(i), len(t.encode(x or "", add_special_tokens=False).ids) + 1) for i, x in rows)
    assert sorted((str(r.doc_id), r.length) for r in got) == want


def test_best_fit_takes_the_tightest_bin():
    r = random.Random(3)
    for _ in range(30):
        lengths = np.array([r.randint(1, 50) for _ in range(80)])
        bins, offsets = packing.pack_lengths(lengths, 50)
        room = []
        for i in np.argsort(-lengths, kind="stable"):
            fits = [c for c in room if c >= lengths[i]]
            c = min(fits) if fits else 50
            if fits:
                room.remove(c)
            assert offsets[i] == 50 - c
            room.append(c - lengths[i])


# 5: Jaccard join


@pytest.mark.parametrize("k,percent", [(3, 90), (5, 80)])
def test_similar_matches_brute_force(spark, docs, texts, nothing, k, percent, monkeypatch):
    monkeypatch.setattr(jaccard, "TILE_MEMBERS", 3)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.similar(docs, k, percent).collect()}
    assert got == brute.components(list(enumerate(texts)), k, percent)
    assert jaccard.similar(nothing, k, percent).count() == 0


def test_similar_on_chains(spark):
    """Copies that drift, so that the ends of a chain do not link: many candidates, several components."""
    r = random.Random(9)
    w = [f"w{i}" for i in range(200)]
    rows = []
    for c in range(4):
        own = [f"{x}c{c}" for x in w]
        for i in range(25):
            rows.append((c * 100 + i, " ".join(own)))
            for _ in range(3 if c % 2 else 1):
                own[r.randrange(len(own))] = f"n{r.random()}"
    got = {x.doc_id: (x.n_shingles, x.component_id) for x in jaccard.similar(spark.createDataFrame(rows, "doc_id long, text string"), 3, 90).collect()}
    assert got == brute.components(rows, 3, 90)


@pytest.mark.parametrize("percent", [80, 90])
def test_tiles_meet_every_linked_pair(percent):
    """Small sets, so that many bands are empty and some sets have fewer full ones than they need; frequencies at
    random, as the order in which sets leave bands out is free."""
    r, bands = np.random.default_rng(percent), jaccard.Bands(percent)
    short = linked = 0
    for _ in range(3000):
        n = int(r.integers(1, 61))
        a = r.integers(0, 1 << 63, n).astype(np.uint64)
        cut, grown = int(r.integers(0, n // 4 + 1)), int(r.integers(0, n // 4 + 1))
        b = np.concatenate((a[cut:], r.integers(0, 1 << 63, grown).astype(np.uint64)))
        a, b = np.unique(a), np.unique(b)
        both = len(np.intersect1d(a, b))
        if 100 * both < percent * (len(a) + len(b) - both):
            continue
        linked += 1
        weight = lambda key: hash((int(key), n)) % 5  # noqa: E731, B023
        left = []
        for s in (a, b):
            kept = set()
            for c, spare, keys in bands.keys(s):
                short += spare == 0
                kept |= {(c, int(x)) for x in sorted(keys, key=lambda x: (-weight(x), -int(x)))[spare:]}
            left.append(kept)
        assert left[0] & left[1]
    assert linked > 500 and short > 0


def test_similar_small_sets_match_brute_force(spark):
    r = random.Random(12)
    rows = []
    for i in range(60):
        own = [f"s{i}w{j}" for j in range(r.randrange(1, 64))]
        for v in range(5):
            t = list(own)
            for _ in range(r.randrange(0, 3)):
                t[r.randrange(len(t))] = f"n{i}x{v}x{r.random()}"
            rows.append((len(rows), " ".join(t)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for k, percent in ((3, 90), (5, 80), (1, 80)):
        got = {x.doc_id: (x.n_shingles, x.component_id) for x in jaccard.similar(df, k, percent).collect()}
        assert got == brute.components(rows, k, percent)


def test_similar_one_passage_in_many_texts(spark, monkeypatch):
    """Unrelated texts that share half of their words: no links but those of copies, and blocks of a tile all meet."""
    monkeypatch.setattr(jaccard, "TILE_MEMBERS", 4)
    monkeypatch.setattr(jaccard, "STAR", 3)
    passage = " ".join(f"p{i}" for i in range(40))
    rows = [(i, f"{passage} " + " ".join(f"t{i // 2}w{j}" for j in range(36)) + f" end{i}") for i in range(60)]
    got = {x.doc_id: x.component_id for x in jaccard.similar(spark.createDataFrame(rows, "doc_id long, text string"), 5, 80).collect()}
    assert got == {i: i // 2 * 2 for i in range(60)}


def test_similar_beyond_the_filter(spark, docs, texts, monkeypatch):
    monkeypatch.setattr(jaccard, "MAX_FILTER_BITS", 1)
    found = jaccard.similar(docs, 3, 90)
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in found.collect()} == brute.components(list(enumerate(texts)), 3, 90)
    assert {r.doc_id for r in jaccard.keep_one(docs, found).collect()} == {r.doc_id for r in found.collect() if r.doc_id == r.component_id}


def test_similar_null_and_repeated_rows(spark):
    rows = [(None, "a b c d"), (1, "a b c d"), (1, "a b c d"), (2, "a b c d"), (3, None)]
    got = sorted((x.doc_id or 0, x.component_id) for x in jaccard.similar(spark.createDataFrame(rows, "doc_id long, text string"), 3, 90).collect())
    assert [c for _, c in got] == [None, 1, 1, 1, 3]


def test_texts_that_share_an_identifier(spark):
    """Each text is in its own component; the smallest identifier of both brings both together; none is lost."""
    one, other = " ".join(f"a{i}" for i in range(50)), " ".join(f"b{i}" for i in range(50))
    rows = [(1, one), (1, other), (1, other), (2, one), (3, other + " more"), (4, "quite different words in here"), (None, one), (None, one)]
    df = spark.createDataFrame([(i, t, f"s{n}") for n, (i, t) in enumerate(rows)], "doc_id long, text string, source string")
    found = jaccard.similar(df, 3, 90)
    assert {(r.doc_id, r.component_id) for r in found.collect()} == {(1, 1), (2, 1), (3, 1), (4, 4), (None, None)}
    kept = jaccard.keep_one(df, found).collect()
    assert sorted((r.doc_id or 0, r.text, r.source) for r in kept) == [(0, one, "s6"), (0, one, "s7"), (1, one, "s0"), (1, other, "s1"), (4, rows[5][1], "s5")]


# 7: HTML


def test_extract_drops_what_is_no_article(spark):
    long = "This is the first paragraph of the article and it has a lot of the usual words in it, as one would expect of a text."
    page = f"""<html><head><title>T</title><script>var a="<p>no</p>";</script></head><body><header>Site</header><nav><a href=/>Home</a></nav>
    <div id="cookie-notice">We use cookies and all of the usual things so that this is better for the user of it</div><div class=content><h2>A  title</h2><p>{long}<p>Short&nbsp;&amp; sweet.
    <p>{long}</div><div class="reader-comments"><p>{long}</p></div><form>Name <input></form><aside>{long}</aside><footer>&copy; me</footer>"""
    assert html_text.main_text(page) == f"A title\n\n{long}\n\nShort & sweet.\n\n{long}"
    assert html_text.main_text("<article><p>Tiny.</p><div class='ad'>Buy this now</div></article>") == "Tiny."
    for odd in (None, "", "<", "<p", "<p attr='unclosed>x", "<script>never closed", "plain text", "<!-- open", "</p></p>", "<a" * 2000):
        assert isinstance(html_text.main_text(odd), str)
    df = spark.createDataFrame([(1, "u", page, 9), (2, None, None, 9), (None, "v", "<nav>x</nav>", 9)], "page_id long, url string, html string, n_chars int")
    rows = {r.page_id: r for r in html_text.extract(df).collect()}
    assert rows[1].n_chars == len(rows[1].text) and rows[2].text == "" and rows[None].n_chars == 0


LONG = "This is the first paragraph of the article and it has a lot of the usual words in it, as one would expect of a text."


@pytest.mark.parametrize("start,end", [('<div class="layout has-sidebar">', "</div>"), ('<div class="no-sidebar"><main>', "</main></div>"), ('<div class="share-enabled"><article>', "</article></div>"), ('<div class="search-results"><article>', "</article></div>")])
def test_extract_keeps_the_article_of_odd_wrappers(start, end):
    page = f"<body><nav><a href=/>Home</a></nav>{start}<h1>A title</h1><p>{LONG}</p><p>{LONG} Again.</p>{end}<footer>Imprint</footer></body>"
    assert html_text.main_text(page) == f"A title\n\n{LONG}\n\n{LONG} Again." == brute.article(page)


@pytest.mark.parametrize("sentence", ["这是一个关于许多事情的长段落,它包含许多句子。我们希望它会被保留下来,因为它是文章的正文。", "Это длинный абзац статьи, в котором рассказывается о многих вещах. "])
def test_extract_keeps_languages_without_stop_words(sentence):
    text = (sentence * 3).strip()
    page = f"<body><nav><a href=/>x</a></nav><div><p>{text}</p><p>{text}</p></div><footer>y</footer></body>"
    assert html_text.main_text(page) == f"{text}\n\n{text}" == brute.article(page)


def test_extract_matches_the_plain_version(spark):
    """The registered query on all pages of the smallest tables, and pages drawn at random."""
    rows = {r.page_id: r.text for r in queries.op7_block_rules(spark, SF).collect()}
    for r in common.table(spark, SF, "pages").collect():
        assert rows[r.page_id] == brute.article(r.html)
    r = random.Random(11)
    texts = [LONG, "Short one.", "Read more", LONG.replace("the", "foo").replace("of", "bar").replace("it", "baz"), "1 2 3", "A heading"]
    opens = ["div", "div class='ad'", "div class='has-ad'", "article", "main", "section id=sidebar", "p", "h2", "li", "footer", "header", "div class='comments list'", "div hidden"]

    def make(depth: int) -> str:
        out = ""
        for _ in range(r.randrange(1, 4)):
            if depth and r.random() < 0.7:
                tag = r.choice(opens)
                if tag not in ("p", "h2", "li"):
                    out += f"<{tag}>{make(depth - 1)}</{tag.split()[0]}>"
                    continue
                out += f"<{tag}>{r.choice(texts)}</{tag}>"
            else:
                text = r.choice(texts)
                out += f"<p>{f'<a href=x>{text}</a>' if r.random() < 0.2 else text}</p>"
        return out

    for _ in range(1500):
        page = f"<body>{make(4)}</body>"
        assert html_text.main_text(page) == brute.article(page), page


@pytest.mark.parametrize("page", ['<a "', "<div>|</p>", "<div class=ad>|x", "<a ", "<head>", "<!--", "<a href='", "<li>|</ul>", "&#9", "<b \"'>", "<script ", "<svg>|<svg ", "<svg>|</svg>", "<form>|<p>x", "<option>"])
def test_extract_takes_time_in_proportion(page):
    import time

    start = time.process_time()
    assert isinstance(html_text.main_text("".join(x * (1_000_000 // len(page)) for x in page.split("|"))), str)
    assert time.process_time() - start < 20


def test_extract_edge_cases(spark):
    assert html_text.main_text("&#" + "9" * 6000 + ";&#" + "0" * 6000 + "65; &#x41;") == ""
    assert html_text.main_text("<main><p>&#" + "9" * 6000 + ";&#" + "0" * 6000 + "65; &#x41;</main>") == "\ufffdA A"
    assert html_text.extract(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0
    long = "<main>" + f"<p>{LONG}</p>" * 20_000 + "</main>"
    rows = html_text.extract(spark.createDataFrame([(1, "u", long), (2, "u", "<main>a</main>"), (2, "u", "<main>a</main>")], "page_id long, url string, html string")).collect()
    assert sorted((r.page_id, r.n_chars) for r in rows) == [(1, 20_000 * (len(LONG) + 2) - 2), (2, 1), (2, 1)]


# 8: BPE


def test_bpe_equals_the_library(spark, docs, texts, nothing):
    t = tokenizer("byte_bpe_50k.json")
    encoded = bpe.encode(docs)
    got = {r.doc_id: r for r in bpe.decode(encoded).collect()}
    for i, x in enumerate(texts):
        ids = t.encode(x or "", add_special_tokens=False).ids
        assert np.frombuffer(got[i].ids, "<u4").tolist() == ids and got[i].text == t.decode(ids, skip_special_tokens=False)
    assert bpe.encode(nothing).count() == 0


def test_bpe_long_words_and_broken_ids():
    coder = bpe.coder("byte_bpe_50k.json")
    r = random.Random(2)
    word = "".join(r.choices("abcdefghij", k=2500))
    short = [word[i : i + 40].encode() for i in range(0, 2500, 40)]
    m = coder.merges
    assert m._merge_long(list(m.byte_ids[list(short[0])])) == m.encode_words(short[:1])[1].tolist()
    assert tokenizer("byte_bpe_50k.json").encode(word, add_special_tokens=False).ids == m.encode_words([word.encode()])[1].tolist()
    assert coder.decode(np.array([0, 2]), np.array([m.byte_ids[0xE2], 10**6], np.uint32)) == ["�"]


def test_bpe_query_digests(spark):
    r = queries.op8_bpe_codec(spark, SF).orderBy("doc_id").first()
    text = common.table(spark, SF, "documents").where(F.col("doc_id") == r.doc_id).first().text
    ids = tokenizer("byte_bpe_50k.json").encode(text, add_special_tokens=False).ids
    assert r.ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest() and r.decoded_sha256 == hashlib.sha256(text.encode()).hexdigest()


def test_bpe_null_and_repeated_identifiers(spark, tmp_path):
    """The registered query's digests for every odd text, in an own table."""
    rows = [(None, "no id"), (1, "same"), (1, "same"), (1, "other"), (2, None), (3, "ab" * 3000 + " é")]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    t = tokenizer("byte_bpe_50k.json")
    want = []
    for i, x in rows:
        ids = t.encode(x or "", add_special_tokens=False).ids
        digest = lambda y: hashlib.sha256(y.encode()).hexdigest()
        want.append((str(i), len(ids), digest(",".join(map(str, ids))), digest(t.decode(ids, skip_special_tokens=False))))
    got = queries.op8_bpe_codec(spark, str(tmp_path)).collect()
    assert sorted((str(r.doc_id), r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in got) == sorted(want)


# 9: toxicity


def test_marginals_match_enumeration():
    r = np.random.default_rng(4)
    model = toxicity.Field(trans=r.normal(size=(2, 2)), start=r.normal(size=2))
    lengths, e, first = [4, 1, 6], r.normal(size=11), np.zeros(11, bool)
    first[[0, 4, 5]] = True
    p, pair = toxicity.marginals(e, first, model, edges=True)
    at = 0
    for n in lengths:
        total, on = 0.0, np.zeros(n)
        for code in range(1 << n):
            s = [code >> i & 1 for i in range(n)]
            weight = math.exp(model.start[s[0]] + sum(model.trans[a, b] for a, b in zip(s, s[1:])) + sum(e[at + i] for i in range(n) if s[i]))
            total += weight
            on += weight * np.array(s)
        assert p[at : at + n] == pytest.approx(on / total)
        at += n
    assert pair[:, :, 1].sum(1) == pytest.approx(p)


def test_toxicity_holds_out(spark):
    r = random.Random(8)
    plain, bad = [f"word{i}" for i in range(400)], ["scoundrel", "knave", "rottenfoo", "rottenbar", "rottenbaz"]
    rows, labels = [], []
    for i in range(900):
        w = r.choices(plain, k=60)
        if toxic := i % 6 == 0:
            for _ in range(3):
                w.insert(r.randrange(len(w)), r.choice(bad).capitalize() + r.choice(["", ",", "!!"]))
        rows.append((i, " ".join(w), 0.5))
        labels.append((i, int(toxic)))
    docs = spark.createDataFrame(rows, "doc_id long, text string, score double")
    marks = spark.createDataFrame(labels, "doc_id long, toxic int")
    held = common.crc32_mod("doc_id", 4) == 2
    model = toxicity.sample_and_train(docs, marks, ~held)
    got = toxicity.score(docs, model).withColumn("held", held).join(marks, "doc_id").where("held").collect()
    assert len(got) > 100 and all((r.predicted == 1) == (r.toxic == 1) for r in got)
    texts = {i: t for i, t, _ in rows}
    spans = [texts[r.doc_id][s.begin : s.end] for r in got for s in r.spans]
    assert spans and all(any(b[:4] in s.lower() for b in bad) for s in spans)
    kept = toxicity.keep_clean(docs, model)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == {r.doc_id for r in toxicity.score(docs, model).where("predicted = 0").collect()}


def test_toxicity_edge_cases(spark, docs, texts, nothing):
    none = spark.createDataFrame([], "doc_id long, toxic int")
    model = toxicity.sample_and_train(docs, none, F.lit(True))
    rows = toxicity.score(docs.unionByName(docs.limit(1)), model).collect()
    assert len(rows) == len(texts) + 1 and all(0 <= r.score <= 1 for r in rows)
    assert toxicity.score(nothing, model).count() == 0


def test_toxicity_null_labels_and_long_texts(spark):
    rows = [(i, "plain words here " * 5 + ("vile " if i % 3 == 0 else "")) for i in range(60)] + [(100, "fine words " * 40_000), (None, "vile"), (100, None)]
    labels = [(i, int(i % 3 == 0)) for i in range(60)] + [(3, None), (None, 1), (None, None), (100, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    model = toxicity.sample_and_train(docs, spark.createDataFrame(labels, "doc_id long, toxic int"), F.lit(True))
    got = toxicity.score(docs, model).collect()
    assert len(got) == len(rows) and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in got)


# 10: roles


def test_roles_edge_cases(spark):
    rows = [
        (1, 0, "user", "hi"), (1, 1, "user", "again"), (1, 2, "assistant", "yes"), (2, 0, "assistant", "hello"), (2, 1, "robot", None), (3, None, None, ""), (None, 5, "user", "x"), (4, 0, "user", "q"), (4, 0, "user", "q"),
    ]
    df = spark.createDataFrame([(*r, 1) for r in rows], "conv_id long, turn long, role string, text string, action int")
    got = roles.repair(df, block_turns=2).orderBy("conv_id", "turn").collect()
    assert len(got) == len(rows)
    whole = {}
    for r in roles.repair(df, block_turns=2).orderBy("conv_id", "turn", "role").collect():
        whole[r.conv_id] = whole.get(r.conv_id, "") + r.rendered
    assert whole[1] == "<|im_start|>user\nhi\n\nagain<|im_end|>\n<|im_start|>assistant\nyes<|im_end|>\n"
    for text in whole.values():
        names = [x.split("\n")[0] for x in text.split("<|im_start|>")[1:]]
        assert names[-1] == "assistant" and all(a != b for a, b in zip(names, names[1:])) and "system" not in names[1:]
    assert roles.repair(spark.createDataFrame([], "conv_id long, turn long, role string, text string")).count() == 0


@pytest.mark.parametrize("block", [1, 2, 4096])
def test_repairs_are_legal_and_cheapest(spark, block):
    """All sequences of up to four roles, and longer ones at random, each a conversation; turns in order, all null or equal."""
    import itertools

    costs, r = roles.Costs(), random.Random(13)
    names = ["system", "user", "assistant", None]
    sequences = [list(x) for n in range(1, 5) for x in itertools.product(names, repeat=n)] + [r.choices(names, k=6) for _ in range(15)]
    rows = [(i, t, role, f"t{t}") for i, seq in enumerate(sequences) for t, role in enumerate(seq)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(3)
    got = {}
    for x in roles.repair(df, block_turns=block).collect():
        got.setdefault(x.conv_id, []).append(x)
    legal = {None: ("system", "user"), "system": ("user",), "user": ("assistant",), "assistant": ("user",)}
    for i, seq in enumerate(sequences):
        own, paid, turns = sorted(got[i], key=lambda x: x.turn), 0, []
        for x, role in zip(own, seq, strict=True):
            added = [y for y in x.inserted_before.split(",") if y]
            paid += costs.insert * len(added) + (0 if x.new_role == role else costs.relabel if role else costs.relabel_unknown) + costs.merge * ("merge" in x.action)
            if "merge" in x.action:
                assert turns[-1][0] == x.new_role and not added
                turns[-1][1].append(x.turn)
            else:
                turns += [(y, []) for y in added] + [(x.new_role, [x.turn])]
        added = [y for y in own[-1].inserted_after.split(",") if y]
        paid, turns = paid + costs.insert * len(added), turns + [(y, []) for y in added]
        assert all(b in legal[a] for a, b in zip([None, *[t for t, _ in turns]], [t for t, _ in turns])) and turns[-1][0] == "assistant"
        assert paid == brute.cheapest_repair(seq)
        assert "".join(x.rendered for x in own) == "".join(f"<|im_start|>{role}\n" + "\n\n".join(f"t{t}" for t in held) + "<|im_end|>\n" for role, held in turns)


def test_a_huge_conversation_without_turns(spark):
    """Messages without identifier and turn are one conversation, cut by position; its parts in order are a legal whole."""
    r = random.Random(14)
    rows = [(None, None, r.choice(["user", "assistant", "user", "robot"]), r.choice(["same", "x" * 50, None, ""])) for _ in range(700)] + [(1, None, "user", "y" * 100_000)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = roles.repair(df, block_turns=7).collect()
    assert len(got) == 701 and sum(x.inserted_after != "" or x.rendered.endswith("<|im_end|>\n") for x in got) == 2
    cost = lambda of: sum({"keep": 0, "merge": 2, "relabel": 1 if x.role == "robot" else 4, "relabel+merge": 3 if x.role == "robot" else 6}[x.action] + 3 * len([y for y in (x.inserted_before + "," + x.inserted_after).split(",") if y]) for x in of)
    assert cost(got) == cost(roles.repair(df, block_turns=1000).collect())


def test_blocks_do_not_change_costs():
    auto, r = roles.Automaton(roles.Costs()), random.Random(6)
    for _ in range(200):
        seq = [r.randrange(4) for _ in range(r.randrange(1, 30))]
        width = r.randrange(1, 9)
        blocks = [seq[i : i + width] for i in range(0, len(seq), width)]
        costs = []
        for parts in ([seq], blocks):
            ways = [w for b, (s, t) in zip(parts, auto.chain([auto.matrix(b) for b in parts])) for w in auto.solve(b, s, t)]
            cost = sum(3 * len(i) + 2 * m + (0 if n == x else 4 if x else 1) for (n, i, m), x in zip(ways, seq)) + 3 * len(auto.closing[ways[-1][0]])
            costs.append(cost)
        assert costs[0] == costs[1]
