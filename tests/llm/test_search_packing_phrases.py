"""Search, vector packing and phrases against plain versions."""

import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

from quantloom.llm import collocations, tput, vector_packing
from quantloom.llm.word_ids import vocabulary_path

# 11: search


def ranked(docs, items, k):
    """(item, rank, doc, score) by scoring every document for every item."""
    cut = lambda t: [w.translate(LOWER) for w in re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", t or "")]
    bags = [(i, Counter(cut(t))) for i, t in docs]
    n_docs, n_terms = sum(bool(b) for _, b in bags), sum(sum(b.values()) for _, b in bags)
    df = Counter(t for _, b in bags for t in b)
    out = []
    for item, text in items:
        scores = []
        for i, bag in bags:
            m = 25 + 75 * sum(bag.values()) * n_docs // n_terms if n_terms else 0
            s = sum(n * math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (10**9 * bag[t] // (1000 * bag[t] + 8 * m)) for t, n in Counter(cut(text)).items() if bag[t])
            scores.append((-s, -(1 << 63) if i is None else i, i))
        out += [(item, r + 1, i, -s) for r, (s, _, i) in enumerate(sorted(x for x in scores if x[0] < 0)[:k])]
    return sorted(out, key=repr)


LOWER = {c: c + 32 for c in range(65, 91)}


@pytest.fixture
def library():
    r = random.Random(2)
    words = [f"w{i}" for i in range(60)] + ["Über", "über", "naïve", "中文"]
    weights = [1 / (i + 1) for i in range(64)]
    docs = [(i, " ".join(r.choices(words, weights, k=r.randrange(1, 40)))) for i in range(300)]
    docs += [(400 + i, docs[7][1]) for i in range(40)] + [(7, docs[7][1]), (None, docs[7][1]), (None, "only here"), (500, None), (501, ""), (502, " ,;: "), (503, "W3-w3_w3"), (504, "w9 " * 5000)]
    items = [(i, " ".join(r.choices(words, k=r.randrange(1, 9)))) for i in range(30)] + [(100, docs[7][1]), (100, docs[7][1]), (101, None), (102, ""), (103, "unknown words"), (None, "W3 w3 w4"), (104, "w9"), (105, "only w1")]
    return docs, items


@pytest.mark.parametrize("block,queries", [(16 << 20, 1024), (300, 7)])
def test_search_matches_scoring_everything(spark, library, monkeypatch, block, queries):
    monkeypatch.setattr(tput, "QUERY_BLOCK", queries)
    docs, items = library
    build = tput.build
    monkeypatch.setattr(tput, "build", lambda *a: build(*a, block_bytes=block))
    d = spark.createDataFrame([(i, t, 1.5, "x", "y") for i, t in docs], "doc_id long, text string, score double, term string, block string").repartition(3)
    q = spark.createDataFrame([(i, t, 1) for i, t in items], "item_id long, text string, rank int")
    got = sorted((tuple(r) for r in tput.search(d, q, k=5).collect()), key=repr)
    want = ranked(docs, items, 5)
    assert got == want and any(w[2] is None for w in want)


def test_search_of_nothing(spark, nothing):
    items = spark.createDataFrame([(1, "a b")], "item_id long, text string")
    assert tput.search(nothing, items).count() == 0
    assert tput.search(spark.createDataFrame([(1, None), (2, "..")], "doc_id long, text string"), items).count() == 0
    assert tput.search(spark.createDataFrame([(1, "a")], "doc_id long, text string"), items.limit(0)).count() == 0
    # A term of every document weighs nothing or next to it, and scores of 0 are no results.
    same = spark.createDataFrame([(i, "a") for i in range(1000)], "doc_id long, text string")
    assert tput.search(same, items).count() == 0


def test_thresholds_leave_most_of_the_lists(spark):
    """A rare term decides: of the frequent one's list hardly anything is fetched."""
    heads = {"rare": [(0, 1, 900_000), (0, 2, 800_000)], "often": [(0, 1, 500_000), (0, 3, 400_000)]}
    plan = tput.Plan([{"rare": 1, "often": 1}], heads, {"rare": 9000, "often": 2}, k=1)
    codes, factors, floors, below = plan.lists[0]
    assert plan.lower == [900_000 * 9000 + 500_000 * 2] and factors.tolist() == [9000, 2]
    assert floors[1] > 500_000 and below[1] == 2 * 500_000 and plan.floors()["rare"] == -(-plan.lower[0] // 2 + 0) // 9000 or floors[0] <= 900_000


# 12: vector packing


def padding(total, size):
    return 0 if total & (total - 1) == 0 else size - total


def check_packing(rows, size, segments, max_loss):
    """Gapless sequences within the limits."""
    by = defaultdict(list)
    for r in rows:
        by[r.sequence_id].append((r.offset, r.length, r.loss_tokens))
    for own in by.values():
        at = 0
        for offset, length, loss in sorted(own):
            assert offset == at and length > 0 and 0 <= loss <= length
            at += length
        assert at <= size and len(own) <= segments and sum(x[2] for x in own) <= max_loss
    return [sum(x[1] for x in own) for own in by.values()]


@pytest.mark.parametrize("size,segments", [(4096, 64), (64, 3), (7, 1)])
def test_vector_packing_is_whole_and_unpadded(spark, docs, texts, nothing, size, segments):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(vocabulary_path("word_bpe_49k.json"))
    library.no_truncation()
    rows = vector_packing.pack(docs, size=size, max_segments=segments).collect()
    totals = check_packing(rows, size, segments, size)
    assert sum(padding(t, size) for t in totals) == 0
    by = defaultdict(list)
    for r in rows:
        by[r.doc_id].append(r)
    assert len(by) == len(texts)
    for i, text in enumerate(texts):
        ids = np.array([*library.encode(text or "", add_special_tokens=False).ids, 2], "<u4")
        at = 0
        for r in sorted(by[i], key=lambda r: r.start):
            assert (r.start, r.doc_tokens, r.ids_crc32) == (at, len(ids), zlib.crc32(ids[at : at + r.length].tobytes()))
            assert r.loss_tokens == r.length
            at += r.length
        assert at == len(ids)
    assert vector_packing.pack(nothing).count() == 0


def test_pieces_whose_tokens_all_bear_loss_are_made_together(spark):
    df = spark.createDataFrame([(1, "a b c d e"), (2, None), (None, "a"), (3, "a b c")], "doc_id long, text string")
    got = vector_packing._all_bear(pa.array([1, 2, None, 3]), np.array([5, 6, 7, 8, 9, 2, 2, 5, 2, 5, 6, 7, 2], "<u4"), np.array([6, 1, 2, 4]), 4).to_pylist()
    assert [(r["doc_id"], r["doc_tokens"], r["start"], r["length"], r["loss"], r["ends"], r["bears"]) for r in got] == [(1, 6, 0, 4, 4, None, None), (1, 6, 4, 2, 2, [2], [True]), (2, 1, 0, 1, 1, [1], [True]), (None, 2, 0, 2, 2, [2], [True]), (3, 4, 0, 4, 4, None, None)]
    assert [None if r["ids"] is None else np.frombuffer(r["ids"], "<u4").tolist() for r in got] == [None, [9, 2], [2], [5, 2], None]
    assert got[0]["crc"] == zlib.crc32(np.array([5, 6, 7, 8], "<u4").tobytes())
    assert sum(r.length for r in vector_packing.pack(df, size=4).collect()) == 13


def test_vector_packing_of_instructions(spark):
    """Prompts bear no loss; the limit on loss-bearing tokens cuts and closes sequences by itself."""
    r = random.Random(8)
    make = lambda n: " ".join(r.choices(["some", "words", "of", "text"], k=n))
    rows = [(i, [make(r.randrange(0, 30)), make(r.randrange(0, 90)), None], [False, True, r.random() < 0.5]) for i in range(120)]
    rows += [(None, [make(5)], [True]), (7, rows[7][1], rows[7][2]), (900, [], []), (901, None, None), (902, [make(3)], None), (903, [make(400)], [True]), (904, [make(400), make(3)], [None, True])]
    df = spark.createDataFrame(rows, "doc_id long, texts array<string>, loss array<boolean>")
    got = vector_packing.pack(df, texts=df.texts, loss=df.loss, size=128, max_segments=6, max_loss=50).collect()
    check_packing(got, 128, 6, 50)
    tokens, loss = Counter(), Counter()
    for x in got:
        tokens[x.doc_id] += x.length
        loss[x.doc_id] += x.loss_tokens
    assert set(tokens) == {i for i, *_ in rows} and tokens[900] == tokens[901] == 1 and loss[903] == 401 and loss[902] == 0
    assert loss[904] == 4 and tokens[904] == 404 and tokens[7] == 2 * (sum(len(t.split()) for t in rows[7][1][:2]) + 1)
    with pytest.raises(ValueError):
        vector_packing.pack(df, texts=df.texts, loss=df.loss, max_segments=0)


def test_the_dot_product_chooses(spark):
    """Of two pieces of one length, the one that uses more of what is left in plenty."""
    loss = vector_packing.Loss([np.array([5]), np.array([4, 5]), np.array([5])], [np.array([True]), np.array([False, True]), np.array([True])])
    made = vector_packing.pack_vectors([5, 5, 5], loss, (10, 4, 6))
    by = defaultdict(list)
    for example, _, n, sequence, _ in made:
        by[sequence].append((example, n))
    assert [sorted(x) for x in by.values()][0] == [(1, 5), (2, 5)] or [sorted(x) for x in by.values()][0] == [(0, 5), (1, 5)]


# 13: phrases


def mined(rows, least, most, top, contained):
    n, f = Counter(), Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0a-\x0d]", (text or "").translate(LOWER)):
            words = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(words)
            for k in range(1, most + 1):
                for i in range(len(words) - k + 1):
                    f[lang, tuple(words[i : i + k])] += 1
    found = {key: a for key, a in f.items() if a >= least and len(key[1]) > 1}
    out = defaultdict(list)
    for (lang, p), a in found.items():
        if any(100 * b >= contained * a for (other, q), b in found.items() if other == lang and len(q) > len(p) and any(q[i : i + len(p)] == p for i in range(len(q) - len(p) + 1))):
            continue
        cuts = [(1000 * a * n[lang] // (f[lang, p[:c]] * f[lang, p[c:]]), c, f[lang, p[:c]], f[lang, p[c:]]) for c in range(1, len(p))]
        score, _, left, right = min(cuts)
        out[lang].append((-score, -a, " ".join(p).encode(), left, right))
    return sorted((lang, i + 1, p.decode(), -a, left, right, n[lang], -s) for lang, own in out.items() for i, (s, a, p, left, right) in enumerate(sorted(own)[:top]))


@pytest.fixture
def corpus(texts):
    r = random.Random(3)
    words = ["the", "of", "a", "New", "york", "city", "é", "x" * 50, "b.c", "1,5"]
    rows = [(" ".join(r.choices(words, [9, 7, 5, 3, 3, 2, 1, 1, 1, 1], k=r.randrange(0, 60))), r.choice(["en", "en", "fr", None, "und"])) for _ in range(200)]
    rows += [(t, "en") for t in texts] + [("the the the the the the", "en")] * 5 + [("new york city\nnew york\tcity! new\x0byork", "")] * 12 + [("a b c d e f", "de")] * 9
    return rows


@pytest.mark.parametrize("least,most,contained,small", [(8, 5, 100, False), (3, 5, 60, True), (5, 2, 100, True), (1, 3, 100, True)])
def test_phrases_match_counting_everything(spark, corpus, monkeypatch, least, most, contained, small):
    rows = corpus if least > 1 else corpus[:40]
    if small:  # executors would read their own values: local tasks inherit them
        for name, value in (("AUTOMATON", 20), ("BUCKETS", (1 << 16, 1 << 16)), ("REMEMBERED", 5)):
            monkeypatch.setattr(collocations, name, value)
    df = spark.createDataFrame([(i, t, g, "p", 1) for i, (t, g) in enumerate(rows)], "doc_id long, text string, lang string, phrase string, a int").repartition(3)
    got = sorted(tuple(r) for r in collocations.mine(df, least=least, most=most, top=40, contained=contained).collect())
    want = mined(rows, least, most, 40, contained)
    assert got == want and len(want) > 10


def test_phrases_of_nothing(spark, nothing):
    from pyspark.sql import functions as F

    assert collocations.mine(nothing.withColumn("lang", F.lit("en"))).count() == 0
    df = spark.createDataFrame([(1, None, None), (2, "", "en"), (3, " .,; ", "en")], "doc_id long, text string, lang string")
    assert collocations.mine(df, least=1).count() == 0
    with pytest.raises(ValueError):
        collocations.mine(df, most=1)


def test_phrase_scores_pass_64_bits(spark):
    """The arithmetic of scores on counts as large as they come."""
    from pyspark.sql import functions as F

    a, n, left, right = 10**13 + 7, 3 * 10**15 + 1, 10**13 + 9, 2 * 10**13 + 3
    row = spark.createDataFrame([(a, n, left, right)], "a long, n long, l long, r long").select(*collocations.products(), F.lit(0)).selectExpr("above div below AS score").first()
    assert row.score == 1000 * a * n // (left * right)


def test_sketch_bounds_are_never_below_counts():
    import pyarrow as pa

    r = random.Random(1)
    text = " ".join(f"w{r.randrange(50)}" for _ in range(3000))
    shard = collocations.Shard.of(pa.record_batch([pa.array([text]), pa.array(["en"])], names=["text", "lang"]))
    h = shard.hashes(3)
    counts = Counter(zip(text.split(), text.split()[1:]))
    by = defaultdict(set)
    for value, pair in zip(h[1].tolist(), zip(text.split(), text.split()[1:])):
        by[pair].add(value)
    assert all(len(v) == 1 for v in by.values()) and len({next(iter(v)) for v in by.values()}) == len(counts)


def test_automaton_of_many_phrases_counts_overlapping_ones_across_stretches(monkeypatch):
    """One automaton holds as many phrases as ten did, and its failure states give what overlaps and what is within."""
    import pyarrow as pa

    r = random.Random(5)
    assert collocations.AUTOMATON >= 1_000_000
    texts = [" ".join(r.choices("abcd", [6, 3, 2, 1], k=n)) for n in (700, 1, 0, 90, 5)] + ["a b. a b\na b c d! a"]
    languages = ["en", "fr", "en", "fr", "en", "en"]
    phrases = [("en", p) for p in ("a a", "a b", "a a a", "b a b c", "a b c d a", "c d", "d d d d d")] + [("fr", "a b"), ("fr", "b a a"), ("de", "a b")]
    shard = collocations.Shard.of(pa.record_batch([pa.array(texts), pa.array(languages)], names=["text", "lang"]))
    own = collocations.Automaton(pa.array([p for _, p in phrases]), pa.array([g for g, _ in phrases]))
    want = []
    for lang, phrase in phrases:
        pieces = [x.split() for t, g in zip(texts, languages, strict=True) if g == lang for x in re.split(r"[.!\n]", t)]
        p = phrase.split()
        want.append(sum(x[i : i + len(p)] == p for x in pieces for i in range(len(x))))
    for stretch in (1, 3, 64):
        monkeypatch.setattr(collocations, "STRETCH", stretch)
        assert own.counts(own.visits(shard)).tolist() == want
    assert sum(n > 0 for n in want) > 6
