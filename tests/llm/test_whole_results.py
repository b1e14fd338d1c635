"""Operators keep whole articles and every link."""

import brute
import pytest

from quantloom.llm import html_text, jaccard

LONG = "This is the first paragraph of the article and it has a lot of the usual words in it, as one would expect of a text."
POLISH = "Wczoraj wieczorem mieszkańcy miasta spotkali się przed ratuszem, żeby porozmawiać o nowym moście. Rozmowa trwała kilka godzin."
COMMENT = "I think that this is the best of all the texts that I have read on the site, and it is not by far the first of them."


@pytest.mark.parametrize("name", ["content has-sidebar", "page-with-sidebar", "layout-header-fixed", "post related-none", "hasSidebar", "sidebar"])
def test_wrapper_classes_keep_the_article(name):
    assert html_text.main_text(f'<div class="{name}"><h1>Title</h1><p>{LONG}</p><div class="post-comments"><p>{COMMENT}</p></div></div>') == f"Title\n\n{LONG}"
    assert html_text.main_text(f'<div class="{name}"><main><p>{LONG}</p></main></div>') == LONG


def test_marked_parts_stay_away():
    for name in ("reader-comments", "sidebar-left", "site-footer-wrapper", "relatedPosts", "ad"):
        assert html_text.main_text(f"<article><p>{LONG}</p></article><div class='{name}'><article><p>{COMMENT}</p><p>{COMMENT}</p></article></div>") == LONG
        assert html_text.main_text(f"<div><p>{LONG}</p><p>{LONG}</p></div><div class='{name}'><p>{COMMENT}</p></div>") == f"{LONG}\n\n{LONG}"


def test_linked_headline_and_sentence_of_an_article():
    page = f'<article><h1><a href="/">Title</a></h1><p>{LONG}</p><p><a href="/x">A short linked sentence.</a></p><p>{LONG}</p></article>'
    assert html_text.main_text(page) == f"Title\n\n{LONG}\n\nA short linked sentence.\n\n{LONG}"
    links = "".join(f'<li><a href="/{i}">More on topic {i}</a></li>' for i in range(4))
    assert html_text.main_text(f"<article><p>{LONG}</p><ul>{links}</ul></article>") == LONG


def test_page_in_a_language_without_stop_words():
    assert html_text.main_text(f'<div><a href="/">Start</a></div><div class="content"><p>{POLISH}</p><p>{POLISH}</p></div>') == f"{POLISH}\n\n{POLISH}"


def _near_copies(first, second):
    words = [f"w{i}" for i in range(60)]
    return [(first, " ".join(words)), (second, " ".join([*words[:-1], "other"]))]


def _assert_like_brute_force(spark, rows):
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.similar(spark.createDataFrame(rows, "doc_id long, text string"), 3, 90).collect()}
    want = brute.components(rows, 3, 90)
    assert len({c for _, c in want.values()}) < len(rows) and got == want


def test_link_across_salts_of_a_tile(spark, monkeypatch):
    monkeypatch.setattr(jaccard, "TILE_MEMBERS", 1)
    salts = {r.id: r.salt for r in spark.range(1, 50).selectExpr("id", "pmod(xxhash64(id), 2) AS salt").collect()}
    _assert_like_brute_force(spark, _near_copies(1, next(i for i in salts if salts[i] != salts[1])))


def test_link_between_spokes_of_a_refuted_hub(spark, monkeypatch):
    """The hub's coarse bound takes both, as of long texts; refine() refutes it."""
    pairs = jaccard._pairs
    star = lambda rows, percent, crossing: pairs(rows, percent, True) if crossing else spark.createDataFrame([(0, 1), (0, 2)], "a long, b long")
    monkeypatch.setattr(jaccard, "_pairs", star)
    _assert_like_brute_force(spark, [(0, " ".join(f"v{i}" for i in range(60))), *_near_copies(1, 2)])


ARTICLE = [f"{LONG} It is number {i} of the six." for i in range(6)]
BODY = "".join(f"<p>{t}</p>" for t in ARTICLE)


@pytest.mark.parametrize(
    "page",
    [
        f'<body><nav><a href="/">Home</a></nav><form id="aspnetForm"><div>{BODY}</div></form><footer>Imprint</footer></body>',
        f"<form><article>{BODY}</article></form>",
        f"<body><aside>{BODY}</aside></body>",
        f"<dialog open>{BODY}</dialog>",
        f'<div role="dialog">{BODY}</div>',
        f'<div style="visibility: hidden">{BODY}</div>',
        f'<div aria-hidden="true"><main>{BODY}</main></div>',
        f'<form id="f"><div class="reader-comments"><p>{COMMENT}</p></div><div>{BODY}</div><label>Name</label><select><option>One<option>Two</select><button>Send</button></form>',
        *[f"<body><div><{name} src=x>{BODY}</div></body>" for name in ("video", "audio", "object", "canvas", "svg", "select")],
        f"<body><p>{ARTICLE[0]}</p><video>{''.join(f'<p>{t}</p>' for t in ARTICLE[1:])}<video>no video here</video></body>",
        f"<body><svg><svg><text>in</text></svg><text>out</text></svg>{BODY}<object><p>plug-in is missing and it is not to be shown to any of the readers of the page</p></object></body>",
        f"<body><select><option>A<option>B{BODY}</body>",
    ],
)
def test_wrappers_and_open_elements_keep_the_article(page):
    """Pages marked by hand: the article is always the same six paragraphs."""
    assert html_text.main_text(page) == "\n\n".join(ARTICLE)


def test_wrappers_beside_an_article_stay_away():
    for part in (f"<form><p>{COMMENT}</p></form>", f"<aside>{BODY}</aside>", f'<div hidden><p>{COMMENT}</p></div>', f'<div role="dialog"><p>{COMMENT}</p></div>', f"<aside><article><p>{COMMENT}</p></article></aside>"):
        assert html_text.main_text(f"<main><p>{LONG}</p></main>{part}") == LONG
    assert html_text.main_text(f"<div><p>{LONG}</p><p>{LONG}</p></div><dialog><p>{COMMENT}</p></dialog>") == f"{LONG}\n\n{LONG}"
    assert html_text.main_text(f"<dialog><p>{COMMENT}</p></dialog>") == ""


def test_a_pair_of_many_tiles_is_sent_once_and_parities_refute_what_counts_do_not(spark):
    """Near copies share almost all bands: their number of candidate pairs is not that of tiles times pairs."""
    import numpy as np

    r = np.random.default_rng(2)
    common_part, made = r.integers(0, 1 << 63, 300, dtype=np.uint64), {}
    for i in range(12):  # two of them share 300 of 396, which is no link
        made[i] = np.unique(np.append(common_part, r.integers(0, 1 << 63, 96, dtype=np.uint64)))
    made[12] = np.unique(np.append(made[11][:-3], r.integers(0, 1 << 63, 3, dtype=np.uint64)))
    rows = [(tile, i, i, True, probe, jaccard.pack_point(s), jaccard.pack_bits(s)) for tile in range(40) for i, s in made.items() for probe in (True, False)]
    df = spark.createDataFrame(rows, "tile long, rep long, comp long, home boolean, probe boolean, point binary, bits binary")
    sent = []
    plan = jaccard._pairs(df.coalesce(1), 80, True)
    sent = [tuple(x) for x in plan.collect()]
    assert (11, 12) in sent and len(sent) == len(set(sent)) < 12
    for a, b in ((300, 420), (900, 1300), (5, 7)):  # linked sets always pass, whatever their numbers of groups
        one = np.unique(r.integers(0, 1 << 63, b, dtype=np.uint64))
        two = one[: -(-b * 80 // 100)]
        points = np.stack([jaccard.read_point(jaccard.pack_point(s)) for s in (one, two)])
        bits = jaccard.read_bits([jaccard.pack_bits(s) for s in (one, two)])
        assert points.sum(1).tolist() == [len(one), len(two)]
        assert jaccard.may_link(points, bits, 0, np.array([1]), 80).tolist() == [1]
