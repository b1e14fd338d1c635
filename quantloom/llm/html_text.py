"""HTML extraction by two-pass block rules.

Pass one labels each block good, bad or undecided from its place, link density, length and stop-word density.
Pass two gives an undecided block the label of its nearest decided neighbours. A mark by class or id is taken back
where it would take the article itself, so are forms, dialogs, asides and hidden elements around the whole of it, and
stop words do not decide on a page in a language that the list lacks.
"""

from __future__ import annotations

import html as htmllib
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common
from .quality import STOP_WORDS

#: Length (characters) from which a block is decided by itself, link density above which it is bad, stop-word
#: densities from which a long block is good or, in a main container, not bad.
LONG, MAX_LINKS, STOPS_HIGH, STOPS_LOW = 70, 0.33, 0.2, 0.08

# Element names of HTML.
BLOCK = set(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "head header hgroup hr html li main menu nav ol optgroup option p pre section summary table tbody td tfoot th thead title tr ul".split()
)
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
RAW = set("script style noscript iframe textarea head title".split())
EMBEDDED = set("template svg math object canvas select audio video".split())
AWAY = set("nav footer button menu".split())
NESTED = {"svg", "math", "object", "template"}
WRAPPERS = set("aside form dialog fieldset".split())
MAIN = {"article", "main"}
#: Words of class, id and role attributes whose elements are no part of an article.
AWAY_WORDS = set(
    "ad ads adv advert adverts advertisement advertising banner breadcrumb breadcrumbs comment comments cookie cookies consent disclaimer discussion disqus "
    "footer gdpr header masthead menu modal nav navbar navigation newsletter notice notices pager pagination popup promo promoted promotion promotions "
    "recommended related replies reply respond search share sharing sidebar side signup skip social sponsor sponsored subscribe subscription tags toolbar widget alert "
    "complementary contentinfo".split()
)
#: Parts before or after an away word that make it a remark on the layout, and endings that say nothing.
NOT_BEFORE, NOT_AFTER = {"has", "with", "without", "no", "not", "hide", "hidden"}, {"none", "off", "no", "hidden", "disabled"}
PLAIN_ENDS = set("wrapper wrap container inner outer area section block box list content row col".split())
AWAY_ROLES = {"navigation", "banner", "contentinfo", "search", "alert", "menu", "menubar"}
WRAPPER_ROLES = {"complementary", "dialog", "form"}
#: Long texts that a wrapper without article or main must hold to be taken back, and how many times what is outside.
WRAPPED_TEXTS, WRAPPED_TIMES = 3, 10

#: What a tag, comment or declaration starts with; its end is looked for by itself.
OPENING = re.compile(r"<!--|<!\[CDATA\[|<[!?]|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)")
END_OR_QUOTE = re.compile(r"[>\"']")
HEAD_END = re.compile(r"</head\s*>|<body\b", re.I)
ATTR = re.compile(r"(?<![\w-])(class|id|role|hidden|aria-hidden|style)\b(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?", re.I)
HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden")
WORD = re.compile(r"[^\W\d_]+")
#: Leading zeros of a numeric reference, and numbers above all characters.
ZEROS, TOO_LARGE = re.compile(r"&#0+(?=[0-9])"), re.compile(r"&#[0-9]{8,};?")
SENTENCE = re.compile(r"[.!?…。！？।؟۔։]")
STOPS = frozenset(STOP_WORDS)
IMPLIED_END = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}}


@dataclass
class Block:
    text: str
    link_chars: int
    away: bool
    main: int  # number of the main container, 0 outside
    heading: bool
    mark: int = -1  # the innermost enclosing element that is marked away, -1 for none


@dataclass
class Mark:
    """An element that a class or id marks away, or a wrapper, with the next one around it (-1 for none)."""

    outer: int
    wrapper: bool = False
    holds: set[str] = field(default_factory=set)  # names of main containers in it
    chars: int = 0  # of long texts in it
    texts: int = 0  # long texts in it


def _marks_away(name: str, inside_main: bool) -> bool:
    """Whether a class name or id, as a whole or by its first or last part, is an away word."""
    parts = [x for x in re.split(r"[^a-z]+", re.sub(r"([a-z])([A-Z])", r"\1 \2", name).lower()) if x]
    while len(parts) > 1 and parts[-1] in PLAIN_ENDS:
        parts.pop()
    if not parts or parts[0] in NOT_BEFORE or parts[-1] in NOT_AFTER:
        return False
    away = lambda x: x in AWAY_WORDS or x == "header" and not inside_main
    return away(parts[0]) or away(parts[-1]) and (len(parts) == 1 or parts[-2] not in NOT_BEFORE)


def _hides(key: str, value: str) -> bool:
    """Whether an attribute makes its element a wrapper."""
    return key == "hidden" or key == "aria-hidden" and value == "true" or key == "role" and value.strip() in WRAPPER_ROLES or key == "style" and bool(HIDDEN.search(value))


def _is_away(name: str, attrs: str, inside_main: bool) -> bool | None:
    """True for away; None where a class or id says so, or it is a wrapper."""
    if name in AWAY or name == "header" and not inside_main:
        return True
    marked = name in WRAPPERS
    if not attrs or name in ("body", "html", "article", "main"):
        return None if marked else False
    for key, a, b, c in ATTR.findall(attrs):
        key, value = key.lower(), a or b or c
        if key in ("class", "id"):
            marked = marked or any(_marks_away(x, inside_main) for x in value.split())
        elif key == "role" and value.lower().strip() in AWAY_ROLES:
            return True
        else:
            marked = marked or _hides(key, value.lower())
    return None if marked else False


def is_wrapper(name: str, attrs: str) -> bool:
    """Forms, dialogs, asides and hidden elements: away unless they are all there is."""
    if name in WRAPPERS or not attrs or name in ("body", "html", "article", "main"):
        return name in WRAPPERS
    return any(_hides(key.lower(), (a or b or c).lower()) for key, a, b, c in ATTR.findall(attrs))


def _sum_up(blocks: list[Block], marks: list[Mark]) -> tuple[int, int, int]:
    """Characters of the page's long texts, of those outside marked elements, and of those in a main container there."""
    total = outside = apart = 0
    for m in marks:
        m.chars = m.texts = 0
    for b in blocks:
        if not b.away and len(b.text) >= LONG and not _linked(b):
            total += len(b.text)
            if b.mark >= 0:
                marks[b.mark].chars += len(b.text)
                marks[b.mark].texts += 1
            else:
                outside += len(b.text)
                apart += len(b.text) if b.main else 0
    for m in reversed(marks):  # an inner one comes after the one around it
        if m.outer >= 0:
            around = marks[m.outer]
            around.holds |= m.holds
            around.chars, around.texts = around.chars + m.chars, around.texts + m.texts
    return total, outside, apart


def _put_away(blocks: list[Block], marks: list[Mark], open_main: bool) -> None:
    """Blocks of marked elements are away, unless their element and all marked ones around it are taken back.

    Taken back are wrappers that hold main; or the only article and more than half of the page's long texts; or
    WRAPPED_TEXTS long texts and WRAPPED_TIMES as much of them as the rest of the page. Then, without the texts of the
    other wrappers, those marked by class or id that hold the article: main itself; an article of a page that has
    neither article nor main nor a long text outside marked elements; or more than half of the page's long texts,
    unless an article or main outside marked elements holds some."""
    away = [False] * len(marks)
    for wrappers in (True, False):
        total, outside, apart = _sum_up(blocks, marks)
        for i, m in enumerate(marks):
            lone = "article" in m.holds and not open_main and not outside
            most = 2 * m.chars > total
            if m.wrapper == wrappers:
                wraps = lone and most or m.texts >= WRAPPED_TEXTS and WRAPPED_TIMES * (total - m.chars) <= m.chars
                away[i] = not ("main" in m.holds or (wraps if wrappers else lone or most and not apart))
        for i, m in enumerate(marks):
            away[i] = away[i] or m.outer >= 0 and away[m.outer]
        for b in blocks:
            b.away = b.away or b.mark >= 0 and away[b.mark]


class Tags:
    """The tags of a page in order, found in time in proportion to the page."""

    def __init__(self, page: str):
        self.page = page
        self.ends = True  # whether a > may follow
        self.closed = {'"': True, "'": True}  # whether a quote may follow
        self.named: dict[str, dict[int, int]] = {}  # ends of embedded elements by where their start tags end
        self.plain_before = 0  # tags that start before this place end at their first >

    def next(self, pos: int) -> tuple[int, int, str, str, str] | None:
        """(start, end, slash, name, attributes) of the next tag from pos on; without a name, the attributes are the
        text of a CDATA section or nothing. An open comment or section ends with the page; a tag without end is text."""
        page = self.page
        while True:
            m = OPENING.search(page, pos)
            if not m:
                return None
            start, after = m.start(), m.end()
            if m[0] == "<!--" or m[0] == "<![CDATA[":
                close = "-->" if m[0] == "<!--" else "]]>"
                end = page.find(close, after)
                inner, end = (page[after:], len(page)) if end < 0 else (page[after:end], end + 3)
                return start, end, "", "", inner if close == "]]>" else ""
            end = self._end(start, after) if m[2] else self._first(after)
            if end < 0:
                pos = after
                continue
            return start, end + 1, m[1] or "", m[2] or "", page[after:end] if m[2] else ""

    def own_end(self, name: str, at: int) -> int | None:
        """Where the element whose start tag ended at `at` ends: after its end tag, unless another one of its name starts
        before, inner ones of svg, math, object and template apart."""
        if name not in self.named:
            found = [(m.start(), m.end(), bool(m[1])) for m in re.finditer(rf"<(/?){name}\b[^<>]*>", self.page, re.I)]
            open_, ends = [], {}
            for start, end, slash in found:
                if not slash:
                    if name not in NESTED:
                        open_.clear()
                    if self.page[end - 2] != "/":
                        open_.append(end)
                elif open_:
                    ends[open_.pop()] = end
            self.named[name] = ends
        return self.named[name].get(at)

    def _first(self, at: int) -> int:
        found = self.page.find(">", at) if self.ends else -1
        self.ends = found >= 0
        return found

    def _end(self, start: int, at: int) -> int:
        """The > that ends a tag, outside quotes; the first one if a quote is never closed."""
        first = self._first(at)
        if first < 0 or start < self.plain_before:
            return first
        while True:
            m = END_OR_QUOTE.search(self.page, at)
            if not m:
                break
            if m[0] == ">":
                return m.start()
            close = self.page.find(m[0], m.end()) if self.closed[m[0]] else -1
            if close < 0:
                self.closed[m[0]] = False
                break
            at = close + 1
        self.plain_before = at
        return first


def _decoded(data: str) -> str:
    return htmllib.unescape(TOO_LARGE.sub("\ufffd", ZEROS.sub("&#", data)))


def blocks_of(page: str) -> list[Block]:
    """The text blocks in page order. Raw elements are skipped to their end tag, embedded ones too if they have one of
    their own, else their tag counts for nothing; p, li and the like end by themselves; a line break is white space,
    two in a row end the block; what an option holds up to the next tag is dropped."""
    out: list[Block] = []
    stack: list[tuple[str, bool, int, int]] = []  # name, away, main, mark
    opened: Counter[str] = Counter()  # the stack's names
    marks: list[Mark] = []
    open_main, head_ends = False, True
    tags = Tags(page)
    parts: list[str] = []
    links = mains = pending_links = breaks = 0
    pos, size = 0, len(page)
    dropped = False  # whether text up to the next tag is

    def flush() -> None:
        nonlocal links, breaks
        breaks = 0
        if parts:
            text = " ".join("".join(parts).split())
            parts.clear()
            if text:
                away, main, mark = stack[-1][1:] if stack else (False, 0, -1)
                heading = any(s[0] in ("h1", "h2", "h3", "h4", "h5", "h6") for s in stack[-3:])
                out.append(Block(text, links, away, main, heading, mark))
        links = 0

    def leave() -> str:
        name = stack.pop()[0]
        opened[name] -= 1
        return name

    while pos < size:
        tag = tags.next(pos)
        data = page[pos : tag[0] if tag else size]
        if data and not dropped:
            if "&" in data:
                data = _decoded(data)
            parts.append(data)
            if not data.isspace():
                breaks = 0
                if pending_links:
                    links += len("".join(data.split()))
        dropped = False
        if not tag:
            break
        _, pos, slash, name, attrs = tag
        name = name.lower()
        if not name:
            parts.append(attrs)
            continue
        if slash:
            if name == "a":
                pending_links = max(0, pending_links - 1)
            elif name in BLOCK:
                flush()
                if opened[name]:
                    while leave() != name:
                        pass
                    pending_links = 0
            continue
        if name == "br":
            breaks += 1
            parts.append(" ")
            if breaks > 1:
                flush()
        elif name == "a":
            pending_links = 1
        elif name in RAW:
            if name == "head":
                end = HEAD_END.search(page, pos) if head_ends else None
                head_ends = end is not None
                if end:
                    pos = end.end() if page[end.start() + 1] == "/" else end.start()
            elif not attrs.rstrip().endswith("/"):
                end = re.compile(rf"</{name}\s*>", re.I).search(page, pos)
                pos = end.end() if end else size
        elif name in EMBEDDED:
            if not attrs.rstrip().endswith("/"):
                pos = tags.own_end(name, pos) or pos
        elif name in BLOCK:
            flush()
            if name in ("option", "optgroup"):
                dropped = True
                continue
            if stack and stack[-1][0] == "p":
                leave()
            for other in IMPLIED_END.get(name, ()):
                if stack and stack[-1][0] == other:
                    leave()
            if name in VOID:
                continue
            away, main, mark = stack[-1][1:] if stack else (False, 0, -1)
            if name in MAIN:
                if not main:
                    mains += 1
                    main = mains
                if not away:
                    open_main = open_main or mark < 0
                    if mark >= 0:
                        marks[mark].holds.add(name)
            own = _is_away(name, attrs, bool(main))
            if own is None and not away:
                marks.append(Mark(mark, is_wrapper(name, attrs)))
                mark = len(marks) - 1
            stack.append((name, away or bool(own), main, mark))
            opened[name] += 1
    flush()
    if marks:
        _put_away(out, marks, open_main)
    return out


def _linked(b: Block) -> bool:
    chars = len(b.text) - b.text.count(" ")
    return bool(chars) and b.link_chars / chars > MAX_LINKS


def _stops(b: Block) -> float:
    words = WORD.findall(b.text.lower())
    return sum(w in STOPS for w in words) / max(1, len(words))


def _first_label(b: Block) -> bool | None:
    if b.away or _linked(b):
        return False
    if len(b.text) < LONG:
        return None
    density = _stops(b)
    return True if density >= STOPS_HIGH or b.main and density >= STOPS_LOW else None


def _first_labels(blocks: list[Block]) -> list[bool | None]:
    """Pass one. A linked heading, and a linked block of a main container, are undecided unless their neighbours are
    linked too: both for a heading, one that is no heading for others, as in lists of links. Where the stop words
    are missing from most of the page's long texts, those of them with an end of a sentence are good."""
    out = [_first_label(b) for b in blocks]
    linked = [not b.away and _linked(b) for b in blocks]
    for i, b in enumerate(blocks):
        if linked[i] and (b.heading or b.main):
            near = [j for j in (i - 1, i + 1) if 0 <= j < len(blocks) and blocks[j].main == b.main]
            bad = sum(linked[j] or blocks[j].away for j in near) == 2 if b.heading else any(linked[j] and not blocks[j].heading for j in near)
            out[i] = False if bad else None
    long = [i for i, b in enumerate(blocks) if not b.away and not linked[i] and len(b.text) >= LONG]
    foreign = [i for i in long if out[i] is None and _stops(blocks[i]) < STOPS_LOW]
    if 2 * sum(len(blocks[i].text) for i in foreign) > sum(len(blocks[i].text) for i in long):
        for i in foreign:
            if SENTENCE.search(blocks[i].text):
                out[i] = True
    return out


def labels_of(blocks: list[Block]) -> list[bool]:
    """Both passes. An undecided block in a main container looks at decided blocks of that container only and is
    good if there is none; elsewhere the page's ends count as bad. Neighbours that differ: the nearer in blocks
    decides, the following one for a heading, else bad outside a main container and good inside."""
    first = _first_labels(blocks)
    n = len(blocks)
    before: list[tuple[int, bool] | None] = [None] * n
    after: list[tuple[int, bool] | None] = [None] * n
    for order, near in ((range(n), before), (range(n - 1, -1, -1), after)):
        last: dict[int, tuple[int, bool]] = {}
        for i in order:
            scope = blocks[i].main
            near[i] = last.get(scope)
            if first[i] is not None and not (scope and blocks[i].away):
                last[scope] = (i, first[i])
    out = []
    for i, b in enumerate(blocks):
        if first[i] is not None:
            out.append(first[i])
            continue
        p, q = before[i], after[i]
        if b.main and not p and not q:
            out.append(True)
            continue
        left = p or (-1, bool(b.main and q and q[1]))
        right = q or (n, bool(b.main and p and p[1]))
        if left[1] == right[1]:
            out.append(left[1])
        elif b.heading:
            out.append(right[1])
        elif i - left[0] != right[0] - i:
            out.append(left[1] if i - left[0] < right[0] - i else right[1])
        else:
            out.append(bool(b.main))
    return out


def main_text(page: str | None) -> str:
    blocks = blocks_of(page or "")
    return "\n\n".join(b.text for b, good in zip(blocks, labels_of(blocks), strict=True) if good)


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """page_id, url, text and n_chars of every page, from its whole html.

    Null or empty html, and pages without a good block, give an empty text. One row per input row; null
    identifiers and addresses stay null; other columns are not read. It is a map: no shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in common.chunks(batches, "html"):
            texts = [main_text(h) for h in batch.column("html").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), F.coalesce(F.col(html_col), F.lit("")).alias("html"))
    return rows.mapInArrow(run, "page_id long, url string, text string, n_chars long")
