"""Plain versions of the text operators, for small inputs."""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter, defaultdict

from quantloom.llm.katz import K, discounts

WORD = re.compile(r"[^\x20\x09-\x0D]+")
FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text: str | None) -> list[str]:
    return WORD.findall((text or "").translate(FOLD))


def katz(docs: list[tuple[int, str | None]], modulus: int = 5, rest: int = 1, order: int = 3):
    """For each row (held_out, n_tokens, n_known, train_tokens, base, score); also P(w | history) and the known words."""
    import numpy as np

    start, end = ("start",), ("end",)
    held = [i is None or zlib.crc32(str(i).encode()) % modulus == rest for i, _ in docs]
    padded = [[start] * (order - 1) + [*words(t), end] for _, t in docs]
    uni = Counter(w for x, h in zip(padded, held) if not h for w in x[order - 1 :])
    grams = {o: defaultdict(Counter) for o in range(2, order + 1)}
    for x, h in zip(padded, held):
        if not h:
            for j in range(order - 1, len(x)):
                for o in grams:
                    grams[o][tuple(x[j - o + 1 : j])][x[j]] += 1
    n, v = sum(uni.values()), len(uni)
    of = lambda counts: discounts(np.array([sum(c == r for c in counts) for r in range(1, K + 2)]))
    d = {1: of(list(uni.values()))} | {o: of([c for x in g.values() for c in x.values()]) for o, g in grams.items()}
    kept = lambda o, c: (d[o][c - 1] if c <= K else 1.0) * c
    left = 1 - sum(kept(1, c) for c in uni.values()) / n if n else 1.0
    plus = int(left < 1e-12)
    if plus:
        left = 1 / (n + 1)
    weights: dict[tuple, tuple[int, float]] = {}

    def p(history: tuple, w) -> float:
        if not history:
            c = uni.get(w, 0)
            return (c / (n + 1) if plus else kept(1, c) / n) if c else left
        o = len(history) + 1
        x = grams[o].get(history)
        if x is None:
            return p(history[1:], w)
        if history not in weights:
            below = sum(x.values()) + (min(x.values()) > K)
            weights[history] = below, (below - sum(kept(o, c) for c in x.values())) / below / (1 - sum(p(history[1:], y) for y in x))
        below, alpha = weights[history]
        return kept(o, x[w]) / below if w in x else alpha * p(history[1:], w)

    out = []
    for h, x in zip(held, padded):
        seq = x[order - 1 :]
        base = sum(math.log10((uni.get(w, 0) + 0.5) / (n + 0.5 * (v + 1))) for w in seq)
        out.append((h, len(seq), sum(w in uni for w in seq), n, base, sum(math.log10(p(tuple(x[j - order + 1 : j]), x[j])) for j in range(order - 1, len(x)))))
    return out, p, uni


def shingles(text: str | None, k: int) -> set[tuple[str, ...]]:
    w = words(text)
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} if w else set()


def components(docs: list[tuple[int, str | None]], k: int, percent: int) -> dict[int, tuple[int, int]]:
    """doc_id to (set size, smallest identifier reachable)."""
    sets = {i: shingles(t, k) for i, t in docs}
    comp = {i: i for i in sets}

    def root(i: int) -> int:
        while comp[i] != i:
            i = comp[i]
        return i

    ids = sorted(sets)
    for x, i in enumerate(ids):
        for j in ids[x + 1 :]:
            a, b = sets[i], sets[j]
            if a and b and 100 * len(a & b) >= percent * len(a | b):
                p, q = root(i), root(j)
                comp[max(p, q)] = min(p, q)
    return {i: (len(sets[i]), root(i)) for i in ids}


def pieces_fit(rows: list[tuple[int, int, int]], size: int) -> None:
    """rows (sequence, offset, length): every sequence is filled without gaps from 0 to at most size."""
    by = defaultdict(list)
    for s, o, n in rows:
        by[s].append((o, n))
    for parts in by.values():
        at = 0
        for o, n in sorted(parts):
            assert o == at
            at += n
        assert at <= size


def article(page: str | None) -> str:
    """The main text of a well-formed page by html.parser: every block keeps all elements around it, marks are taken
    back and neighbours are found by looking at all blocks each time."""
    from html.parser import HTMLParser

    from quantloom.llm import html_text as h

    blocks: list[dict] = []
    containers: list[tuple[str, list]] = []  # article and main with the elements around them

    class Reader(HTMLParser):
        def __init__(self):
            super().__init__(convert_charrefs=True)
            self.path, self.parts, self.raw, self.n, self.in_link = [], [], 0, 0, False

        def flush(self):
            text = " ".join("".join(t for t, _ in self.parts).split())
            if text:
                blocks.append({"text": text, "links": sum(len("".join(t.split())) for t, link in self.parts if link), "path": list(self.path)})
            self.parts = []

        def handle_starttag(self, name, attrs):
            if name in h.RAW | h.EMBEDDED:
                self.raw += 1
            elif name == "a":
                self.in_link = True
            elif name == "br":
                self.parts.append((" ", False))
            elif name in h.BLOCK and not self.raw:
                self.flush()
                if self.path and self.path[-1][0] == "p":
                    self.path.pop()
                if name in h.MAIN:
                    containers.append((name, list(self.path)))
                if name not in h.VOID:
                    self.n += 1
                    self.path.append((name, self.get_starttag_text()[len(name) + 1 : -1], self.n))

        def handle_endtag(self, name):
            if name in h.RAW | h.EMBEDDED:
                self.raw -= 1
            elif name == "a":
                self.in_link = False
            elif name in h.BLOCK and not self.raw and any(x[0] == name for x in self.path):
                self.flush()
                while self.path.pop()[0] != name:
                    pass
                self.in_link = False

        def handle_data(self, data):
            if not self.raw:
                self.parts.append((data, self.in_link))

    reader = Reader()
    reader.feed(page or "")
    reader.close()
    reader.flush()
    inside = lambda path: any(e[0] in h.MAIN for e in path)

    def around(path: list) -> tuple[bool, list[int]]:
        """Whether an element is away for sure, and those marked away before the first such one."""
        states = [h._is_away(e[0], e[1], inside(path[: i + 1])) for i, e in enumerate(path)]
        first_sure = states.index(True) if True in states else len(states)
        return True in states, [e[2] for e, s in list(zip(path, states))[:first_sure] if s is None]

    wrapper = {e[2]: h.is_wrapper(e[0], e[1]) for b in blocks for e in b["path"]}
    for b in blocks:
        b["sure"], b["marks"] = around(b["path"])
        b["main"] = next((e[2] for e in b["path"] if e[0] in h.MAIN), 0)
        b["heading"] = any(re.fullmatch("h[1-6]", e[0]) for e in b["path"][-3:])
        b["linked"] = b["links"] / len(b["text"].replace(" ", "")) > h.MAX_LINKS
        b["away"] = b["sure"]
    size = lambda of: sum(len(b["text"]) for b in of)
    open_main = any(around(path) == (False, []) for _, path in containers)
    back = set()
    for kind in (True, False):
        long = [b for b in blocks if not b["away"] and len(b["text"]) >= h.LONG and not b["linked"]]
        clear = [b for b in long if not b["marks"]]
        for m in {m for b in blocks for m in b["marks"] if wrapper[m] == kind}:
            names = {name for name, path in containers if not around(path)[0] and m in around(path)[1]}
            own = [b for b in long if m in b["marks"]]
            lone, most = "article" in names and not open_main and not clear, 2 * size(own) > size(long)
            wraps = lone and most or len(own) >= h.WRAPPED_TEXTS and h.WRAPPED_TIMES * (size(long) - size(own)) <= size(own)
            if "main" in names or (wraps if kind else lone or most and not any(b["main"] for b in clear)):
                back.add(m)
        for b in blocks:
            b["away"] = b["away"] or any(m not in back for m in b["marks"] if kind is False or wrapper[m])
    for b in blocks:
        found = h.WORD.findall(b["text"].lower())
        b["stops"] = sum(w in h.STOPS for w in found) / max(1, len(found))

    def first(i: int) -> bool | None:
        b = blocks[i]
        near = [blocks[j] for j in (i - 1, i + 1) if 0 <= j < len(blocks) and blocks[j]["main"] == b["main"]]
        gone = lambda x: x["linked"] and not x["away"]
        if b["away"]:
            return False
        if b["linked"]:
            if b["heading"]:
                return False if sum(x["away"] or x["linked"] for x in near) == 2 else None
            return None if b["main"] and not any(gone(x) and not x["heading"] for x in near) else False
        if len(b["text"]) < h.LONG:
            return None
        if b["stops"] >= h.STOPS_HIGH or b["main"] and b["stops"] >= h.STOPS_LOW:
            return True
        text = [x for x in blocks if not x["away"] and not x["linked"] and len(x["text"]) >= h.LONG]
        foreign = [x for x in text if x["stops"] < h.STOPS_LOW]
        return True if b["stops"] < h.STOPS_LOW and 2 * size(foreign) > size(text) and h.SENTENCE.search(b["text"]) else None

    labels = [first(i) for i in range(len(blocks))]
    good = []
    for i, b in enumerate(blocks):
        if labels[i] is None:
            known = [j for j, x in enumerate(blocks) if x["main"] == b["main"] and labels[j] is not None and not (b["main"] and x["away"])]
            p, q = max((j for j in known if j < i), default=None), min((j for j in known if j > i), default=None)
            if b["main"] and p is None and q is None:
                good.append(b["text"])
                continue
            left = labels[p] if p is not None else bool(b["main"] and labels[q])
            right = labels[q] if q is not None else bool(b["main"] and labels[p])
            to_left, to_right = i - (-1 if p is None else p), (len(blocks) if q is None else q) - i
            label = left if left == right else right if b["heading"] else left if to_left < to_right else right if to_right < to_left else bool(b["main"])
        else:
            label = labels[i]
        if label:
            good.append(b["text"])
    return "\n\n".join(good)


def cheapest_repair(roles: list[str | None]) -> int:
    """The least cost over all ways to keep, relabel, merge and insert, tried one by one."""
    from quantloom.llm.roles import Costs

    c = Costs()
    legal = {None: ("system", "user"), "system": ("user",), "user": ("assistant",), "assistant": ("user",)}

    def openings(last, left=3):
        """(inserted turns, role that may follow) after a turn."""
        for role in legal[last]:
            yield 0, role
            if left:
                yield from ((n + 1, r) for n, r in openings(role, left - 1))

    def rest(i: int, last) -> int:
        if i == len(roles):
            return {"assistant": 0, "user": 1, "system": 2, None: 0}[last] * c.insert
        price = lambda new: 0 if new == roles[i] else c.relabel if roles[i] in ("system", "user", "assistant") else c.relabel_unknown
        ways = [c.insert * n + price(r) + rest(i + 1, r) for n, r in openings(last)]
        if last:
            ways.append(c.merge + price(last) + rest(i + 1, last))
        return min(ways)

    return rest(0, None)
