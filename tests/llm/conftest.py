import os
import random
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

VOCABULARY = [a + b for a in ("lo", "ra", "ti", "mo", "ne", "su", "pe") for b in ("ka", "ri", "to", "me", "la", "du")]


@pytest.fixture(scope="session")
def texts():
    """Odd and ordinary texts: null, empty, white space, symbols, other scripts, special tokens, long words, copies."""
    r = random.Random(5)
    make = lambda n: " ".join(r.choices(VOCABULARY, k=n))
    base = [make(120) for _ in range(6)]
    near = [" ".join([*base[0].split()[:-2], f"new{i}", "end"]) for i in range(4)]
    far = [" ".join(w if j % 9 else w + "x" for j, w in enumerate(base[1].split())) for _ in range(2)]
    odd = [None, "", "   \n\t ", "one", "two words", "Ünï çödé ñ 中文字 テスト é", "a <|endoftext|> b<|startoftext|>c", "x" * 3000, "tab\tand\x0bother\x0cspaces\r\nhere  twice ", "Σίσυφος ΣΑΣ 'tis it's I'LL", "1234 5 67,8 $%& ***"]
    return [*odd, *base, base[0], base[0], *near, *far, make(3000), "\n".join([make(12)] * 30)]


@pytest.fixture(scope="session")
def docs(spark, texts):
    """With columns whose names clash with the operators' own."""
    rows = [(i, t, "en", "s", 1.5, f"k{i}") for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, score double, keys string")


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], "doc_id long, text string")
