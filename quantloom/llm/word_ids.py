"""Token ids of whole texts from a tokenizer whose pieces never cross white space, word by distinct word."""

from __future__ import annotations

import json
import os
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from . import common

#: Distinct words of a generation. A worker remembers two: a full one replaces the one before it, and words that are
#: met again move on from there.
GENERATION_WORDS = 150_000

#: Words of letters alone are one piece each, so that many can be encoded as one text and told apart by piece ends.
JOINED = 100


def vocabulary_path(name: str) -> str:
    """Place of a public vocabulary file; each worker resolves it for itself."""
    import public_tokenizers

    return public_tokenizers.path(name)


#: ASCII signs between a Latin letter and white space: a piece of their own, so that a space before them changes nothing
#: and leaves fewer distinct words. Not for letters that end in a combining mark once they are normalised and
#: lower-cased, as the library keeps mark and sign together: of these Latin ones U+0130. Not for |, which ends the names
#: of special tokens.
LETTER_STOP = "([A-Za-z\u00C0-\u00D6\u00D8-\u00F6\u00F8-\u012F\u0131-\u024F])([!-/:-@\\[-`{}~]+)(\\s)"

#: Texts whose A-Z can't be folded before a tokenizer that folds them: a mark may compose with a small letter alone (J and
#: U+030C do not, j does), and special tokens are found before folding.
UNFOLDED = "[\u0300-\u036F]|<\\|"


class Generation:
    """Words and their ids."""

    def __init__(self) -> None:
        self.place: dict[str, int] = {}
        self.ids = np.zeros(1 << 16, np.uint32)
        self.offsets = np.zeros(1 << 14, np.int64)

    def add(self, words: list[str], sizes: np.ndarray, ids: np.ndarray) -> None:
        known = len(self.place)
        used = int(self.offsets[known])
        while used + len(ids) > len(self.ids):
            self.ids = np.concatenate((self.ids, np.zeros_like(self.ids)))
        while known + len(words) + 1 > len(self.offsets):
            self.offsets = np.concatenate((self.offsets, np.zeros_like(self.offsets)))
        self.ids[used : used + len(ids)] = ids
        self.offsets[known + 1 : known + 1 + len(words)] = used + np.cumsum(sizes)
        self.place.update(zip(words, range(known, known + len(words)), strict=True))

    def take(self, place: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(sizes, ids) of the words at these places, one after the other."""
        sizes = self.offsets[place + 1] - self.offsets[place]
        return sizes, self.ids[common.segments(self.offsets[place], sizes)]


class WordEncoder:
    """encode(texts) gives (offsets, ids): the ids of text i are ids[offsets[i]:offsets[i+1]].

    It serves tokenizers that drop white space and split at it: a text's ids are then those of its words in
    order, so that each distinct word is encoded once. Words are split at ASCII white space only; any other
    white space stays inside a word, for the tokenizer to deal with."""

    def __init__(self, name: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(vocabulary_path(name))
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.ends_piece = np.zeros(self.tokenizer.get_vocab_size() + 1, bool)
        for token, i in self.tokenizer.get_vocab().items():
            self.ends_piece[i] = token.endswith("</w>")
        normalizer = json.loads(self.tokenizer.to_str())["normalizer"] or {}
        self.folds = any(n["type"] == "Lowercase" for n in normalizer.get("normalizers", [normalizer]) if n)
        self.new, self.old = Generation(), Generation()

    def _encode_words(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(sizes, ids) of words, each encoded by itself."""
        arrays = [e.ids for e in self.tokenizer.encode_batch_fast(words, add_special_tokens=False)]
        return np.fromiter(map(len, arrays), np.int64, len(arrays)), np.fromiter(chain.from_iterable(arrays), np.uint32)

    def _encode_letters(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The same for words of letters, each one piece: it ends with its one id that ends a piece. Else (a letter whose lower case is two characters, say) word by word."""
        texts = [" ".join(words[i : i + JOINED]) for i in range(0, len(words), JOINED)]
        ids = np.concatenate([np.asarray(e.ids, np.uint32) for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)])
        ends = np.flatnonzero(self.ends_piece[ids])
        if len(ends) != len(words):
            return self._encode_words(words)
        return np.diff(ends, prepend=-1), ids

    def _learn(self, words: list[str]) -> None:
        letters = [w for w in words if w.isalpha()]
        others = [w for w in words if not w.isalpha()]
        for own, encode in ((letters, self._encode_letters), (others, self._encode_words)):
            if own:
                self.new.add(own, *encode(own))

    def _places(self, words: list[str]) -> np.ndarray:
        """Places of distinct words in the new generation, which those that it misses are brought into."""
        place = np.fromiter(map(self.new.place.get, words, repeat(-1)), np.int64, len(words))
        at = np.flatnonzero(place < 0)
        if self.new.place and len(self.new.place) + len(at) > GENERATION_WORDS:
            self.new, self.old = Generation(), self.new
            at = np.arange(len(words))
        missing = [words[i] for i in at.tolist()]
        before = np.fromiter(map(self.old.place.get, missing, repeat(-1)), np.int64, len(missing))
        known = np.flatnonzero(before >= 0)
        if len(known):
            self.new.add([missing[i] for i in known.tolist()], *self.old.take(before[known]))
        unknown = [missing[i] for i in np.flatnonzero(before < 0).tolist()]
        for i in range(0, len(unknown), 10_000):
            self._learn(unknown[i : i + 10_000])
        place[at] = np.fromiter(map(self.new.place.__getitem__, missing), np.int64, len(missing))
        return place

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        texts = pc.replace_substring_regex(pc.fill_null(texts, ""), LETTER_STOP, r"\1 \2\3")
        if self.folds:
            texts = pc.if_else(pc.match_substring_regex(texts, UNFOLDED), texts, pc.ascii_lower(texts))
        offsets, index, distinct = common.split_words(texts, lower=False)
        words = distinct.to_numpy(zero_copy_only=False).tolist()
        place = self._places(words)[index]
        sizes, ids = self.new.take(place)
        ends = np.concatenate(([0], np.cumsum(sizes)))
        return ends[offsets], ids


_ENCODERS: dict[str, WordEncoder] = {}


def encoder(name: str) -> WordEncoder:
    """The worker's encoder of this vocabulary file."""
    if name not in _ENCODERS:
        _ENCODERS[name] = WordEncoder(name)
    return _ENCODERS[name]
