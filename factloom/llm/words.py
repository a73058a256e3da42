"""Token ids of a lower-casing word BPE (a ``tokenizers`` file) at the speed of a dictionary.

The tokenizer drops white space and no token spans it, so the ids of a text are
those of its parts between spaces in a row. Parts recur; each new one is encoded
once, in bulk, and kept. A part of Latin letters with marks behind it is two
words to the tokenizer, so that its letters, in lower case, are kept instead.

This holds of byte-level vocabularies whose tokens at a word's end say so. Words
are encoded in rows and told apart by such tokens; that each word has got its
own number of bytes is tested, and what fails is encoded word by word.
"""

from __future__ import annotations

import os
import re

import numpy as np

#: Parts kept at most, unless told otherwise; beyond it the store starts anew. Words that are encoded in one row.
KEPT, ROW = 600_000, 512
_LETTERS_THEN_MARKS = re.compile(r"([A-Za-zÀ-ÖØ-öø-ÿ]+)([!-&(-/:-@\[-`{-~]*)").fullmatch


class WordTokens:
    """``encode`` gives the ids of texts as little-endian 32-bit bytes."""

    def __init__(self, path: str, kept: int = KEPT) -> None:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer, self.kept = Tokenizer.from_file(path), kept
        names = self.tokenizer.get_vocab()
        self.ends = np.zeros(max(names.values()) + 1, bool)  # of the tokens that end a word
        self.ends[[i for x, i in names.items() if x.endswith("</w>")]] = True
        self.bytes = np.zeros(len(self.ends), np.int64)  # a character of a name stands for a byte
        for x, i in names.items():
            self.bytes[i] = len(x.removesuffix("</w>"))
        self.parts: dict[str, bytes] = {"": b""}
        self.words: dict[str, bytes] = {"": b""}

    def _plain(self, parts: list[str]) -> list[bytes]:
        found = self.tokenizer.encode_batch_fast(parts, add_special_tokens=False)
        return [np.array(x.ids, "<u4").tobytes() for x in found]

    def _whole_words(self, words: list[str]) -> list[bytes]:
        """Ids of strings that are one word each: encoded in rows, told apart by the tokens that end a word."""
        rows = [words[i : i + ROW] for i in range(0, len(words), ROW)]
        out = []
        for own, x in zip(rows, self.tokenizer.encode_batch_fast([" ".join(r) for r in rows], add_special_tokens=False), strict=True):
            out += self._apart(own, np.array(x.ids, "<u4"))
        return out

    def _apart(self, words: list[str], ids: np.ndarray) -> list[bytes]:
        """The ids of each word of a row."""
        at = np.flatnonzero(self.ends[ids]) + 1
        if len(at) != len(words) or at[-1] != len(ids) or not np.array_equal(np.add.reduceat(self.bytes[ids], [0, *at[:-1]]), [len(w.encode()) for w in words]):
            return self._plain(words)
        raw, at = ids.tobytes(), (4 * at).tolist()
        return [raw[i:j] for i, j in zip([0, *at], at)]  # noqa: B905

    def _learn(self, new: list[str]) -> None:
        known, parts = self.words, self.parts
        odd, firsts, lasts, whole = [], [], [], []
        for x in new:
            m = _LETTERS_THEN_MARKS(x)
            if m is None:
                odd.append(x)
            else:
                whole.append(x)
                firsts.append(m[1].lower())
                lasts.append(m[2])
        parts.update(zip(odd, self._plain(odd), strict=True))
        words = list(set(firsts).union(lasts) - known.keys())
        known.update(zip(words, self._whole_words(words), strict=True))
        get = known.__getitem__
        parts.update(zip(whole, map(bytes.__add__, map(get, firsts), map(get, lasts)), strict=True))

    def encode(self, texts: list[str]) -> list[bytes]:
        split = [x.replace("\n", " ").split(" ") for x in texts]
        new = set().union(*split) - self.parts.keys()
        if new:
            if len(self.parts) + len(new) > self.kept:
                self.parts = {"": b""}
                self.words = {"": b""} if len(self.words) > self.kept else self.words
                new = set().union(*split) - {""}
            self._learn(list(new))
        get = self.parts.__getitem__
        return [b"".join(map(get, x)) for x in split]
