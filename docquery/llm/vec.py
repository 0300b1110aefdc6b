"""Words and shingles of many texts at once, as numpy arrays over code points.

A word is a run of letters and numbers (Unicode categories L and N), lower-cased code point by
code point.  Its hash is a polynomial over the code points modulo 2**64, so SQL can express it.
"""

from __future__ import annotations

import functools
import unicodedata
from collections.abc import Iterator

import numpy as np

BASE, GRAM = 0x2545F4914F6CDD1D, 0x1B873593CC9E2D51
MIX = 0x1F123BB5DEADBEEF
CHUNK_CHARS = 1 << 20


@functools.cache
def _tables() -> tuple[np.ndarray, np.ndarray]:
    word = np.zeros(0x110000, bool)
    lower = np.arange(0x110000, dtype=np.uint32)
    for c in range(0x110000):
        s = chr(c)
        if unicodedata.category(s)[0] in "LN":
            word[c] = True
            if len(x := s.lower()) == 1:
                lower[c] = ord(x)
    return word, lower


_powers = {BASE: np.ones(1, np.uint64), GRAM: np.ones(1, np.uint64)}


def powers(base: int, n: int) -> np.ndarray:
    """base ** 0 .. base ** (n - 1), or more, modulo 2 ** 64."""
    p = _powers[base]
    if len(p) < n:
        more = np.full(max(n, 2 * len(p)), base, np.uint64)
        more[0] = 1
        p = _powers[base] = np.multiply.accumulate(more)
    return p


def mix(h: np.ndarray) -> np.ndarray:
    """Spread a polynomial hash over all 64 bits."""
    h = (h ^ (h >> np.uint64(32))) * np.uint64(MIX)
    return h ^ (h >> np.uint64(29))


class Words:
    """``hash[ptr[d]:ptr[d + 1]]`` are the words of text d; ``start`` and ``end`` count characters in it."""

    def __init__(self, texts: list[str]):
        word, lower = _tables()
        cp = np.frombuffer("\n".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
        is_word = word[cp]
        edge = np.diff(is_word.view(np.int8), prepend=np.int8(0), append=np.int8(0))
        start, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
        size = end - start
        to = np.cumsum(size)
        letters = lower[cp[is_word]]
        if len(letters):
            place = np.repeat(to - 1, size)
            place -= np.arange(len(letters))
            of = letters * powers(BASE, int(size.max()))[place]
            self.hash = np.add.reduceat(of, to - size)
        else:
            self.hash = np.zeros(0, np.uint64)
        begins = np.zeros(len(texts) + 1, np.int64)
        np.cumsum([len(t) + 1 for t in texts], out=begins[1:])
        self.ptr = np.searchsorted(start, begins)
        per_doc = np.repeat(begins[:-1], np.diff(self.ptr))
        self.start, self.end = start - per_doc, end - per_doc

    @staticmethod
    def grams_of(h: np.ndarray, n: int) -> np.ndarray:
        """Hashes of all n consecutive words, bounds of texts aside."""
        g = np.zeros(max(len(h) - n + 1, 0), np.uint64)
        for j in range(n):
            g *= np.uint64(GRAM)
            g += h[j : j + len(g)]
        return mix(g)

    def grams(self, n: int) -> list[np.ndarray]:
        """For each text the hashes of its n-word shingles in order; a text of 1 to n - 1 words has one, of all its words."""
        h, out = self.hash, []
        g = self.grams_of(h, n)
        for a, b in zip(self.ptr[:-1].tolist(), self.ptr[1:].tolist()):
            if b - a >= n:
                out.append(g[a : b - n + 1])
            elif b > a:
                p = powers(GRAM, b - a)[: b - a][::-1]
                out.append(mix((h[a:b] * p).sum(keepdims=True, dtype=np.uint64)))
            else:
                out.append(g[:0])
        return out


def chunks(texts: list[str | None], chars: int = CHUNK_CHARS) -> Iterator[tuple[int, list[str]]]:
    """(index of the first, texts) in runs of about ``chars`` characters; None counts as empty; no text is cut."""
    at, run, size = 0, [], 0
    for i, t in enumerate(texts):
        t = t or ""
        if run and size + len(t) > chars:
            yield at, run
            at, run, size = i, [], 0
        run.append(t)
        size += len(t)
    if run:
        yield at, run


#: DuckDB SQL for the same words and hashes, for oracles.
SQL_WORDS = r"regexp_extract_all(lower({0}), '[\p{{L}}\p{{N}}]+')"
_M = 2**64


def sql_hash(words: str) -> str:
    """Of a list of words: mixed shingle hash, as HUGEINT."""
    word = f"list_reduce(list_transform(string_split(w, ''), lambda c: unicode(c)::HUGEINT), lambda a, x: (a * {BASE}::HUGEINT + x) % {_M}::HUGEINT)"
    gram = f"list_reduce(list_transform({words}, lambda w: {word}), lambda a, x: (a * {GRAM}::HUGEINT + x) % {_M}::HUGEINT)"
    first = f"(xor(({gram}), ({gram}) >> 32) * {MIX}::HUGEINT) % {_M}::HUGEINT"
    return f"xor({first}, ({first}) >> 29)"
