"""Words, white space and scripts of many texts at once, as arrays over their code points.

A word is a run of letters, with the apostrophes that stand between two of them; words are known by a
64-bit hash of their lower-case letters, whose low byte is their number of letters (255 at most).
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np

CHUNK = 400_000  # characters that are handled at once, and one text at least
SCRIPTS = ["el", "ar", "hi", "th", "ja", "zh"]  # scripts other than the Latin one, numbered from 1
RANGES = [(0x370, 0x400, 1), (0x1F00, 0x2000, 1), (0x600, 0x700, 2), (0x900, 0x980, 3), (0xE00, 0xE80, 4), (0x3040, 0x3100, 5), (0x4E00, 0xA000, 6)]
LETTER, SPACE, DIGIT = 1, 2, 4
FACTOR = np.uint64(0x9E3779B97F4A7C15)  # of word hashes; odd


def mix(x: np.ndarray) -> np.ndarray:
    """The finishing steps of SplitMix64."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


@cache
def tables() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For every code point its class, a number for its lower case, and its script."""
    kind, lower, script = np.zeros(0x110000, np.uint8), np.arange(0x110000, dtype=np.uint64), np.zeros(0x110000, np.uint8)
    for c in range(0x110000):
        s = chr(c)
        if s.isdecimal():
            kind[c] = DIGIT
        elif s.isalnum():
            kind[c] = LETTER
            if len(s.lower()) == 1:
                lower[c] = ord(s.lower())
        elif s.isspace():
            kind[c] = SPACE
    lower[0x2019] = 0x27
    for a, b, k in RANGES:
        script[a:b] = k
    return kind, mix(lower + FACTOR), script


_POWERS = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def powers(size: int) -> list[np.ndarray]:
    """The first ``size`` powers, modulo 2^64, of the factor of word hashes, and those of its inverse."""
    if len(_POWERS[0]) < size:
        inverse = np.uint64(pow(int(FACTOR), -1, 1 << 64))
        for k, base in enumerate((FACTOR, inverse)):
            _POWERS[k] = np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(size + size // 4, base)]))
    return _POWERS if len(_POWERS[0]) == size else [p[:size] for p in _POWERS]


class Words:
    """The words of some texts: ``start``, ``end`` and ``hash`` of each, in order, and ``doc``, its text.

    Offsets count characters in the texts joined by line breaks; the text ``d`` begins at ``base[d]``.
    """

    def __init__(self, texts: list[str]) -> None:
        kind, value, _ = tables()
        self.size = np.array([len(t) for t in texts], np.int64)
        self.base = np.cumsum(self.size + 1) - self.size - 1
        self.point = np.frombuffer(("\n".join(texts) + "\n").encode("utf-32-le", "surrogatepass"), np.uint32)
        self.kind = kind[self.point]
        inside = self.kind == LETTER
        mark = np.flatnonzero((self.point == 0x27) | (self.point == 0x2019))
        mark = mark[(mark > 0) & (mark < len(inside) - 1)]
        inside[mark] = inside[mark - 1] & inside[mark + 1]
        edge = np.flatnonzero(inside[1:] != inside[:-1]) + 1
        if inside[0]:
            edge = np.concatenate([[0], edge])
        self.start, self.end = edge[::2], edge[1::2]
        self.doc = np.searchsorted(self.base, self.start, "right") - 1
        self.letters = self.end - self.start
        power, inverse = powers(len(self.point))
        so_far = np.cumsum(value[self.point] * power)
        code = so_far[self.end - 1] - so_far[self.start - 1] * (self.start > 0)
        self.hash = (mix(code * inverse[self.start]) & ~np.uint64(255)) | np.minimum(self.letters, 255).astype(np.uint64)

    def per_text(self, values: np.ndarray) -> np.ndarray:
        """The sums of values of the words, text by text."""
        return np.bincount(self.doc, values, minlength=len(self.size))

    def characters(self, kind: int) -> np.ndarray:
        """How many characters of a class come before each place, and at the end."""
        return np.concatenate([[0], np.cumsum(self.kind == kind)])

    def scripts(self) -> np.ndarray:
        """The characters of each script, by text; column 0 holds all others."""
        doc = np.repeat(np.arange(len(self.size)), self.size + 1)
        script = tables()[2][self.point]
        return np.bincount(doc * (len(SCRIPTS) + 1) + script, minlength=len(self.size) * (len(SCRIPTS) + 1)).reshape(len(self.size), -1)

    def longest(self) -> np.ndarray:
        """The longest run without white space in each text."""
        gaps = np.concatenate([[-1], np.flatnonzero(self.kind == SPACE)])
        out = np.zeros(len(self.size), np.int64)
        np.maximum.at(out, np.searchsorted(self.base, gaps[:-1] + 1, "right") - 1, np.diff(gaps) - 1)
        return out


def hashed(words: Iterator[str] | list[str]) -> np.ndarray:
    """The sorted distinct hashes of given words."""
    return np.unique(Words(sorted(set(words))).hash) if words else np.zeros(0, np.uint64)


def member(values: np.ndarray, known: np.ndarray) -> np.ndarray:
    """Which of ``values`` are in the sorted array ``known``."""
    if not len(known):
        return np.zeros(len(values), bool)
    at = np.minimum(np.searchsorted(known, values), len(known) - 1)
    return known[at] == values


def chunked(texts: list[str | None], most: int = CHUNK) -> Iterator[tuple[int, list[str]]]:
    """The texts, null as empty, some at a time, with the place of the first."""
    start = held = 0
    for k, text in enumerate(texts):
        held += len(text or "") + 1
        if held > most or k == len(texts) - 1:
            yield start, [t or "" for t in texts[start : k + 1]]
            start, held = k + 1, 0
