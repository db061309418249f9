"""Problem 1: text quality statistics of every document and a verdict: prose, list, table or junk.

Counts and ratios of words, symbols, lines and common words come with repetition statistics (duplicate
lines and paragraphs, characters covered by the most frequent n-grams). Sentences are the units of the
verdict: a sentence counts as running when it ends as one, holds enough words and, in scripts with
spaces, enough of them are common in the corpus; list entries, table rows and unreadable stretches do
not. A text is prose when running sentences hold at least half of its characters without white space,
unless its repetition shows boilerplate: most of its lines or paragraphs repeat earlier ones and one
sequence of four words covers a seventh of its letters.

Defined results: null, empty and blank texts have zero counts, null ratios and the verdict ``empty``;
repeated rows come out as often as they came in; an empty table gives an empty table.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docquarry.llm.corpus import head
from docquarry.llm.sentences import languages, spans
from docquarry.llm.words import DIGIT, SPACE, Words, chunked, member

COMMON_SHARE = 0.001  # part of all texts that must hold a word for it to be common
LEAST_COMMON = 0.35  # part of a sentence's words that must be common for it to be readable
MOST_REPEATED, MOST_COVERED = 0.6, 0.15  # of the lines or paragraphs, and of the letters, beyond which a text is boilerplate
SCHEMA = (
    "doc_id bigint, words bigint, chars bigint, mean_word_length double, symbol_ratio double, digit_ratio double, lines bigint, line_end_share double, "
    "bullet_line_share double, short_line_share double, common_share double, duplicate_line_share double, duplicate_paragraph_share double, "
    "top_2gram_share double, top_3gram_share double, top_4gram_share double, sentences bigint, running_share double, verdict string"
)
COLUMNS = [c.split()[0] for c in SCHEMA.split(", ")]
STOPS = frozenset(".!?…。！？।؟;;")
CLOSING = "\"”»’')]」』）"
NUMBER_LINE = re.compile(r"(?:^|\n)\s*\(?\d{1,3}[.)]$")
BULLET = re.compile(r"[ \t]*(?:[-*•◦▪·‣●○–—+>]|\[[ xX✓]?\]|\(?(?:\d{1,3}|[A-Za-z]|[ivxIVX]{1,4})[.)]|\d+(?:\.\d+)+)[ \t]+\S")
GAP = re.compile(r"\S {3,}\S")
COMMAS = re.compile(r"[^,\n]*(?:,[^,\n ][^,\n]*){3,}$")
SPACELESS = frozenset(("zh", "ja", "th"))
PARAGRAPH = re.compile(r"\n\s*\n")
URLISH = re.compile(r"%[0-9A-Fa-f]{2}|\w=\w|0x[0-9a-f]|(?<![A-Za-z0-9+/])[A-Za-z0-9+/]{40}")


def may_hold_codes(text: str, longest: int) -> bool:
    """Whether encoded addresses, assignments or very long unbroken strings are anywhere in ``text``, whose longest run has so many characters."""
    return ("=" in text or "%" in text or "0x" in text or longest >= 40) and URLISH.search(text) is not None


def ends_sentence(s: str) -> bool:
    """Whether a stop, perhaps with closing quotes or brackets after it, is the last of ``s``."""
    return s.rstrip(CLOSING)[-1:] in STOPS


def has_cells(s: str, lines: list[str]) -> bool:
    """Whether ``s`` is laid out in columns: by tabs, bars, wide gaps or commas without spaces."""
    return "\t" in s or " | " in s or "   " in s and GAP.search(s) is not None or s.count(",") > 2 and any(COMMAS.match(x) for x in lines)


def running(s: str, words: int, letters: int, common: int, solid: int, lang: str, urlish: bool) -> bool:
    """Whether the sentence ``s`` is running text.

    It has so many words with so many letters, so many of them common, and ``solid`` characters that are no white space;
    ``urlish``: its text holds codes or addresses somewhere.
    """
    spaced = lang not in SPACELESS
    if spaced and (words < 2 or letters < 0.5 * solid or common < LEAST_COMMON * words):
        return False
    end = ends_sentence(s)
    if not end and lang != "th":
        return False
    lines = s.split("\n") if "\n" in s else [s]
    if len(lines) > 1:
        if sum([BULLET.match(x) is not None for x in lines]) * 3 > len(lines):
            return False
        if len(lines) > 3 and sum(map(len, lines[:-1])) / (len(lines) - 1) < (38 if spaced else 18):
            return False
    if len(s) < 90 and NUMBER_LINE.search(s):
        return False
    if BULLET.match(s) and not (end and len(s) > 60):
        return False
    if has_cells(s, lines) or urlish and URLISH.search(s):
        return False
    if lang == "th":
        return len(s) >= 15 and ";" not in s
    return spaced or len(s) >= 6


def top_ngrams(own: Words) -> np.ndarray:
    """Per text the letters covered by its most frequent 2-, 3- and 4-gram, 0 where none comes more than once; of equal ones the longest.

    All texts' words are counted together as numbers, each text apart from the others.
    """
    texts, doc, size = len(own.size), own.doc, own.letters
    out = np.zeros((texts, 3), np.int64)
    names, code = np.unique(own.hash, return_inverse=True)
    names = range(len(names))
    at, length = np.arange(len(code)), size
    gram = np.unique(doc * len(names) + code, return_inverse=True)[1]
    for n in (2, 3, 4):
        inside = at + n - 1 < len(code)
        inside[inside] = doc[at[inside] + n - 1] == doc[at[inside]]
        at, gram, length = at[inside], gram[inside], length[inside] + size[at[inside] + n - 1]
        if not len(at):
            break
        gram, count = np.unique(gram * len(names) + code[at + n - 1], return_inverse=True, return_counts=True)[1:]
        times = count[gram]
        again = times > 1  # a longer one repeats only where this one does
        at, gram, length, times = at[again], gram[again], length[again], times[again]
        most = np.zeros(texts, np.int64)
        np.maximum.at(most, doc[at], times)
        best = times == most[doc[at]]
        np.maximum.at(out[:, n - 2], doc[at[best]], (length * times)[best])
    return out


class Weighed:
    """Some texts with their words, languages and sentences, and what of their characters is running text."""

    def __init__(self, texts: list[str], common: np.ndarray, langs: list[str] | None = None) -> None:
        own = self.words = Words(texts)
        self.texts, self.langs = texts, langs or languages(own)
        self.common = member(own.hash, common)
        self.codes = [may_hold_codes(t, k) for t, k in zip(texts, own.longest().tolist(), strict=True)]
        self.spans = [spans(t, lang) for t, lang in zip(texts, self.langs, strict=True)]
        count = [len(x) for x in self.spans]
        place = np.array([x for own_spans in self.spans for x in own_spans], np.int64).reshape(-1, 2) + np.repeat(own.base, count)[:, None]
        before = np.searchsorted(own.start, place)
        blank = own.characters(SPACE)
        solid = place[:, 1] - place[:, 0] - (blank[place[:, 1]] - blank[place[:, 0]])
        sums = [np.concatenate([[0], np.cumsum(x)]) for x in (own.letters, self.common)]
        letters, known = (x[before[:, 1]] - x[before[:, 0]] for x in sums)
        numbers = zip((before[:, 1] - before[:, 0]).tolist(), letters.tolist(), known.tolist(), solid.tolist(), strict=True)
        pieces = ((t[a:b], lang, codes) for t, own_spans, lang, codes in zip(texts, self.spans, self.langs, self.codes, strict=True) for a, b in own_spans)
        run = np.array([running(s, *n, lang, codes) for (s, lang, codes), n in zip(pieces, numbers, strict=True)], bool)
        doc = np.repeat(np.arange(len(texts)), count)
        self.solid = np.bincount(doc, solid, len(texts)).astype(np.int64)
        self.run = np.bincount(doc, solid * run, len(texts)).astype(np.int64)
        self.running, self.sizes = (np.split(x, np.cumsum(count)[:-1]) for x in (run, solid))


def repeated(xs: list[str]) -> float:
    """The share of ``xs`` that repeat an earlier one."""
    return 1 - len(set(xs)) / len(xs)


def all_statistics(keys: list[int], texts: list[str | None], common: np.ndarray) -> Iterator[list]:
    """The rows of many texts."""
    for start, part in chunked(texts):
        made = Weighed(part, common)
        own = made.words
        digit = own.characters(DIGIT)
        columns = (own.per_text(np.ones(len(own.hash))), own.per_text(own.letters), own.per_text(made.common), digit[own.base + own.size] - digit[own.base], made.solid, made.run)
        columns = zip(*(x.astype(np.int64).tolist() for x in columns), top_ngrams(own).tolist(), strict=True)
        for key, text, found, lang, codes, (words, letters, known, digits, solid, run, covered) in zip(keys[start:], part, made.spans, made.langs, made.codes, columns, strict=False):
            if not solid:
                yield [key, 0, len(text), *[None] * 3, 0, *[None] * 6, *[None] * 3, 0, None, "empty"]
                continue
            lines = [x for x in map(str.strip, text.split("\n")) if x]
            paragraphs = [x for x in map(str.strip, PARAGRAPH.split(text)) if x]
            bullets = sum([BULLET.match(x) is not None for x in lines]) / len(lines)
            table = sum([has_cells(x, [x]) for x in lines]) / len(lines)
            share, common_share = run / solid, known / words if words else 0.0
            again = repeated(lines), repeated(paragraphs)
            if share >= 0.5 and not boilerplate(again, covered[2], letters):
                verdict = "prose"
            elif table > 0.5 or digits > 0.15 * solid and common_share > 0.3:
                verdict = "table"
            elif common_share < 0.3 and lang not in SPACELESS or codes and bullets < 0.3 or share >= 0.5:
                verdict = "junk"
            else:
                verdict = "list"
            yield [
                key, words, len(text), letters / words if words else 0.0, max(0, solid - letters - digits) / solid, digits / solid, len(lines),
                sum(map(ends_sentence, lines)) / len(lines), bullets, sum([len(x) < 40 for x in lines]) / len(lines), common_share, *again,
                *(min(1.0, x / max(1, letters)) for x in covered), len(found), share, verdict,
            ]


def boilerplate(again: tuple[float, float], covered: int, letters: int) -> bool:
    """Whether a text says the same over and over: most lines or paragraphs repeat earlier ones and one sequence of four words covers much of it."""
    return max(again) > MOST_REPEATED and covered > MOST_COVERED * letters


def common_words(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", share: float = COMMON_SHARE) -> np.ndarray:
    """The hashes of the words that at least ``share`` of all texts hold, repeated rows of one id and text counted once; their number does not grow with the texts'."""
    return head(df, share, 3, id_col, text_col)


def quality(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", common: np.ndarray | None = None) -> DataFrame:
    """One row of statistics per row of ``df``; ``common``, hashes of words in order, is taken from ``df`` itself if not given."""
    own = df.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("text"))
    shared = df.sparkSession.sparkContext.broadcast(common_words(own) if common is None else common)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pd.DataFrame(all_statistics(pdf["doc_id"].tolist(), pdf["text"].tolist(), shared.value), columns=COLUMNS)

    return own.mapInPandas(run, SCHEMA)
