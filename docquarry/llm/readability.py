"""Problem 8: how demanding each document is to read.

The familiar words are the short words among those that many texts of the whole corpus hold. A sentence's
grade is a familiar-word formula: a weighted sum of the share of other words and of its number of words. A
text's grade is the mean of its sentences' grades, each counted by its words. An English text is easy or hard
when its grade is beyond the cut of that band and nearly all of its words stand in sentences that are so by
the same formula: short ones of a low grade, or long ones of a high grade.

Extractor dirt is undone first (zero-width and odd spaces, words cut at line ends, repeated page lines),
and lines that are sentences by themselves, as in bulleted leaflets, count as such.

Defined results: null, empty and blank texts have zero counts and null figures; texts that are not
English prose of at least 80 words have a grade but no band; repeated rows come out as often as they
came in; an empty table gives an empty table.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docquarry.llm.corpus import head
from docquarry.llm.sentences import FUNCTION_WORDS, languages, spans
from docquarry.llm.words import Words, chunked, hashed, member

FAMILIAR_SHARE = 0.002  # part of all texts that must hold a word for it to be familiar
FAMILIAR_LETTERS = 6  # letters of a familiar word at most
UNFAMILIAR_WEIGHT, LENGTH_WEIGHT = 15.79, 0.0496  # of the share of unfamiliar words, and of words a sentence
LEAST_WORDS = 80  # white-space separated words of a text with a band
LONGEST = 60  # words of a sentence that its grade counts at most, else a single endless sentence would make a text hard
# The cuts of texts' grades where the ratings of people part best at scale 0.1: 1 from the rest, and 4 from the rest.
EASY_GRADE, HARD_GRADE = 1.7, 9.0
EASY_SENTENCE, HARD_SENTENCE = (5.5, 16), (6.25, 20)  # the most grade and words of an easy sentence, the least of a hard one
THROUGHOUT_EASY, THROUGHOUT_HARD = 0.9, 0.93  # parts of the words that must stand in such sentences
PROSE = 0.7  # part of the words that must stand in sentences with enough function words
SCHEMA = "doc_id bigint, words bigint, sentences bigint, unfamiliar_share double, mean_sentence_words double, grade double, prose_share double, easy_share double, hard_share double, band string"
COLUMNS = [c.split()[0] for c in SCHEMA.split(", ")]
ODD_SPACES = {"\xa0": " ", "\u2009": " ", "\u202f": " ", "\u200b": "", "\xad": "", "\ufeff": "", "\x0c": "\n\n", "\u2028": "\n", "\u2029": "\n\n", "\r": ""}
CUT_WORD = re.compile(r"(?<=[a-z])[-‐]\n(?=[a-z])")
MARK = re.compile(r"[ \t]*(?:[-*•◦▪·‣–—]|\[[ xX]?\]|\(?\d{1,3}[.)])[ \t]+")
FUNCTION = hashed(FUNCTION_WORDS["en"] + "a an as not no or but be are were been which who whose when if so we you your our i he she they them their its there into any all can could did do does had have may must should would than out up it's me my what why how more one because after before during although".split())


def cleaned(text: str) -> str:
    """The text without extractor dirt, its sentence-like lines set apart by blank lines."""
    for odd, plain in ODD_SPACES.items():
        if odd in text:
            text = text.replace(odd, plain)
    if "-\n" in text or "‐\n" in text:
        text = CUT_WORD.sub("", text)
    lines = text.split("\n")
    solid = [x.strip() for x in lines]
    if len(lines) > 3:
        often = {x for x, k in Counter(x for x in solid if x).items() if k > 3 and len(x) < 100}
        if often:
            lines = [x for x, y in zip(lines, solid, strict=True) if y not in often]
    filled = [x for x in lines if x.strip()]
    opens = [MARK.match(x) is not None or x.lstrip()[:1] in "“\"‘" or x.lstrip()[:1].isupper() for x in filled]
    apart = len(filled) > 2 and sum(opens) >= 0.8 * len(filled) and not "".join(filled).isupper()
    return "\n\n".join(MARK.sub("", x) for x in filled) if apart else "\n".join(lines)


def measures(keys: list[int], texts: list[str | None], familiar: np.ndarray) -> Iterator[tuple]:
    """The rows of many texts."""
    for start, part in chunked(texts):
        clean = [cleaned(t) for t in part]
        own = Words(clean)
        langs = languages(own)
        found = [spans(t, lang) for t, lang in zip(clean, langs, strict=True)]
        count = [len(x) for x in found]
        place = np.array([x for f in found for x in f], np.int64).reshape(-1, 2) + np.repeat(own.base, count)[:, None]
        before = np.searchsorted(own.start, place)
        n, odd, function = (x[before[:, 1]] - x[before[:, 0]] for x in (np.concatenate([[0], np.cumsum(y)]) for y in (np.ones(len(own.hash), np.int64), ~member(own.hash, familiar), member(own.hash, FUNCTION))))
        grade = UNFAMILIAR_WEIGHT * odd / np.maximum(1, n) + LENGTH_WEIGHT * np.minimum(n, LONGEST)
        prose = (n > 0) & ((n < 3) | (function >= 0.15 * n))
        easy = (grade <= EASY_SENTENCE[0]) & (n <= EASY_SENTENCE[1])
        hard = (grade >= HARD_SENTENCE[0]) & (n >= HARD_SENTENCE[1])
        doc = np.repeat(np.arange(len(part)), count)
        sums = (np.bincount(doc, x, len(part)).tolist() for x in (n, odd, n > 0, n * grade, n * prose, n * easy, n * hard))
        for key, text, lang, words, other, sentences, graded, prosy, easily, hardly in zip(keys[start:], part, langs, *sums, strict=False):
            if not words:
                yield (key, 0, 0, *[None] * 7)
                continue
            level, band = graded / words, None
            if lang == "en" and len(text.split()) >= LEAST_WORDS and prosy >= PROSE * words:
                if level <= EASY_GRADE and easily >= THROUGHOUT_EASY * words:
                    band = "easy"
                elif level >= HARD_GRADE and hardly >= THROUGHOUT_HARD * words:
                    band = "hard"
            yield (key, int(words), int(sentences), other / words, words / sentences, level, prosy / words, easily / words, hardly / words, band)


def familiar_words(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", share: float = FAMILIAR_SHARE, letters: int = FAMILIAR_LETTERS) -> np.ndarray:
    """The hashes of the short words that at least ``share`` of all texts hold, repeated rows of one id and text counted once; their number does not grow with the texts'."""
    return head(df, share, 2, id_col, text_col, letters)


def reading_levels(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", familiar: np.ndarray | None = None) -> DataFrame:
    """One row of figures per row of ``df``; ``familiar``, hashes of words in order, is taken from ``df`` itself if not given."""
    own = df.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("text"))
    shared = df.sparkSession.sparkContext.broadcast(familiar_words(own) if familiar is None else familiar)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pd.DataFrame(measures(pdf["doc_id"].tolist(), pdf["text"].tolist(), shared.value), columns=COLUMNS)

    return own.mapInPandas(run, SCHEMA)
