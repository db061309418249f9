"""Problem 5: sentence boundaries across languages and scripts, by cascading tables of break and no-break rules.

Every place after a stop is a candidate, in Thai every space. A rule is a pair of regular expressions, one
for the words before the place and one for those that follow; the tables of the text's language come first,
the common ones after them, and the first rule that matches decides. Blank lines always end a sentence, and
nothing breaks inside a quotation or bracket that closes within its paragraph. Rules see the whole last word
before a place, the one before it where they ask for it, and the two words after it; of a word of more than
64 characters the nearest 64, for no rule names so long a word.

Defined results: null, empty and blank texts have no sentences; spans are ordered, do not overlap and
leave out the white space around sentences; offsets count characters.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docquarry.llm.words import SCRIPTS, Words, chunked, hashed, member


@dataclass(frozen=True)
class Rule:
    """Breaks (or not) where ``before`` matches the words up to a place and ``after`` what follows it.

    ``before`` has to match from the start of the last word, or of the word before it (``wide``).
    """

    breaks: bool
    before: str
    after: str = ""
    wide: bool = False


def _words(*words: str) -> str:
    return "(?i:" + "|".join(re.escape(w) for w in words) + r")\."


LEAD = r"""[\s(\[{"'“‘«„¿¡\-–—]*(?:[^\W\d_]+['’])?"""  # what a word may carry in front, such as an elided article
LABEL = "a label before the sentence, not its end"
OPENING = "\"'“‘«„「『（(\\[{¿¡"
LOWER = "a-zßà-öø-ÿāăąćĉčďđēėęěĝğģĥīįķļľłńņňőœřśŝşšťūŭůűųŵŷźżžα-ώἀ-ἇἰ-ἷάέήίόύώ"
CAPITAL = rf"\s*[{OPENING}]*\s*(?:[^\W\d_{LOWER}]|[a-z][A-Z])"
DIGIT = r"\s*[(\[]?[£$€]?\d"

# Abbreviations that stand before a name, a number or more text, by language.
TITLES = ["Dr", "Mr", "Mrs", "Ms", "Prof", "Rev", "Sgt", "Cllr", "St", "Messrs", "Hon", "Capt", "Lt", "Col", "Gen", "Insp", "Supt", "Fr", "Sr", "Sra", "Srta", "Dra", "Dña", "Mme", "Mlle", "Hr", "Hrn", "Fr", "Frl", "Sig", "ul", "al", "inż", "mgr", "prof"]
BEFORE_NUMBERS = ["para", "paras", "Fig", "Figs", "vol", "vols", "no", "nos", "s", "ss", "sec", "ch", "p", "pp", "pg", "approx", "art", "arts", "pág", "págs", "env", "ca", "ok", "Nr", "nr", "núm", "ust", "poz", "str", "Abs", "Art", "Bd", "άρθ", "αρ", "σελ", "ref", "max", "min", "est", "circa", "c", "tel", "ext", "Rec", "rec"]
MONTHS = ["Jan", "Feb", "Mar", "Apr", "May", "Jun", "Jul", "Aug", "Sep", "Sept", "Oct", "Nov", "Dec"]
INSIDE = ["i.e", "e.g", "viz", "cf", "esp", "incl", "vs", "approx", "ref", "et al", "resp", "h.y", "π.χ", "δηλ", "bzw", "z.B", "d.h", "u.a", "tj", "np", "tzn", "p.ej", "p. ej", "p. ex", "z. B", "d. h"]
GERMAN_MONTHS = ["Januar", "Februar", "März", "April", "Mai", "Juni", "Juli", "August", "September", "Oktober", "November", "Dezember"]

COMMON = [
    Rule(False, r".*", r"\s*[,:)\]}”»’]"),
    Rule(False, LEAD + r"(?:\d{1,3}|[A-Za-z]|[ivxIVX]{1,4})[.)]", LABEL),
    Rule(False, LEAD + _words(*TITLES), r"\s*\S"),
    Rule(False, LEAD + _words(*INSIDE), r"\s*\S"),
    Rule(False, LEAD + _words(*BEFORE_NUMBERS, *MONTHS), DIGIT),
    Rule(False, r"[^a-z]*\.", r"\s*(?:AND|OR|WAS|WERE|IS|ARE|HAD|HAS|HAVE|BUT|WHICH)\s(?!.*[a-z])"),
    Rule(True, r"(?:[£$€]?[\d.,]*\d ?[Mm]|\d[\d.:]* ?[AaPp]\.[Mm])\.", CAPITAL + "|" + DIGIT, wide=True),
    Rule(False, LEAD + r"(?:[A-Z]\.)+", r"\s*[A-Z]"),  # initials
    Rule(False, r".*", rf"\s*[{LOWER}](?![A-Z])"),
    Rule(True, r".*[!?…؟]", r"(?:\s|$)"),
    Rule(False, r".*\d\.", r"\d"),
    Rule(True, r".*", r"\s+(?:" + CAPITAL + "|" + DIGIT + r"|[•◦▪·*\-–—])"),
    Rule(True, rf".*(?:[{LOWER}]{{2}}|\d|[)”’\"»]|[ap]\.m)[.!?…]+.?", CAPITAL),
    Rule(True, r"[^\W\d_]{3,}[.!?]", r"[A-Z]+['’]?[A-Z]*\s"),  # a lost space between capitals
]

# The place after a stop, by language: tables that come before the common one.
TABLES: dict[str, list[Rule]] = {
    "en": [],
    "fr": [Rule(False, LEAD + r"(?:M|MM|p|P)\.", r"\s*\S")],
    "es": [Rule(False, LEAD + r"(?:p|P|D|Ud|Uds)\.", r"\s*\S")],
    "de": [
        Rule(False, LEAD + r"\d{1,2}\.", r"\s*(?:" + "|".join(GERMAN_MONTHS) + ")"),
        Rule(False, LEAD + r"(?:[zduaozsi])\.", r"\s*[A-Za-z]\."),
    ],
    "pl": [Rule(False, LEAD + r"(?:p|pp|św|im|os|pl|dot|wg)\.", r"\s*\S")],
    "cy": [],
}
CASELESS = [
    Rule(False, r".*", r"\s*[,:)\]}”»’،]"),
    Rule(False, LEAD + r"(?:د|أ|م|ص|ج|डॉ|श्री|प्रो|सं|पं)\.", r"\s*\S"),
    Rule(False, LEAD + _words(*TITLES, *INSIDE), r"\s*\S"),
    Rule(False, LEAD + _words(*BEFORE_NUMBERS, *MONTHS), DIGIT),
    Rule(False, LEAD + r"\d{1,3}[.)]", LABEL),
    Rule(False, r".*\d\.", r"\d"),
    Rule(False, r".*[.]", r"[A-Za-z0-9]"),
    Rule(True, r".*", r"(?:\s|$)"),
    Rule(True, r".*[.!?…؟।]+.?", r"[^\W\d_A-Za-z]"),
]
UNSPACED = [
    Rule(False, r".*[」』”’）)]", r"[とっ，、,的]"),
    Rule(False, r".*", r"[、，,；;）)]"),
    Rule(False, LEAD + _words(*TITLES, *INSIDE), r"\s*\S"),
    Rule(False, r"(?:.*[^A-Za-z])?" + _words(*BEFORE_NUMBERS, *MONTHS), DIGIT),
    Rule(False, LEAD + r"\d{1,3}\.", LABEL),
    Rule(True, r".*"),
]
THAI = [Rule(True, r".*[฀-๿”’\"»)!?…]", r"\s*[฀-๿“‘\"«(A-Z]")]
WHOLE = {"ar": CASELESS, "hi": CASELESS, "zh": UNSPACED, "ja": UNSPACED, "th": THAI}  # tables that the common one does not follow

# Frequent function words that tell the languages of the Latin script apart; none of one letter, which lists use as labels.
FUNCTION_WORDS = {
    "en": "the of and to was for in by that is with on at from has this it be will".split(),
    "fr": "le la les des une est dans pour sur du et au avec qui par pas que ce aux ont".split(),
    "de": "der die das und den dem von für nicht ein eine im des auf nach am mit ist zu".split(),
    "es": "el la los las del una en por con para que se al de es lo como su".split(),
    "cy": "yr yn ar mae'r wedi ei gan heb pwy pam ac ni mae i'r a'r o'r".split(),
    "pl": "na się nie przy oraz że jest od bez dla po jak za jego przez tylko".split(),
}
LATIN = list(FUNCTION_WORDS)
_HASHES = hashed([w for own in FUNCTION_WORDS.values() for w in own])
_OF = np.array([np.isin(_HASHES, hashed(own)) for own in FUNCTION_WORDS.values()]).T  # which language has which word
_WEIGHT = np.array([1 / (1 + 0.02 * len(own)) for own in FUNCTION_WORDS.values()])


def function_words(own: Words) -> np.ndarray:
    """Which of the function words of all languages are in each text."""
    found = member(own.hash, _HASHES)
    out = np.zeros((len(own.size), len(_HASHES)), bool)
    out[own.doc[found], np.searchsorted(_HASHES, own.hash[found])] = True
    return out


def decided(scripts: np.ndarray, functions: np.ndarray, sizes: np.ndarray) -> list[str]:
    """The language whose rules each text gets: by its script, and in the Latin script by its function words, English first."""
    count = scripts.astype(np.int64)
    both = count[:, 5] + count[:, 6]  # Chinese and Japanese say more with a character
    japanese = (count[:, 5] * 8 > both) & (both > 0)
    count[:, 5], count[:, 6] = np.where(japanese, 3 * both, 0), np.where(japanese, 0, 3 * both)
    best = count[:, 1:].argmax(1)
    by_script = count[np.arange(len(count)), best + 1] * 4 > sizes
    by_words = ((functions[:, :, None] & _OF).sum(1) * _WEIGHT).argmax(1)
    return [SCRIPTS[s] if yes else LATIN[w] for s, yes, w in zip(best.tolist(), by_script.tolist(), by_words.tolist(), strict=True)]


def languages(own: Words) -> list[str]:
    """The language of each text."""
    return decided(own.scripts(), function_words(own), own.size)


def language(text: str) -> str:
    return languages(Words([text]))[0]


class Cascade:
    """A language's tables, with neighbouring rules of one kind joined into one expression each."""

    def __init__(self, rules: list[Rule]) -> None:
        self.blocks: list[tuple[bool, re.Pattern, bool]] = []
        for rule in rules:
            part = f"(?:{rule.before})\0(?:.*\1)" if rule.after is LABEL else f"(?:{rule.before})\0(?:{rule.after})"
            if self.blocks and self.blocks[-1][0] == rule.breaks and self.blocks[-1][2] == rule.wide:
                self.blocks[-1] = (rule.breaks, self.blocks[-1][1] + "|" + part, rule.wide)
            else:
                self.blocks.append((rule.breaks, part, rule.wide))
        self.blocks = [(b, re.compile(p, re.S), w) for b, p, w in self.blocks]
        self.seen: dict[str, bool] = {}

    def decide(self, wide: str, narrow: str, after: str, label: bool) -> bool:
        key = f"{wide}\0{after}{chr(1) if label else ''}"
        found = self.seen.get(key)
        if found is None:
            window = f"{narrow}\0{after}{chr(1) if label else ''}"
            found = next((b for b, p, w in self.blocks if p.match(key if w else window)), False)
            if len(self.seen) > 200_000:
                self.seen.clear()
            self.seen[key] = found
        return found


_CASCADES: dict[str, Cascade] = {}


def cascade(lang: str) -> Cascade:
    if lang not in _CASCADES:
        own = TABLES.get(lang, [])
        _CASCADES[lang] = Cascade(WHOLE.get(lang) or own + COMMON)
    return _CASCADES[lang]


BLANK = re.compile("\\n[^\\S\\n]*\\n\\s*|[\\f\u2029]\\s*")
BLANK_LINE = re.compile("\\n[^\\S\\n]*\\n\\s*")  # the same where there are no other breaks
CLOSING = "[\"”»’')\\]]*"
EVENTS = {
    "latin": re.compile("[.!?…]+" + CLOSING),
    "el": re.compile("[.!?…;;]+" + CLOSING),
    "caseless": re.compile("[.!?…।؟]+" + CLOSING),
    "cjk": re.compile(r"[。！？!?．｡]+[」』”’）)\]]*|\.(?=\s|$)"),
    "th": re.compile(r"(?=[^\S\n])(?<!\s)"),
}
KIND = {"el": "el", "ar": "caseless", "hi": "caseless", "ja": "cjk", "zh": "cjk", "th": "th"}
CAPITALISED = frozenset(f"{gap}{chr(65 + a)}{chr(97 + b)}" for gap in " \n" for a in range(26) for b in range(26))  # what begins a sentence in the plain case
SHORTENED = frozenset(w.lower() for w in TITLES + INSIDE) | {"dot"} | {"".join(x) for n in (3, 4) for x in product("ivx", repeat=n)}
FAR = 64
NEXT = re.compile(rf"\s*\S{{0,{FAR}}}(?:\s+\S{{0,{FAR}}})?\s?")
PROTECT = re.compile(r"[“„«\"「『（(\[{]")
CLOSERS = {"“": "”", "„": "”“", "«": "»", '"': '"', "「": "」", "『": "』", "（": "）", "(": ")", "[": "]", "{": "}"}


def _protected(text: str, start: int, end: int) -> list[tuple[int, int]]:
    """The quotations and brackets of a paragraph, outermost only, unclosed ones left out."""
    out: list[tuple[int, int]] = []
    at = start
    while m := PROTECT.search(text, at, end):
        close = CLOSERS[m[0]]
        ends = [e for e in (text.find(c, m.end(), end) for c in close) if e >= 0]
        if not ends:
            at = m.end()
            continue
        shut = min(ends)
        if m[0] in "([{（" and (k := text.count(m[0], m.end(), shut)):  # nested brackets
            for _ in range(k):
                further = text.find(close, shut + 1, end)
                if further < 0:
                    break
                shut = further
        out.append((m.start(), shut + 1))
        at = shut + 1
    return out


def _paragraph(text: str, start: int, end: int, lang: str) -> Iterator[tuple[int, int]]:
    """The sentences of a paragraph without white space around it."""
    covered, k = _protected(text, start, end), 0
    kind, rules = KIND.get(lang, "latin"), cascade(lang)
    latin = kind == "latin"
    for m in EVENTS[kind].finditer(text, start, end):
        stop, at = m.start(), m.end()
        if at >= end or at <= start:
            continue
        while k < len(covered) and covered[k][1] <= stop:
            k += 1
        if k < len(covered) and covered[k][0] < stop:
            shut = covered[k][1]
            if shut > at or shut <= stop:
                continue
            at = shut  # the stop is the last thing inside; what follows decides
            while at < end and text[at] in "\"”»’')]」』":
                at += 1
        if not (latin and text[at : at + 3] in CAPITALISED and at == stop + 1 and _plain(text[max(start, stop - 12) : stop])) and not _decide(text, start, stop, at, end, rules):
            continue
        yield start, at
        start = at
        while start < end and text[start].isspace():
            start += 1
    if start < end:
        yield start, end


def _plain(before: str) -> bool:
    """Whether the last word is one that no rule names, so that a capitalised word after a stop begins a sentence."""
    word = before[before.rfind(" ") + 1 :]
    return len(word) > 2 and word.isalpha() and word.isascii() and word.islower() and word not in SHORTENED


def _decide(text: str, start: int, stop: int, at: int, end: int, rules: Cascade) -> bool:
    low = max(start, stop - FAR)
    words = text[low:stop].split()
    narrow = wide = text[stop:at]
    label = False
    if words and not text[stop - 1].isspace():
        narrow = wide = words.pop() + narrow
    if len(narrow) <= 6:
        label = not words and low == start
        if words:
            wide = f"{words[-1]} {narrow}"
    return rules.decide(wide, narrow, NEXT.match(text, at, end)[0], label)


def spans(text: str | None, lang: str | None = None) -> list[tuple[int, int]]:
    """The sentences of a text as (start, end), ends exclusive."""
    if not text:
        return []
    lang = lang or language(text)
    out: list[tuple[int, int]] = []
    at, size = 0, len(text)
    blank = BLANK if "\f" in text or "\u2029" in text else BLANK_LINE
    while at < size:
        m = blank.search(text, at)
        end, then = (m.start(), m.end()) if m else (size, size)
        while at < end and text[at].isspace():
            at += 1
        while end > at and text[end - 1].isspace():
            end -= 1
        if at < end:
            for a, b in _paragraph(text, at, end, lang):
                while b > a and text[b - 1].isspace():
                    b -= 1
                while a < b and text[a].isspace():
                    a += 1
                if a < b:
                    out.append((a, b))
        at = then
    return out


def sentence_rows(df: DataFrame, id_col: str, text_col: str = "text") -> DataFrame:
    """``item_id``, ``start_at`` and ``end_at`` of every sentence; one pass, no shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, starts, ends = [], [], []
            keys = batch.column(0).to_pylist()
            for first, texts in chunked(batch.column(1).to_pylist()):
                for key, text, lang in zip(keys[first:], texts, languages(Words(texts)), strict=False):
                    for a, b in spans(text, lang):
                        ids.append(key)
                        starts.append(a)
                        ends.append(b)
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(starts, pa.int32()), pa.array(ends, pa.int32())], ["item_id", "start_at", "end_at"])

    return df.select(F.col(id_col).cast("bigint").alias("item_id"), F.col(text_col).alias("text")).mapInArrow(run, "item_id bigint, start_at int, end_at int")
