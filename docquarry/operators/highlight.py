"""Words of a query marked in a text: Column in, Column out."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from docquarry.functions.lexicon import OFFICIAL_TERMS
from docquarry.operators.search import query_words

HTML = ("<mark>", "</mark>")
STYLES = {"html": HTML, "bold": ("**", "**"), "caps": ("**", "**"), "brackets": ("[", "]")}


def _each_match(text: Column, pattern: str, made) -> Column:
    """The text with every match replaced by what ``made`` makes of it."""
    parts, found = F.split(text, pattern, -1), F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    pieces = F.zip_with(parts, found, lambda p, m: F.concat(p, F.coalesce(made(m), F.lit(""))))
    return F.array_join(pieces, "")


def prefixed(text: Column, words: list[str], style: str = "brackets", marks: tuple[str, str] | None = None) -> Column:
    """The text with every word that begins with one of ``words`` marked, longer ones first, those of two letters or fewer skipped.

    Later words are marked inside earlier marks too, as they come. ``caps`` marks as bold and writes the word in capitals.
    """
    left, right = marks or STYLES[style]
    for w in sorted(words, key=len, reverse=True):
        if len(w) > 2:
            pattern = rf"(?i)\b{re.escape(w)}\w*"
            if style == "caps":
                text = _each_match(text, pattern, lambda m: F.concat(F.lit(left), F.upper(m), F.lit(right)))
            else:
                text = F.regexp_replace(text, pattern, f"{_plain(left)}$0{_plain(right)}")
    return text


def whole(text: Column, words: list[str], style: str = "brackets", marks: tuple[str, str] | None = None) -> Column:
    """The text with every one of ``words`` marked where it stands alone, written as in ``words``; ``caps`` writes it in capitals without marks."""
    left, right = marks or STYLES[style]
    for w in sorted(words, key=len, reverse=True):
        pattern = rf"(?i)\b{re.escape(w)}\b"
        if style == "caps":
            text = _each_match(text, pattern, F.upper)
        else:
            text = F.regexp_replace(text, pattern, _plain(left + w + right))
    return text


def _plain(replacement: str) -> str:
    return re.sub(r"([\\$])", r"\\\1", replacement)


def _first_changed(text: Column, variants: list[tuple[str, Column]]) -> Column:
    """``text`` and ``method``: the first variant that differs from the text, else the last."""
    pair = lambda name, made: F.struct(made.alias("text"), F.lit(name).alias("method"))
    return F.coalesce(*(F.when(made != text, pair(name, made)) for name, made in variants[:-1]), pair(*variants[-1]))


def smart(text: Column, query: str, style: str = "auto", mark=prefixed) -> Column:
    """``text`` and ``method``: the words of the query marked in the asked style, or in the first that changes anything; ``none`` without words or text."""
    words = query_words(query)
    names = list(STYLES) if style == "auto" else [style] if mark is whole or style == "brackets" else [style, "brackets"]
    none = F.struct(text.alias("text"), F.lit("none").alias("method"))
    if not words:
        return none
    return F.when(F.coalesce(text, F.lit("")) == "", none).otherwise(_first_changed(text, [(n, mark(text, words, n)) for n in names]))


def official(text: Column) -> Column:
    """``text`` and ``method``: the terms of official reports marked."""
    return _first_changed(text, [(n, prefixed(text, OFFICIAL_TERMS, n)) for n in ("html", "bold", "brackets")])
