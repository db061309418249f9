"""Similarities of word sets and vectors: Column in, Column out."""

from __future__ import annotations

from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from docquarry.functions.lexicon import GOVERNMENT_TERMS, STOP_WORDS
from docquarry.functions.text import array_of, meaningful_cased, words


def jaccard(a: Column, b: Column) -> Column:
    """Common distinct elements by all distinct elements; 0 if either is empty."""
    both, either = F.size(F.array_intersect(a, b)), F.size(F.array_union(a, b))
    return F.when((F.size(a) == 0) | (F.size(b) == 0), 0.0).otherwise(both / either)


def content_words(c: Column) -> Column:
    """The distinct lower-cased words of a text but the stop words."""
    return F.array_except(words(c), array_of(STOP_WORDS))


def boosted_jaccard(a: Column, b: Column) -> Column:
    """The Jaccard similarity of two arrays of content words, raised for shared official terms."""
    shared = F.size(F.array_intersect(F.array_intersect(a, b), array_of(GOVERNMENT_TERMS)))
    return F.when((F.size(a) == 0) | (F.size(b) == 0), 0.0).otherwise(F.least(jaccard(a, b) + F.least(shared * 0.05, F.lit(0.15)), F.lit(1.0)))


def simple_similarity(a: Column, b: Column) -> Column:
    """The Jaccard similarity of the meaningful words in their own case."""
    return jaccard(F.array_distinct(meaningful_cased(a)), F.array_distinct(meaningful_cased(b)))


def containment(a: Column, b: Column) -> Column:
    """The part of the distinct elements of ``a`` that ``b`` holds; 0 if ``a`` is empty."""
    own = F.array_distinct(a)
    return F.when(F.size(own) == 0, 0.0).otherwise(F.size(F.array_intersect(own, b)) / F.size(own))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    """The normalised dot product, 0 for a vector of zeros."""
    size = norm(a) * norm(b)
    return F.when(size == 0, 0.0).otherwise(dot(a, b) / size)


@F.pandas_udf(DoubleType())
def ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    """Twice the matched characters by all characters, matched blocks found from the longest on."""
    out, last, matcher = [], None, SequenceMatcher()
    for x, y in zip(a, b, strict=True):
        if x is None or y is None:
            out.append(None)
            continue
        if y != last:
            matcher.set_seq2(y)
            last = y
        matcher.set_seq1(x)
        out.append(matcher.ratio())
    return pd.Series(out, dtype="float64")


def encoder(model, batch: int = 16):
    """A function of a text column that gives the vectors of ``model``, which takes a list of texts; null texts as empty, some at a time."""

    @F.pandas_udf("array<float>")
    def encode(texts: pd.Series) -> pd.Series:
        own = texts.fillna("").tolist()
        return pd.Series([[float(x) for x in v] for k in range(0, len(own), batch) for v in model(own[k : k + batch])])

    return encode
