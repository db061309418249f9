"""Small choices and orders of documents, recommendations and alignments."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docquarry.functions.lexicon import RESPONSE_FILES
from docquarry.functions.text import any_contains


def by_method(rows: DataFrame, methods: Sequence[str], column: str = "method") -> DataFrame:
    """The rows found by one of the methods."""
    return rows.filter(F.col(column).isin(list(methods)))


def of_documents(rows: DataFrame, names: Sequence[str] | DataFrame, column: str = "filename") -> DataFrame:
    """The rows of the selected documents; many names come as a table with that column."""
    return rows.join(names.select(column).distinct(), column, "left_semi") if isinstance(names, DataFrame) else rows.filter(F.col(column).isin(list(names)))


def first_of_each_name(docs: DataFrame, name: str = "filename", order: str = "doc_id") -> DataFrame:
    """One document of each file name, the first."""
    columns = [c for c in docs.columns if c != name]
    first = docs.filter(F.col(name).isNotNull()).groupBy(name).agg(F.min_by(F.struct(*columns), order).alias("d"))
    return first.select(*(F.col(c) if c == name else F.col(f"d.{c}").alias(c) for c in docs.columns))


def suggested_responses(docs: DataFrame, name: str = "filename") -> DataFrame:
    """Documents whose file names suggest that they hold responses."""
    return docs.filter(any_contains(F.lower(name), RESPONSE_FILES))


def by_score(rows: DataFrame, score: str, *ties: str) -> DataFrame:
    """Rows by falling score; rows without one are last."""
    return rows.orderBy(F.desc_nulls_last(score), *ties)
