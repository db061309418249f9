"""Counts and summaries of documents, recommendations and alignments."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def corpus(docs: DataFrame) -> DataFrame:
    """One row: documents, characters, words and the whole mean of words."""
    n, words = F.count(F.lit(1)), F.coalesce(F.sum("word_count"), F.lit(0))
    return docs.agg(n.alias("documents"), F.coalesce(F.sum(F.length("text")), F.lit(0)).alias("chars"), words.alias("words"), F.when(n > 0, F.floor(words / n)).otherwise(0).alias("mean_words"))


def shares(rows: DataFrame, column: str) -> DataFrame:
    """``column``, ``n`` and ``percent`` of all rows."""
    counted = rows.groupBy(column).agg(F.count(F.lit(1)).alias("n"))
    return counted.withColumn("percent", F.col("n") * 100.0 / F.sum("n").over(Window.partitionBy()))


def status_counts(rows: DataFrame, fold_unclear: bool = False) -> DataFrame:
    """``status`` and ``n``; rows without a response count as such, and unclear ones with them if asked."""
    status = F.coalesce("status", F.lit("No Response"))
    if fold_unclear:
        status = F.when(status == "Unclear", "No Response").otherwise(status)
    return rows.groupBy(status.alias("status")).agg(F.count(F.lit(1)).alias("n"))


def alignment_summary(rows: DataFrame) -> DataFrame:
    """One row: alignments, with a response, the mean similarity and those above 0.7."""
    usable = F.when(~F.isnan("similarity"), F.col("similarity"))
    return rows.agg(F.count(F.lit(1)).alias("total"), F.count_if("has_response").alias("answered"), F.avg(usable).alias("mean_similarity"), F.count_if(usable > 0.7).alias("high"))


def by_document(matches: DataFrame, score: str) -> DataFrame:
    """``doc_id``, ``matches`` and ``best`` of each document's matches."""
    return matches.groupBy("doc_id").agg(F.count(F.lit(1)).alias("matches"), F.max(score).alias("best"))


def recent(history: DataFrame, n: int = 5) -> DataFrame:
    """The last searches, newest first."""
    return history.orderBy(F.desc("searched_at"), "query").limit(n)


def corpus_by(docs: DataFrame, *columns: str) -> DataFrame:
    """``column``, ``value`` and ``n``: how many documents have each value of the columns."""
    each = F.explode(F.array(*(F.struct(F.lit(c).alias("column"), F.coalesce(F.col(c), F.lit("unknown")).alias("value")) for c in columns)))
    return docs.select(each.alias("e")).groupBy("e.column", "e.value").agg(F.count(F.lit(1)).alias("n"))


def size_summary(docs: DataFrame, size: str = "file_size_mb") -> DataFrame:
    """One row: documents, their whole size and the mean of it."""
    return docs.agg(F.count(F.lit(1)).alias("documents"), F.round(F.sum(size), 2).alias("total_mb"), F.round(F.avg(size), 2).alias("mean_mb"))


def document_table(docs: DataFrame, text: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """A line a document: name, type, words, characters and size, and the columns to ``keep``."""
    kind = F.coalesce("document_type", F.lit("general"))
    return docs.select(*keep, "filename", kind.alias("document_type"), F.coalesce("word_count", F.lit(0)).alias("word_count"), F.coalesce(F.length(text), F.lit(0)).alias("chars"), F.coalesce("file_size_mb", F.lit(0.0)).alias("file_size_mb"))


def search_totals(ranked: DataFrame) -> DataFrame:
    """One row about ranked documents: how many, all their matches and their mean score."""
    return ranked.agg(F.count(F.lit(1)).alias("documents"), F.coalesce(F.sum("total_matches"), F.lit(0)).alias("total_matches"), F.avg("overall_score").alias("mean_score"))


def upload_summary(docs: DataFrame) -> DataFrame:
    """One row about documents just read: how many, their words and the whole mean of words."""
    n, words = F.count(F.lit(1)), F.coalesce(F.sum(F.coalesce("word_count", F.lit(0))), F.lit(0))
    return docs.agg(n.alias("documents"), words.alias("words"), F.when(n > 0, F.floor(words / n)).otherwise(0).alias("mean_words"))


def response_kinds(rows: DataFrame) -> DataFrame:
    """One row: responses, and how many are structured or from sentences."""
    kind = F.col("response_type")
    return rows.agg(F.count(F.lit(1)).alias("total"), F.count_if(kind == "structured").alias("structured"), F.count_if(kind == "sentence").alias("sentence_level"))
