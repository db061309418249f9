"""Results as CSV, text, Markdown and JSON files, written by the executors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from docquarry.functions.text import clean_html, page, strip, tokens
from docquarry.operators.search import query_words
from docquarry.session import cut


def csv(df: DataFrame, path: str) -> None:
    """CSV with a header, quotes doubled, line breaks kept inside quotes."""
    df.write.mode("overwrite").option("header", "true").option("quoteAll", "true").option("escape", '"').csv(path)


def recommendation_rows(recs: DataFrame) -> DataFrame:
    """Recommendations of more than ten characters, for export."""
    return recs.filter(F.length(strip(F.col("text"))) > 10)


def numbered(rows: DataFrame, name: str, *order: Column | str) -> DataFrame:
    """``rows`` with their number in the given order, from 1.

    The rows are range-partitioned and sorted, and each partition numbers its own from where the one before it ends; only
    the partitions' sizes come together. The rows are written first, since finding the ranges reads them once more.
    """
    spread = cut(rows).repartitionByRange(*order).withColumn("__part", F.spark_partition_id())
    held = cut(spread.withColumn("__own", F.row_number().over(Window.partitionBy("__part").orderBy(*order))))
    sizes = held.groupBy("__part").agg(F.count(F.lit(1)).alias("__size"))
    before = F.coalesce(F.sum("__size").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = F.broadcast(sizes.select("__part", before.alias("__before")))  # as many rows as partitions
    return held.join(starts, "__part").select((F.col("__before") + F.col("__own")).cast("bigint").alias(name), *rows.columns)


def search_rows(matches: DataFrame, query: str) -> DataFrame:
    """Matches numbered by falling score with the columns of the search export.

    ``match_type``, ``context`` and ``percentage_through`` are taken where they are there.
    """
    has = lambda c, other: F.col(c) if c in matches.columns else other
    context = clean_html(has("context", F.col("matched_text")))
    rows = matches.select(
        F.lit(query).alias("Query"), F.lit(", ".join(query_words(query))).alias("Meaningful_Words"), has("filename", F.col("doc_id").cast("string")).alias("Document"), has("match_type", F.lit("Unknown")).alias("Match_Type"),
        F.col("score").alias("Score"), has("page_number", page(F.col("position"))).alias("Page_Number"), F.col("position").alias("Position"), has("percentage_through", F.lit(0.0)).alias("Percentage_Through"), context.alias("Complete_Context"),
    )
    rows = rows.withColumn("Word_Count", F.size(tokens(F.col("Complete_Context")))).withColumn("Character_Count", F.length("Complete_Context"))
    return numbered(rows, "Match_Number", F.desc("Score"), "Document", "Position", "Complete_Context")


def semantic_rows(results: DataFrame) -> DataFrame:
    return results.select(F.col("filename").alias("Document"), F.format_number("relevance_score", 3).alias("Relevance"), F.col("text_fragment").alias("Text"), F.array_join("matched_concepts", ", ").alias("Matched_Concepts"))


def alignment_rows(aligned: DataFrame) -> DataFrame:
    """One row an alignment with the columns of the alignment export, in the order of the recommendations."""
    rows = aligned.select(
        "rec_key", F.coalesce("rec_text", F.lit("")).alias("RecommendationText"), F.coalesce("confidence", F.lit(0.0)).alias("RecommendationConfidence"), F.coalesce("method", F.lit("unknown")).alias("RecommendationMethod"),
        F.when(F.col("has_response"), F.coalesce("status", F.lit("Unclear"))).otherwise("No Response").alias("ResponseStatus"), F.when(F.col("has_response"), F.coalesce("similarity", F.lit(0.0))).otherwise(0.0).alias("ResponseSimilarity"),
        F.when(F.col("has_response"), F.coalesce("resp_text", F.lit(""))).otherwise("").alias("ResponseText"), F.when(F.col("has_response"), F.coalesce("match_method", F.lit("semantic"))).otherwise("").alias("ResponseMatchMethod"),
        F.when(F.col("has_response"), F.coalesce("source_document", F.lit("unknown"))).otherwise("").alias("ResponseSourceDocument"), F.coalesce("has_response", F.lit(False)).alias("HasResponse"),
    )
    return numbered(rows, "AlignmentIndex", "rec_key").drop("rec_key")


def nested_alignment_rows(aligned: DataFrame, recs: DataFrame, resps: DataFrame) -> DataFrame:
    """One row a recommendation with its best response of all documents, by falling confidence of its detection.

    ``aligned`` is what ``align.nested`` gives; ``recs`` has ``text``, ``verb``, ``method``, ``confidence`` and ``source_document``, ``resps`` the last and ``text``.
    """
    top = F.get("responses", F.lit(0))
    percent = lambda c: F.concat(F.bround(F.coalesce(c, F.lit(0.0)) * 100).cast("int").cast("string"), F.lit("%"))
    own = recs.select("rec_key", "text", F.coalesce("verb", F.lit("unknown")).alias("verb"), F.coalesce("method", F.lit("unknown")).alias("method"), F.coalesce("confidence", F.lit(0.0)).alias("confidence"), "source_document")
    other = resps.select("resp_key", F.col("text").alias("resp_text"), F.col("source_document").alias("resp_document"))
    rows = aligned.withColumn("resp_key", top["resp_key"]).join(own, "rec_key").join(other, "resp_key", "left")
    rows = rows.select(
        "rec_key", "confidence", F.col("text").alias("Recommendation"), F.col("verb").alias("Action Verb"), F.col("method").alias("Detection Method"), percent(F.col("confidence")).alias("Detection Confidence"),
        F.col("source_document").alias("Document"), F.col("alignment_status").alias("Alignment Status"), F.greatest(F.coalesce(F.size("responses"), F.lit(0)), F.lit(0)).alias("Response Count"),
        F.coalesce("resp_text", F.lit("No response found")).alias("Top Response"), F.coalesce("resp_document", F.lit("")).alias("Response Document"), percent(top["combined_score"]).alias("Alignment Confidence"),
    )
    return numbered(rows, "ID", F.desc("confidence"), "rec_key").drop("rec_key", "confidence")


def document_report(matches: DataFrame, text: str = "matched_text", order: str = "position") -> DataFrame:
    """One text a document: its matches in order."""
    lines = F.array_sort(F.collect_list(F.struct(order, F.col(text).alias("line"))))
    body = F.array_join(F.transform(lines, lambda x, i: F.concat((i + 1).cast("string"), F.lit(". "), x["line"])), "\n")
    return matches.groupBy("doc_id").agg(F.concat(F.lit("Document "), F.first("doc_id").cast("string"), F.lit("\n"), body).alias("value"))


def markdown(aligned: DataFrame, at: Column | None = None) -> DataFrame:
    """``part`` and ``value``: a report of alignments with a summary (part 0) and a block for each recommendation, in order."""
    has = F.coalesce("has_response", F.lit(False))
    status = F.when(has, F.coalesce("status", F.lit("No Response"))).otherwise("No Response")
    line = lambda label, n: F.concat(F.lit(f"- {label}: "), n.cast("string"))
    shown = [F.count_if(status == k).alias(k) for k in ("Accepted", "Partial", "Rejected", "No Response")]
    sums = aligned.agg(F.count(F.lit(1)).alias("n"), F.count_if(has).alias("answered"), *shown)
    stamp = F.date_format(F.current_timestamp() if at is None else at, "yyyy-MM-dd HH:mm:ss")
    head = F.array_join(F.array(
        F.lit("# Recommendation-Response Alignment Report"), F.concat(F.lit("Generated: "), stamp), F.lit(""), F.lit("## Summary"), line("Total Recommendations", F.col("n")), line("Responses Found", F.col("answered")),
        *(line(k, F.col(k)) for k in ("Accepted", "Partial", "Rejected", "No Response")), F.lit(""), F.lit("## Details"),
    ), "\n")
    rows = numbered(aligned.select("rec_key", "rec_text", F.when(has, F.col("resp_text")).alias("resp_text"), status.alias("status")), "part", "rec_key")
    body = F.concat(
        F.lit("### Recommendation "), F.col("part").cast("string"), F.lit("\n**Status:** "), F.col("status"), F.lit("\n\n**Recommendation:**\n> "), F.coalesce("rec_text", F.lit("")),
        F.lit("\n\n**Response:**\n> "), F.coalesce("resp_text", F.lit("No response found")), F.lit("\n\n---"),
    )
    return sums.select(F.lit(0).cast("bigint").alias("part"), head.alias("value")).unionByName(rows.select("part", body.alias("value")))


def marker_counts(docs: DataFrame, marker: str) -> DataFrame:
    """``doc_id`` and ``markers``, how often a text holds a footer's wording, in any case, without overlaps."""
    low, wanted = F.lower(F.coalesce("text", F.lit(""))), marker.lower()
    return docs.select("doc_id", ((F.length(low) - F.length(F.replace(low, F.lit(wanted), F.lit("")))) / len(wanted)).cast("int").alias("markers"))


def samples(rows: DataFrame, n: int, *order: str, text: str = "text", most: int = 200) -> DataFrame:
    """The first ``n`` rows with their texts cut at ``most`` characters, for a summary on the screen."""
    return rows.orderBy(*order).limit(n).withColumn(text, F.when(F.length(text) > most, F.concat(F.substring(text, 1, most), F.lit("..."))).otherwise(F.col(text)))


def analytics_report(stats: DataFrame) -> DataFrame:
    """A row of counts as lines of a report."""
    line = lambda c: F.concat(F.lit(c.replace("_", " ").capitalize() + ": "), F.coalesce(F.col(c).cast("string"), F.lit("-")))
    return stats.select(F.array_join(F.array(*(line(c) for c in stats.columns)), "\n").alias("value"))


def sentence_dump(sentences: DataFrame, text: Column | None = None) -> DataFrame:
    """Numbered lines of a document's sentences."""
    own = F.col("sentence") if text is None else text
    return sentences.select("doc_id", F.format_string("[%04d] %s", (F.col("ordinal") + 1).cast("int"), own).alias("value"))


def text(df: DataFrame, path: str) -> None:
    """The ``value`` column as text files."""
    df.select("value").write.mode("overwrite").text(path)


def spans_json(docs: DataFrame, path: str) -> None:
    """Texts with their spans, a JSON object a line."""
    docs.select("text", "sentence_spans", "page_spans").write.mode("overwrite").json(path)
