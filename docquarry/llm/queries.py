"""The registered queries of this subpackage, each over its whole tables with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docquarry.llm import encode, neardup, packing, quality, readability, sentences, splitting, topn
from docquarry.session import spread, table



def texts_of(spark: SparkSession, sf: str, name: str, *columns: str) -> DataFrame:
    """The columns of a table of texts, over all cores."""
    return spread(table(spark, sf, name).select(*columns))


Query = Callable[[SparkSession, str], DataFrame]


def p1_quality(spark: SparkSession, sf: str) -> DataFrame:
    """The quality statistics and verdict of every preprocessed text."""
    return quality.quality(texts_of(spark, sf, "preprocessed_text", "doc_id", "text"))


def p1_found(spark: SparkSession, sf: str) -> DataFrame:
    """Texts that the combined rules do not take for prose."""
    rows = quality.quality(texts_of(spark, sf, "preprocessed_text", "doc_id", "text"))
    return rows.filter(~F.col("verdict").isin("prose", "empty")).select("doc_id").distinct()


def two_kinds(spark: SparkSession, sf: str) -> DataFrame:
    """Recommendations (kind 0) and responses (kind 1) as one table."""
    tables = (("recommendations", "rec_key"), ("responses", "resp_key"))
    first, second = (texts_of(spark, sf, name, key, "text").select(F.lit(k).alias("kind"), F.col(key).alias("id"), "text") for k, (name, key) in enumerate(tables))
    return first.unionByName(second)


def kind_name() -> Column:
    return F.when(F.col("kind") == 0, "recommendation").otherwise("response").alias("kind")


def p2_found(spark: SparkSession, sf: str) -> DataFrame:
    """All pairs of recommendations and of responses that repeat one another."""
    return neardup.record_pairs(two_kinds(spark, sf)).select(kind_name(), "id_a", "id_b")


def p2_groups(spark: SparkSession, sf: str) -> DataFrame:
    """Every recommendation and response of enough words with its group of near-duplicates."""
    return neardup.record_groups(two_kinds(spark, sf)).select(kind_name(), "id", "group_id", "links")


def p3_found(spark: SparkSession, sf: str) -> DataFrame:
    """The best items of every query, document and recommendation."""
    results, aligned, lists = (table(spark, sf, t) for t in ("search_results", "alignments", "document_results"))
    number = F.regexp_extract("document_id", r"^D(\d+)$", 1).try_cast("bigint")
    search = topn.top_n(topn.last_version(results, "result_id", "scored_at", "query_id", "relevance_score"), "query_id", "result_id", "relevance_score", 5, raw=results, raw_group=F.col("query_id"))
    alignment = topn.top_n(topn.last_version(aligned, "align_id", "scored_at", "rec_key", "similarity"), "rec_key", "align_id", "similarity", 3, raw=aligned, raw_group=F.col("rec_key"))
    elements = lists.select(number.alias("document"), F.explode("results"))
    document = topn.top_n(topn.document_elements(lists), "document", "result_id", "relevance_score", 3, raw=elements, raw_group=F.col("document"))
    kinds = {"search": search, "alignment": alignment, "document": document}
    parts = [df.select(F.lit(kind).alias("kind"), "group_id", "item_id") for kind, df in kinds.items()]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def p4_found(spark: SparkSession, sf: str) -> DataFrame:
    """Where the first overlong sentence of every oversized text begins."""
    texts = texts_of(spark, sf, "preprocessed_text", "doc_id", "text")
    return splitting.long_sentences(texts, quality.common_words(texts))


def p4_pieces(spark: SparkSession, sf: str) -> DataFrame:
    """The pieces of every oversized text."""
    texts = texts_of(spark, sf, "preprocessed_text", "doc_id", "text")
    return splitting.split(texts, quality.common_words(texts))


def p5_found(spark: SparkSession, sf: str) -> DataFrame:
    """The sentences of preprocessed texts without spans and of all recommendations."""
    texts = spread(table(spark, sf, "preprocessed_text").filter(F.col("sentence_spans").isNull()).select("doc_id", "text"))
    parts = {"preprocessed": sentences.sentence_rows(texts, "doc_id"), "recommendation": sentences.sentence_rows(texts_of(spark, sf, "recommendations", "rec_key", "text"), "rec_key")}
    first, second = (df.select(F.lit(kind).alias("kind"), "item_id", "start_at", "end_at") for kind, df in parts.items())
    return first.unionByName(second).distinct()


def p6_ids(spark: SparkSession, sf: str) -> DataFrame:
    """The token ids of every document."""
    return encode.token_ids(texts_of(spark, sf, "documents", "doc_id", "text"))


def p7_containers(spark: SparkSession, sf: str) -> DataFrame:
    """Every document's place in containers of 2,048 tokens."""
    return packing.containers(texts_of(spark, sf, "documents", "doc_id", "text"))


def p8_found(spark: SparkSession, sf: str) -> DataFrame:
    """The easiest and the most demanding English reports."""
    rows = readability.reading_levels(texts_of(spark, sf, "documents", "doc_id", "text"))
    return rows.filter(F.col("band").isNotNull()).select("doc_id", "band").distinct()


def p8_levels(spark: SparkSession, sf: str) -> DataFrame:
    """The reading figures of every document."""
    return readability.reading_levels(texts_of(spark, sf, "documents", "doc_id", "text"))


QUERIES: dict[str, Query] = {f.__name__: f for f in (p1_found, p1_quality, p2_found, p2_groups, p3_found, p4_found, p4_pieces, p5_found, p6_ids, p7_containers, p8_found, p8_levels)}

SQL: dict[str, str] = {
    "p3_found": """
        WITH s AS (SELECT result_id, query_id, relevance_score AS score FROM search_results
                   QUALIFY row_number() OVER (PARTITION BY result_id ORDER BY scored_at DESC NULLS LAST) = 1),
             a AS (SELECT align_id, rec_key, similarity AS score FROM alignments
                   QUALIFY row_number() OVER (PARTITION BY align_id ORDER BY scored_at DESC NULLS LAST) = 1),
             e AS (SELECT document_id, unnest(results) AS r FROM document_results),
             d AS (SELECT TRY_CAST(substr(document_id, 2) AS BIGINT) AS document, r.result_id AS result_id, max(r.relevance_score) AS score
                   FROM e WHERE r.relevance_score IS NOT NULL AND NOT isnan(r.relevance_score) GROUP BY 1, 2),
             x AS (SELECT 'search' AS kind, query_id AS group_id, result_id AS item_id, score, 5 AS n FROM s
                   UNION ALL SELECT 'alignment', rec_key, align_id, score, 3 FROM a
                   UNION ALL SELECT 'document', document, result_id, score, 3 FROM d)
        SELECT kind, group_id, item_id FROM x
        WHERE score IS NOT NULL AND NOT isnan(score) AND group_id IS NOT NULL AND item_id IS NOT NULL
        QUALIFY row_number() OVER (PARTITION BY kind, group_id ORDER BY score DESC, item_id) <= n
    """,
}
