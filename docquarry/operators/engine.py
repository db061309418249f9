"""Search by vectors from chunks to ranked documents, and one door to all ways of searching."""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from docquarry.functions.text import array_of, matched_concepts, page
from docquarry.operators import search
from docquarry.operators.segment import chunk_context, chunks, plain_sentences

CHUNK, OVERLAP = 300, 50
ENDS, MOST_SENTENCES = 50, 100  # sentences of a long text that are compared: so many from both ends, if there are more than so many
COLUMNS = ["doc_id", "position", "matched_text", "score", "match_type", "rank"]


def index(docs: DataFrame, target: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """``doc_id``, ``chunk_idx`` and ``chunk`` of documents with a ``text``, or a ``content`` where there is none."""
    given = [F.col(c) for c in ("text", "content") if c in docs.columns]
    return chunks(docs.select("doc_id", F.coalesce(*given).alias("text")), target, overlap)


def _matrix(vectors: Sequence[Sequence[float]]) -> np.ndarray:
    return np.array(vectors, np.float64).reshape(len(vectors), -1)


def best_cosine(vector: Column, variants: Sequence[Sequence[float]]) -> Column:
    """The greatest cosine of a vector with any of a few given ones; 0 for vectors of zeros. Batches are multiplied as matrices."""
    wanted = _matrix(variants)
    wanted = wanted / np.maximum(1e-300, np.sqrt((wanted * wanted).sum(1)))[:, None]

    @F.pandas_udf("double")
    def score(own: pd.Series) -> pd.Series:
        rows = np.stack(own.to_list()).astype(np.float64) if len(own) else np.zeros((0, wanted.shape[1]))
        size = np.sqrt((rows * rows).sum(1))
        return pd.Series((rows @ wanted.T).max(1) / np.where(size == 0, 1.0, size))

    return score(vector)


def dot_with(vector: Column, wanted: Sequence[float]) -> Column:
    """The dot product of a vector with a given one."""
    other = _matrix([wanted])[0]

    @F.pandas_udf("double")
    def score(own: pd.Series) -> pd.Series:
        return pd.Series(np.stack(own.to_list()).astype(np.float64) @ other if len(own) else np.zeros(0))

    return score(vector)


def search_chunks(indexed: DataFrame, variants: Sequence[Sequence[float]], query: str, top_k: int = 20, least: float = 0.3, boost: float = 0.1) -> DataFrame:
    """``doc_id``, ``chunk_idx``, ``text_fragment``, ``full_context``, ``relevance_score``, ``embedding_distance`` and ``matched_concepts``.

    ``indexed`` are chunks with an ``embedding``. A chunk's score is that of the best variant of the query, raised for terms
    of the query in it; of each document the ``top_k`` best that reach ``least`` come out, of equal ones the later first.
    Neighbours and ranks are found in one shuffle by document.
    """
    scored = indexed.withColumn("base", best_cosine(F.col("embedding"), variants)).drop("embedding")
    raised = search.keyword_boost(F.col("base"), F.col("chunk"), query, boost) if boost > 0 else F.col("base")
    scored = chunk_context(scored.withColumn("relevance_score", raised))
    w = Window.partitionBy("doc_id").orderBy(F.desc(F.round("relevance_score", 12)), F.desc("chunk_idx"))
    best = scored.withColumn("r", F.row_number().over(w)).filter((F.col("r") <= top_k) & (F.col("relevance_score") >= least))
    concepts = matched_concepts(F.lit(query), F.col("chunk"))
    return best.select("doc_id", "chunk_idx", F.col("chunk").alias("text_fragment"), F.col("context").alias("full_context"), "relevance_score", (1 - F.col("relevance_score")).alias("embedding_distance"), concepts.alias("matched_concepts"))


def rank_documents(hits: DataFrame, docs: DataFrame | None = None, cross: str | None = None) -> DataFrame:
    """Documents by their score: 0.7 of the best hit and 0.3 of the mean, mixed with the score ``cross`` of a second model where it is given.

    With ``docs`` those without hits come too, with a score of 0.
    """
    rows = search.roll_up(hits, "doc_id", "relevance_score")
    if docs is not None:
        rows = docs.join(rows, "doc_id", "left").fillna(0, ["overall_score", "best_match_score", "total_matches"])
        if cross:
            rows = rows.withColumn("overall_score", search.rerank(F.col("overall_score"), F.col(cross)))
    return rows.orderBy(F.desc("overall_score"), "doc_id")


def best_results(rows: DataFrame, n: int, score: str = "relevance_score", *ties: str) -> DataFrame:
    """The ``n`` best of all results."""
    return rows.orderBy(F.desc(score), *ties).limit(n)


def semantic(docs: DataFrame, vectors: DataFrame, wanted: Sequence[float], most: int = 10, least: float = 0.3) -> DataFrame:
    """``doc_id``, ``ordinal``, ``position``, ``matched_text``, ``score`` and ``page_number`` of the sentences whose vectors are most like a query's.

    ``vectors`` has the ``embedding`` of each sentence (``doc_id``, ``ordinal``). Of a long text the first and last sentences
    are compared, by the plain dot product; matches are cut at 100 characters.
    """
    rows = plain_sentences(docs, 21)
    place = Window.partitionBy("doc_id").orderBy("ordinal")
    size = F.count(F.lit(1)).over(Window.partitionBy("doc_id"))
    ends = rows.withColumn("r", F.row_number().over(place)).withColumn("n", size)
    ends = ends.filter((F.col("n") <= MOST_SENTENCES) | (F.col("r") <= ENDS) | (F.col("r") > F.col("n") - ENDS)).drop("r", "n")
    scored = ends.join(vectors, ["doc_id", "ordinal"]).withColumn("likeness", F.round(dot_with(F.col("embedding"), wanted), 12))
    best = Window.partitionBy("doc_id").orderBy(F.desc("likeness"), F.desc("ordinal"))
    kept = scored.withColumn("r", F.row_number().over(best)).filter((F.col("r") <= most) & (F.col("likeness") > least))
    said = F.when(F.length("sentence") > 100, F.concat(F.substring("sentence", 1, 100), F.lit("..."))).otherwise(F.col("sentence"))
    at = F.greatest(F.col("position"), F.lit(0))
    return kept.select("doc_id", "ordinal", at.alias("position"), said.alias("matched_text"), (F.col("likeness") * 100).alias("score"), page(at).alias("page_number"))


def has_vectors(vectors: DataFrame | None) -> bool:
    """Whether there are vectors to search by."""
    return vectors is not None and "embedding" in vectors.columns and bool(vectors.filter(F.col("embedding").isNotNull()).limit(1).count())


def semantic_or_synonyms(docs: DataFrame, query: str, vectors: DataFrame | None = None, wanted: Sequence[float] | None = None) -> DataFrame:
    """Matches by vectors, or by synonyms where there are no vectors: ``doc_id``, ``position``, ``matched_text`` and ``score``."""
    found = semantic(docs, vectors, wanted) if wanted is not None and has_vectors(vectors) else search.synonym_search(docs, query)
    return found.select("doc_id", "position", "matched_text", "score")


def _ranked(rows: DataFrame, kind: str, *order: Column | str) -> DataFrame:
    w = Window.partitionBy("doc_id").orderBy(*order)
    return rows.withColumn("match_type", F.lit(kind)).withColumn("rank", F.row_number().over(w)).select(COLUMNS)


def execute(docs: DataFrame, query: str, method: str = "Smart", most: int | None = None, case_sensitive: bool = False, vectors: DataFrame | None = None, wanted: Sequence[float] | None = None) -> DataFrame:
    """Matches by the way of searching that ``method`` names: Smart, Exact, Fuzzy, AI Semantic or Hybrid; any other name is Smart.

    Of each document the first ``most`` matches in the way's own order are kept (``rank``); all come by score, then document
    and rank.
    """
    if "Exact" in method and "Smart" not in method:
        found = search.exact(docs, query, case_sensitive)
        said = F.substring("context", F.least(F.col("position"), F.lit(150)) + 1, F.lit(len(query)))
        rows = _ranked(found.withColumn("matched_text", said).withColumn("score", F.lit(100.0)), "exact", "position")
    elif "Fuzzy" in method and "Smart" not in method:
        found = search.fuzzy(docs, query, case_sensitive=case_sensitive).withColumnRenamed("word", "matched_text")
        place = F.array_position(array_of(search.query_words(query)), F.col("query_word"))
        rows = _ranked(found, "fuzzy", F.desc("score"), place, "position")
    elif "AI Semantic" in method and "Smart" not in method:
        rows = _ranked(semantic_or_synonyms(docs, query, vectors, wanted), "semantic", F.desc("score"), "position", "matched_text")
    elif "Hybrid" in method and "Smart" not in method:
        smart = search.smart(docs, query, case_sensitive).select("doc_id", "position", "matched_text", "score", F.lit(0).alias("second"))
        other = semantic_or_synonyms(docs, query, vectors, wanted).withColumn("second", F.lit(1))
        w = Window.partitionBy("doc_id", "position", "matched_text").orderBy(F.desc("score"), "second")
        both = smart.unionByName(other).withColumn("r", F.row_number().over(w)).filter("r = 1")
        rows = _ranked(both, "hybrid", F.desc("score"), "second", "position", "matched_text")
    else:
        rows = _ranked(search.smart(docs, query, case_sensitive), "smart", "ordinal")
    if most:
        rows = rows.filter(F.col("rank") <= most)
    return rows.orderBy(F.desc("score"), "doc_id", "rank")


class Searches:
    """Results of earlier searches by their arguments, and how often they served."""

    def __init__(self) -> None:
        self.results: dict[tuple, DataFrame] = {}
        self.total = self.hits = 0

    def get(self, make: Callable[..., DataFrame], *key) -> DataFrame:
        """What ``make`` gave for ``key``, or gives now."""
        self.total += 1
        if key in self.results:
            self.hits += 1
        else:
            self.results[key] = make(*key)
        return self.results[key]

    def statistics(self) -> dict[str, float]:
        return {"total_searches": self.total, "cache_hits": self.hits, "cached": len(self.results), "hit_rate": self.hits / self.total if self.total else 0.0}

    def clear(self) -> None:
        self.results.clear()
