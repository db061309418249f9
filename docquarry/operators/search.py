"""Search in texts: smart, exact, fuzzy, by synonyms, by vectors, and what they share."""

from __future__ import annotations

import re
from collections.abc import Iterator
from difflib import SequenceMatcher

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from docquarry.functions import lexicon as L
from docquarry.functions.classify import theme
from docquarry.functions.similarity import jaccard
from docquarry.functions.text import any_contains, array_of, meaningful, page, prefix_sums, tokens
from docquarry.operators.segment import plain_sentences, remove_overlaps


ROUND_QUERIES = 20_000  # queries that all tasks are sent at once, about
QUERY_BLOCK = 500  # queries that a batch of vectors is multiplied with at once
BEFORE, AFTER = 10, 10  # words of a context, those from the word itself on counted with AFTER


def query_words(query: str) -> list[str]:
    """The meaningful words of a query, in order, with repeats."""
    return [w for w in re.findall(r"[^\W]+", query.lower()) if len(w) > 1 and w not in L.STOP_WORDS]


def smart(docs: DataFrame, query: str, case_sensitive: bool = False) -> DataFrame:
    """``doc_id``, ``ordinal``, ``position``, ``matched_text``, ``score``, ``word_matches`` and ``page_number`` of the sentences that hold words of the query."""
    words = query_words(query)
    rows = plain_sentences(docs, 11, renumber=True)
    held = F.col("sentence") if case_sensitive else F.lower("sentence")
    hits = sum((held.contains(w).cast("int") for w in words), F.lit(0))
    score = F.least(F.lit(100.0), F.col("word_matches") * 100.0 / max(1, len(words)) * F.when(F.col("word_matches") > 1, 1.2).otherwise(1.0))
    found = rows.withColumn("word_matches", hits).filter(F.col("word_matches") > 0)
    return found.select("doc_id", "ordinal", "position", F.col("sentence").alias("matched_text"), score.alias("score"), "word_matches", page(F.col("position")).alias("page_number"))


def first_per_document(matches: DataFrame, n: int, *order: str) -> DataFrame:
    """The first ``n`` matches of each document in their own order."""
    w = Window.partitionBy("doc_id").orderBy(*order)
    return matches.withColumn("__r", F.row_number().over(w)).filter(F.col("__r") <= n).drop("__r")


def exact(docs: DataFrame, query: str, case_sensitive: bool = False) -> DataFrame:
    """``doc_id``, ``position``, ``context`` and ``page_number`` of all occurrences, overlapping ones too."""
    size = len(query)
    low = F.col("text") if case_sensitive else F.lower("text")
    wanted = query if case_sensitive else query.lower()
    # A look-ahead group finds overlapping occurrences; the parts between them give their places.
    parts = F.split(low, f"(?={re.escape(wanted)})", -1)
    rows = docs.filter(F.length("text") >= size).select("doc_id", "text", low.alias("low"), parts.alias("parts"))
    places = prefix_sums(F.transform("parts", lambda p: F.length(p)))
    each = rows.filter(F.col("low").contains(wanted)).select("doc_id", "text", "low", F.explode(places).alias("position"))
    each = each.filter(F.substring("low", F.col("position") + 1, F.lit(size)) == wanted)
    start = F.greatest(F.col("position") - 150, F.lit(0))
    context = F.substring("text", start + 1, F.least(F.col("position") + size + 150, F.length("text")) - start)
    return each.select("doc_id", "position", context.alias("context"), page(F.col("position")).alias("page_number"))


def basic(docs: DataFrame, query: str) -> DataFrame:
    """``doc_id`` and ``matches``, the number of occurrences that do not overlap, of documents that hold the query in any case."""
    low, wanted = F.lower("text"), query.lower()
    times = ((F.length(low) - F.length(F.replace(low, F.lit(wanted), F.lit("")))) / len(wanted)).cast("int")
    return docs.filter(low.contains(wanted)).select("doc_id", times.alias("matches"))


def fuzzy(docs: DataFrame, query: str, least: float = 0.6, case_sensitive: bool = False, context: bool = False) -> DataFrame:
    """``doc_id``, ``position``, ``word``, ``query_word`` and ``score`` of words like a word of the query; per place the best.

    The ratio is taken of a task's distinct words only, and only of those whose lengths allow it; the texts stay where they
    are read. Positions are those in the text with white space squeezed. ``context`` adds the ten words before a word, itself
    and the nine after it.
    """
    wanted = query_words(query)
    kind = docs.schema["doc_id"].dataType.simpleString()
    own = tokens(F.col("text") if case_sensitive else F.lower("text"))
    rows = docs.filter(F.length("text") > 0).select("doc_id", own.alias("own"), *([tokens(F.col("text")).alias("shown")] if context else []))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, tuple[float, str] | None] = {}
        for batch in batches:
            lists = batch.column(1)
            words, size = lists.flatten(), lists.value_lengths().to_numpy()
            coded = words.dictionary_encode()
            distinct, code = coded.dictionary.to_pylist(), coded.indices.to_numpy()
            best = [known[w] if w in known else known.setdefault(w, _best_ratio(w, wanted, least)) for w in distinct]
            at = np.flatnonzero(np.array([b is not None for b in best], bool)[code])
            if not len(at):
                continue
            row, first = np.repeat(np.arange(len(size)), size)[at], np.cumsum(size) - size
            length = np.array([len(w) for w in distinct], np.int64)[code] + 1
            before = np.cumsum(length) - length
            hits = [best[k] for k in code[at]]
            place, ordinal = before[at] - before[first[row]], at - first[row]
            out = [batch.column(0).take(pa.array(row)), pa.array(place, pa.int32()), words.take(pa.array(at)), pa.array([q for _, q in hits], pa.string()), pa.array([r * 100 for r, _ in hits], pa.float64())]
            if context:
                shown = batch.column(2)
                held = {k: shown[k].as_py() for k in np.unique(row).tolist()}
                out.append(pa.array([" ".join(held[k][max(0, i - BEFORE) : i + AFTER]) for k, i in zip(row.tolist(), ordinal.tolist(), strict=True)], pa.string()))
            yield pa.RecordBatch.from_arrays(out, names)

    names = ["doc_id", "position", "word", "query_word", "score"] + ["context"] * context
    return rows.mapInArrow(run, f"doc_id {kind}, position int, word string, query_word string, score double" + ", context string" * context)


def _best_ratio(word: str, wanted: list[str], least: float) -> tuple[float, str] | None:
    """The greatest ratio above ``least`` of a word of the query and ``word``, of equal ones the greatest word; the bounds on a ratio are tried first."""
    best, matcher = None, SequenceMatcher()
    for q in wanted:
        if 2.0 * min(len(word), len(q)) / (len(word) + len(q)) > least:
            matcher.set_seq2(word)  # which does nothing if it is set
            matcher.set_seq1(q)
            if matcher.quick_ratio() > least and (r := matcher.ratio()) > least:
                best = max(best or (r, q), (r, q))
    return best


def related_words(word: str) -> list[str]:
    """The words that stand for a query word: its synonyms, else the word and its plain inflections."""
    out = list(L.SYNONYMS.get(word, []))
    for group in L.SYNONYMS.values():
        if any(word in x for x in group):
            out += group
    if not out:
        out = [word] + ([word + e for e in ("s", "ing", "ed", "ion")] if len(word) > 4 else [])
    return sorted(set(out))


def synonym_scores(query: str) -> list[tuple[str, str, float]]:
    """Query word, related word and score: 100 for the word itself, 95 for one within the other, else 85."""
    out = []
    for q in query_words(query):
        out += [(q, r, 100.0 if r == q else 95.0 if q in r or r in q else 85.0) for r in related_words(q)]
    return out


def synonyms(docs: DataFrame, query: str) -> DataFrame:
    """``doc_id``, ``ordinal``, ``position``, ``matched_text``, ``query_word`` and ``score``: per query word and sentence the best related word that it holds."""
    rows = plain_sentences(docs, 1)
    low = F.lower("sentence")
    found = []
    for q in dict.fromkeys(query_words(query)):
        best = F.greatest(*(F.when(low.contains(r), s) for x, r, s in synonym_scores(q) if x == q), F.lit(None).cast("double"))
        found.append(F.struct(F.lit(q).alias("query_word"), best.alias("score")))
    each = rows.select("*", F.explode(F.array(*found)).alias("f")).filter(F.col("f.score").isNotNull())
    return each.select("doc_id", "ordinal", "position", F.col("sentence").alias("matched_text"), "f.query_word", "f.score")


def synonym_search(docs: DataFrame, query: str) -> DataFrame:
    """``synonyms`` without matches that overlap better ones."""
    spans = synonyms(docs, query).withColumn("upto", F.col("position") + F.length("matched_text"))
    return remove_overlaps(spans, "position", "upto", "score", "doc_id", ties=("ordinal", "query_word")).drop("upto")


def hybrid(docs: DataFrame, query: str) -> DataFrame:
    """``doc_id``, ``position``, ``matched_text``, ``score`` and ``source``: smart and synonym matches together, the best of each place and text."""
    a = smart(docs, query).select("doc_id", "position", "matched_text", "score", F.lit("smart").alias("source"))
    b = synonyms(docs, query).select("doc_id", "position", "matched_text", "score", F.lit("semantic").alias("source"))
    best = a.unionByName(b).groupBy("doc_id", "position", "matched_text").agg(F.max("score").alias("score"), F.max_by("source", F.struct("score", "source")).alias("source"))
    return best


def similar_content(docs: DataFrame, target: str, kind: str = "All", least: float = 0.3, most: int | None = None) -> DataFrame:
    """``doc_id``, ``ordinal``, ``sentence`` and ``similarity`` of sentences whose words are like the target's, the best ``most`` of them."""
    # Words that a sentence of a kind holds.
    kinds = {"Recommendations": ["recommend", "suggest", "advise"], "Responses": ["accept", "reject", "agree", "implement"]}
    rows = plain_sentences(docs, 20)
    if kind in kinds:
        rows = rows.filter(any_contains(F.lower("sentence"), kinds[kind]))
    wanted = array_of(sorted(set(query_words(target))))
    scored = rows.withColumn("similarity", jaccard(F.array_distinct(meaningful(F.col("sentence"))), wanted)).filter(F.col("similarity") >= least)
    scored = scored.select("doc_id", "ordinal", "sentence", "similarity")
    return scored if most is None else scored.orderBy(F.desc("similarity"), "doc_id", "ordinal").limit(most)


def pattern_matches(docs: DataFrame, patterns: list[str]) -> DataFrame:
    """``doc_id``, ``ordinal``, ``sentence``, ``position``, ``page_number`` and ``content_type`` of sentences that hold one of the patterns."""
    rows = plain_sentences(docs, 1).filter(any_contains(F.lower("sentence"), [p.lower() for p in patterns]))
    at = F.col("position")
    return rows.select("doc_id", "ordinal", "sentence", "position", F.when(at >= 0, page(at)).otherwise(1).alias("page_number"), theme(F.col("sentence")).alias("content_type"))


def nearest(queries: DataFrame, vectors: DataFrame, k: int, query_id: str = "query_id", vec_id: str = "vec_id", least: float | None = None) -> DataFrame:
    """``query_id``, ``vec_id`` and ``similarity``: the ``k`` nearest vectors of each query by cosine, ties to the smaller id.

    Queries, which are counted, are dealt to rounds of at most about ``ROUND_QUERIES``; a round's queries go to every task
    as a matrix, with which batches of vectors are multiplied in blocks. Of a batch only each query's ``k`` best, and its
    ties, are passed on. Similarities have twelve decimal places; a vector of zeros has the similarity 0.
    """
    q = queries.select(F.col(query_id).cast("bigint").alias("query_id"), F.col("embedding").alias("qv")).filter(F.col("query_id").isNotNull() & F.col("qv").isNotNull())
    own = vectors.select(F.col(vec_id).cast("bigint").alias("vec_id"), F.col("embedding")).filter(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull())
    rounds = max(1, -(-q.count() // ROUND_QUERIES))
    found = None
    for turn in range(rounds):
        table = q.filter(F.pmod(F.xxhash64("query_id"), F.lit(rounds)) == turn).toArrow()
        ids, matrix = table.column(0).to_numpy(), _unit(table.column(1).combine_chunks())
        part = own.mapInArrow(_best_of_batches(q.sparkSession.sparkContext.broadcast((ids, matrix)), k, least), "query_id bigint, vec_id bigint, similarity double")
        found = part if found is None else found.unionByName(part)
    w = Window.partitionBy("query_id").orderBy(F.desc("similarity"), "vec_id")
    return found.withColumn("r", F.row_number().over(w)).filter(F.col("r") <= k).drop("r")


def _unit(vectors: pa.Array) -> np.ndarray:
    """Arrow lists of equal length as rows of length 1, or of zeros."""
    if not len(vectors):
        return np.zeros((0, 0))
    rows = vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(vectors), -1)
    size = np.sqrt((rows * rows).sum(1))
    return rows / np.where(size == 0, 1.0, size)[:, None]


def _best_of_batches(shared, k: int, least: float | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, matrix = shared.value
        for batch in batches:
            if not batch.num_rows or not len(ids):
                continue
            keys, rows = batch.column(0).to_numpy(), _unit(batch.column(1))
            for at in range(0, len(ids), QUERY_BLOCK):
                score = np.round(matrix[at : at + QUERY_BLOCK] @ rows.T, 12)
                if len(keys) > k:
                    bound = np.partition(score, len(keys) - k, axis=1)[:, len(keys) - k][:, None]
                    score = np.where(score >= bound, score, -np.inf)
                q, v = np.nonzero(score > -np.inf if least is None else score >= least)
                yield pa.RecordBatch.from_arrays([pa.array(ids[at + q]), pa.array(keys[v]), pa.array(score[q, v])], ["query_id", "vec_id", "similarity"])

    return run


def best_variant(scores: DataFrame, keys: list[str], score: str = "similarity") -> DataFrame:
    """Of several variants of a query, the best score of each chunk."""
    return scores.groupBy(*keys).agg(F.max(score).alias(score))


def keyword_boost(score: Column, text: Column, query: str, boost: float = 0.1) -> Column:
    """A score raised for each distinct query term in the text, by 0.3 at most, to 1 at most."""
    terms = sorted(set(query.lower().split()))
    hits = sum((F.lower(text).contains(t).cast("int") for t in terms), F.lit(0))
    return F.least(score + F.least(hits * boost, F.lit(0.3)), F.lit(1.0))


def roll_up(scores: DataFrame, doc: str = "doc_id", score: str = "similarity") -> DataFrame:
    """``doc_id``, ``overall_score`` (0.7 of the best and 0.3 of the mean), ``best_match_score`` and ``total_matches`` of each document."""
    best, mean = F.max(score), F.avg(score)
    return scores.groupBy(doc).agg((best * 0.7 + mean * 0.3).alias("overall_score"), best.alias("best_match_score"), F.count(F.lit(1)).alias("total_matches"))


def rerank(overall: Column, cross: Column) -> Column:
    """A document's score with a second model's, where there is one."""
    return F.when(cross.isNull(), overall).otherwise(overall * 0.6 + cross * 0.4)


def ends_of(rows: DataFrame, n: int, *order: str) -> DataFrame:
    """The first and the last ``n`` rows of each document, all of them if there are no more than twice as many."""
    up = Window.partitionBy("doc_id").orderBy(*order)
    size = F.count(F.lit(1)).over(Window.partitionBy("doc_id"))
    ranked = rows.withColumn("__r", F.row_number().over(up)).withColumn("__n", size)
    return ranked.filter((F.col("__r") <= n) | (F.col("__r") > F.col("__n") - n)).drop("__r", "__n")


def word_ratio(a: str, b: str) -> float:
    """The ratio that ``fuzzy`` uses, for one pair."""
    return SequenceMatcher(None, a, b).ratio()


