"""Registered queries of whole ways of working: searches, vector engine, marking, choosing, exports; with SQL where it can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docquarry.functions import classify, text
from docquarry.functions import lexicon as L
from docquarry.operators import align, choose, engine, highlight, recommend, search, segment, stats
from docquarry.plans.catalog import CHUNKS, CHUNK_CONTEXT, COSINE, DOCS, PAGE, QUERY, RECS, RESPS, SMART, SPACE, TOP_THREE, Query, documents, numbered_reports, parts, q, recs, resps, squeeze, strip
from docquarry.plans.catalog import SQL as CATALOG_SQL
from docquarry.session import table
from docquarry.sinks import writers

QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}
MARKED = ["register", "policy"]
MOST = 3


def query(sql: str | None = None):
    """Registers a query under its name, and its SQL."""

    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def with_vectors(rows: DataFrame, spark: SparkSession, sf: str, ordinal: str) -> DataFrame:
    """Rows with a vector of the table each, dealt by document and ordinal, as no model is installed."""
    vectors = table(spark, sf, "embeddings")
    n = vectors.count()
    numbered = vectors.select((F.col("vec_id") % n).alias("v"), "embedding").dropDuplicates(["v"])
    return rows.withColumn("v", F.pmod(F.col("doc_id") * 31 + F.col(ordinal), F.lit(n))).join(numbered, "v").drop("v")


def first_vectors(spark: SparkSession, sf: str, n: int) -> list[list[float]]:
    """The vectors of the variants of a query."""
    return [r.embedding for r in table(spark, sf, "embeddings").orderBy("vec_id").limit(n).collect()]


BASE = f"(SELECT b.vec_id % (SELECT count(*) FROM embeddings) AS v, max({COSINE}) AS base FROM (SELECT embedding FROM embeddings ORDER BY vec_id LIMIT 3) a, embeddings b GROUP BY b.vec_id)"
BOOST = "least((" + " + ".join(f"contains(lower(chunk), '{t}')::INTEGER" for t in sorted(set(QUERY.split()))) + ") * 0.1::DOUBLE, 0.3::DOUBLE)"
HITS = f"""SELECT doc_id, chunk_idx, chunk AS text_fragment, context AS full_context, relevance_score FROM
    (SELECT c.*, least(base + {BOOST}, 1.0::DOUBLE) AS relevance_score FROM ({CHUNK_CONTEXT}) c JOIN {BASE} e ON e.v = (c.doc_id * 31 + c.chunk_idx) % (SELECT count(*) FROM embeddings))
    QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY round(relevance_score, 12) DESC, chunk_idx DESC) <= 20"""


def _hits(spark: SparkSession, sf: str) -> DataFrame:
    indexed = with_vectors(engine.index(documents(spark, sf)), spark, sf, "chunk_idx")
    return engine.search_chunks(indexed, first_vectors(spark, sf, 3), QUERY)


@query(f"SELECT doc_id, chunk_idx, text_fragment, full_context, round(relevance_score, 9) AS relevance_score, round(1 - relevance_score, 9) AS embedding_distance FROM ({HITS}) WHERE relevance_score >= 0.3")
def engine_chunks(spark: SparkSession, sf: str) -> DataFrame:
    rounded = {c: F.round(c, 9) for c in ("relevance_score", "embedding_distance")}
    return _hits(spark, sf).drop("matched_concepts").withColumns(rounded)


@query(f"""SELECT d.doc_id, round(coalesce(max(relevance_score) * 0.7::DOUBLE + avg(relevance_score) * 0.3::DOUBLE, 0), 9) AS overall_score, round(coalesce(max(relevance_score), 0), 9) AS best_match_score, count(h.doc_id) AS total_matches
    FROM {DOCS} d LEFT JOIN (SELECT * FROM ({HITS}) WHERE relevance_score >= 0.3) h ON h.doc_id = d.doc_id GROUP BY d.doc_id""")
def engine_documents(spark: SparkSession, sf: str) -> DataFrame:
    docs = documents(spark, sf).filter(F.length("text") > 0).select("doc_id")
    rows = engine.rank_documents(_hits(spark, sf), docs)
    return rows.withColumns({c: F.round(c, 9) for c in ("overall_score", "best_match_score")})


@query(f"""SELECT count(*) AS documents, sum(total_matches)::BIGINT AS total_matches, round(avg(overall_score), 9) AS mean_score FROM
    (SELECT max(relevance_score) * 0.7::DOUBLE + avg(relevance_score) * 0.3::DOUBLE AS overall_score, count(*) AS total_matches FROM ({HITS}) WHERE relevance_score >= 0.3 GROUP BY doc_id)""")
def engine_totals(spark: SparkSession, sf: str) -> DataFrame:
    return stats.search_totals(engine.rank_documents(_hits(spark, sf))).withColumn("mean_score", F.round("mean_score", 9))


LIKE = "list_sum(list_transform(list_zip(a.embedding, b.embedding), lambda x: x[1]::DOUBLE * x[2]::DOUBLE))"
SEMANTIC = f"""SELECT doc_id, ordinal, greatest(instr(text, sentence) - 1, 0)::INTEGER AS position, CASE WHEN length(sentence) > 100 THEN substr(sentence, 1, 100) || '...' ELSE sentence END AS matched_text, likeness * 100 AS score FROM
    (SELECT p.*, e.likeness FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY ordinal) AS r, count(*) OVER (PARTITION BY doc_id) AS n FROM {parts(21, False)}) p
     JOIN (SELECT b.vec_id % (SELECT count(*) FROM embeddings) AS v, round({LIKE}, 12) AS likeness FROM (SELECT embedding FROM embeddings ORDER BY vec_id LIMIT 1) a, embeddings b) e ON e.v = (p.doc_id * 31 + p.ordinal) % (SELECT count(*) FROM embeddings)
     WHERE n <= 100 OR r <= 50 OR r > n - 50)
    QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY likeness DESC, ordinal DESC) <= 10 AND likeness > 0.3"""


def _sentence_vectors(spark: SparkSession, sf: str, docs: DataFrame) -> DataFrame:
    return with_vectors(segment.plain_sentences(docs, 21).select("doc_id", "ordinal"), spark, sf, "ordinal")


@query(f"SELECT doc_id, ordinal, position, matched_text, round(score, 9) AS score, {PAGE} AS page_number FROM ({SEMANTIC})")
def semantic_sentences(spark: SparkSession, sf: str) -> DataFrame:
    docs = documents(spark, sf)
    found = engine.semantic(docs, _sentence_vectors(spark, sf, docs), first_vectors(spark, sf, 1)[0])
    return found.withColumn("score", F.round("score", 9))


@query(f"SELECT doc_id, position, matched_text, score, 'smart' AS match_type, rank FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY ordinal)::INTEGER AS rank FROM ({SMART})) WHERE rank <= {MOST}")
def execute_smart(spark: SparkSession, sf: str) -> DataFrame:
    return engine.execute(documents(spark, sf), QUERY, "Smart Search", MOST)


@query(f"""WITH d AS (SELECT doc_id, text, list_transform(string_split(lower(text), '{QUERY}'), lambda x: length(x)) AS l FROM documents WHERE contains(lower(text), '{QUERY}')),
    e AS (SELECT doc_id, text, unnest(list_transform(range(1, len(l)), lambda k: list_sum(l[1:k]) + (k - 1) * {len(QUERY)}))::INTEGER AS position FROM d)
    SELECT doc_id, position, substr(text, position + 1, {len(QUERY)}) AS matched_text, 100.0::DOUBLE AS score, 'exact' AS match_type, row_number() OVER w::INTEGER AS rank FROM e
    WINDOW w AS (PARTITION BY doc_id ORDER BY position) QUALIFY row_number() OVER w <= {MOST}""")
def execute_exact(spark: SparkSession, sf: str) -> DataFrame:
    return engine.execute(documents(spark, sf), QUERY, "Exact", MOST)


@query(f"""SELECT doc_id, position, matched_text, round(score, 9) AS score, 'semantic' AS match_type, row_number() OVER w::INTEGER AS rank FROM ({SEMANTIC})
    WINDOW w AS (PARTITION BY doc_id ORDER BY score DESC, position, matched_text) QUALIFY row_number() OVER w <= {MOST}""")
def execute_semantic(spark: SparkSession, sf: str) -> DataFrame:
    docs = documents(spark, sf)
    found = engine.execute(docs, QUERY, "AI Semantic", MOST, vectors=_sentence_vectors(spark, sf, docs), wanted=first_vectors(spark, sf, 1)[0])
    return found.withColumn("score", F.round("score", 9))


@query(f"""WITH b AS (SELECT doc_id, position, matched_text, score, 0 AS second FROM ({SMART}) UNION ALL SELECT doc_id, position, matched_text, score, 1 FROM ({SEMANTIC})),
    u AS (SELECT * FROM b QUALIFY row_number() OVER (PARTITION BY doc_id, position, matched_text ORDER BY score DESC, second) = 1)
    SELECT doc_id, position, matched_text, round(score, 9) AS score, 'hybrid' AS match_type, row_number() OVER w::INTEGER AS rank FROM u
    WINDOW w AS (PARTITION BY doc_id ORDER BY score DESC, second, position, matched_text) QUALIFY row_number() OVER w <= {MOST}""")
def execute_hybrid(spark: SparkSession, sf: str) -> DataFrame:
    docs = documents(spark, sf)
    found = engine.execute(docs, QUERY, "Hybrid", MOST, vectors=_sentence_vectors(spark, sf, docs), wanted=first_vectors(spark, sf, 1)[0])
    return found.withColumn("score", F.round("score", 9))


@query()
def execute_fuzzy(spark: SparkSession, sf: str) -> DataFrame:
    return engine.execute(documents(spark, sf), "eskalation registry", "Fuzzy", MOST)


@query()
def fuzzy_context(spark: SparkSession, sf: str) -> DataFrame:
    return search.fuzzy(documents(spark, sf), "eskalation registry", context=True)


def _prefixed_sql(x: str, words: list[str], left: str, right: str) -> str:
    for w in sorted(words, key=len, reverse=True):
        if len(w) > 2:
            x = f"regexp_replace({x}, '(?i)\\b{w}[0-9A-Za-z_]*', {q(left)} || '\\0' || {q(right)}, 'g')"
    return x


def _caps_sql(x: str, words: list[str], pattern: str, left: str = "", right: str = "") -> str:
    for w in sorted(words, key=len, reverse=True):
        p = q(pattern.format(w))
        x = f"array_to_string(list_transform(list_zip(string_split_regex({x}, {p}), regexp_extract_all({x}, {p})), lambda z: z[1] || coalesce({q(left)} || upper(z[2]) || {q(right)}, '')), '')"
    return x


def _whole_sql(x: str, words: list[str], left: str, right: str) -> str:
    for w in sorted(words, key=len, reverse=True):
        x = f"regexp_replace({x}, '(?i)\\b{w}\\b', {q(left + w + right)}, 'g')"
    return x


VARIANTS = {
    "html": _prefixed_sql("text", MARKED, "<mark>", "</mark>"), "bold": _prefixed_sql("text", MARKED, "**", "**"),
    "caps": _caps_sql("text", MARKED, "(?i)\\b{}[0-9A-Za-z_]*", "**", "**"), "brackets": _prefixed_sql("text", MARKED, "[", "]"),
}


@query(" UNION ALL ".join(f"SELECT doc_id, '{k}' AS style, {x} AS text FROM {DOCS}" for k, x in VARIANTS.items()))
def highlight_styles(spark: SparkSession, sf: str) -> DataFrame:
    made = F.array(*(F.struct(F.lit(k).alias("style"), highlight.prefixed(F.col("text"), MARKED, k).alias("text")) for k in highlight.STYLES))
    return documents(spark, sf).filter(F.length("text") > 0).select("doc_id", F.explode(made).alias("m")).select("doc_id", "m.style", "m.text")


WHOLE = {k: _whole_sql("text", MARKED, *m) for k, m in highlight.STYLES.items() if k != "caps"} | {"caps": _caps_sql("text", MARKED, "(?i)\\b{}\\b")}


@query(" UNION ALL ".join(f"SELECT doc_id, '{k}' AS style, {x} AS text FROM {DOCS}" for k, x in WHOLE.items()))
def highlight_whole_words(spark: SparkSession, sf: str) -> DataFrame:
    made = F.array(*(F.struct(F.lit(k).alias("style"), highlight.whole(F.col("text"), MARKED, k).alias("text")) for k in highlight.STYLES))
    return documents(spark, sf).filter(F.length("text") > 0).select("doc_id", F.explode(made).alias("m")).select("doc_id", "m.style", "m.text")


@query(f"SELECT doc_id, CASE WHEN {VARIANTS['bold']} <> text THEN 'bold' ELSE 'brackets' END AS method, CASE WHEN {VARIANTS['bold']} <> text THEN {VARIANTS['bold']} ELSE {VARIANTS['brackets']} END AS text FROM {DOCS}")
def highlight_smart(spark: SparkSession, sf: str) -> DataFrame:
    made = highlight.smart(F.col("text"), " ".join(MARKED), "bold")
    return documents(spark, sf).filter(F.length("text") > 0).select("doc_id", made.alias("m")).select("doc_id", "m.method", "m.text")


OFFICIAL = _prefixed_sql("text", L.OFFICIAL_TERMS, "<mark>", "</mark>")


@query(f"SELECT rec_key, CASE WHEN marked <> text THEN 'html' ELSE 'brackets' END AS method, marked AS text FROM (SELECT rec_key, text, {OFFICIAL} AS marked FROM {RECS})")
def highlight_official_terms(spark: SparkSession, sf: str) -> DataFrame:
    return recs(spark, sf).select("rec_key", highlight.official(F.col("text")).alias("m")).select("rec_key", "m.method", "m.text")


@query(f"SELECT rec_key, method FROM {RECS} WHERE method IN ('modal_verb', 'we_recommend', 'entity_should')")
def rows_by_method(spark: SparkSession, sf: str) -> DataFrame:
    return choose.by_method(recs(spark, sf), ["modal_verb", "we_recommend", "entity_should"]).select("rec_key", "method")


@query(f"SELECT rec_key FROM {RECS} WHERE source_document IN (SELECT filename FROM documents WHERE file_type = 'pdf')")
def rows_of_documents(spark: SparkSession, sf: str) -> DataFrame:
    names = table(spark, sf, "documents").filter(F.col("file_type") == "pdf").select(F.col("filename").alias("source_document"))
    return choose.of_documents(recs(spark, sf), names, "source_document").select("rec_key")


@query("SELECT filename, min(doc_id) AS doc_id, arg_min(word_count, doc_id) AS word_count FROM documents WHERE filename IS NOT NULL GROUP BY filename")
def first_documents(spark: SparkSession, sf: str) -> DataFrame:
    return choose.first_of_each_name(table(spark, sf, "documents").select("filename", "doc_id", "word_count"))


@query("SELECT doc_id, filename FROM documents WHERE regexp_matches(lower(filename), 'response|reply|answer')")
def suggested_documents(spark: SparkSession, sf: str) -> DataFrame:
    return choose.suggested_responses(table(spark, sf, "documents")).select("doc_id", "filename")


@query("SELECT 'file_type' AS \"column\", coalesce(file_type, 'unknown') AS value, count(*) AS n FROM documents GROUP BY 2 UNION ALL SELECT 'document_type', coalesce(document_type, 'unknown'), count(*) FROM documents GROUP BY 2")
def corpus_by(spark: SparkSession, sf: str) -> DataFrame:
    return stats.corpus_by(table(spark, sf, "documents"), "file_type", "document_type")


@query("SELECT count(*) AS documents, round(sum(file_size_mb), 2) AS total_mb, round(avg(file_size_mb), 2) AS mean_mb FROM documents")
def size_summary(spark: SparkSession, sf: str) -> DataFrame:
    return stats.size_summary(table(spark, sf, "documents"))


@query("SELECT doc_id, filename, coalesce(document_type, 'general') AS document_type, coalesce(word_count, 0) AS word_count, coalesce(length(text), 0)::INTEGER AS chars, coalesce(file_size_mb, 0) AS file_size_mb FROM documents")
def document_table(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents")
    return stats.document_table(docs, keep=("doc_id",))


@query("SELECT count(*) AS documents, sum(coalesce(word_count, 0))::BIGINT AS words, floor(sum(coalesce(word_count, 0)) / count(*))::BIGINT AS mean_words FROM documents")
def upload_summary(spark: SparkSession, sf: str) -> DataFrame:
    return stats.upload_summary(table(spark, sf, "documents"))


@query(f"SELECT count(*) AS total, count_if(response_type = 'structured') AS structured, count_if(response_type = 'sentence') AS sentence_level FROM {RESPS}")
def response_kinds(spark: SparkSession, sf: str) -> DataFrame:
    return stats.response_kinds(resps(spark, sf))


def _brief_sql(x: str) -> str:
    for old, new in [("â€™", "'"), ("â€œ", '"'), ("â€", '"'), ("Â ", " "), ("\xa0", " "), ("�", "")]:
        x = f"replace({x}, {q(old)}, {q(new)})"
    for p in (r"https?://\S+", r"www\.\S+", r"(?i)\d{1,2}/\d{1,2}/\d{2,4},?\s*\d{1,2}:\d{2}\s*(?:AM|PM)?", r"\b(\d{1,2})/(\d{1,3})\b", r"\[\d+\]"):
        x = f"regexp_replace({x}, {q(p)}, '', 'g')"
    return squeeze(x)


BRIEF = f"(SELECT rec_key, {_brief_sql('text')} AS text FROM {RECS})"


@query(f"SELECT * FROM {BRIEF}")
def clean_brief(spark: SparkSession, sf: str) -> DataFrame:
    return recs(spark, sf).select("rec_key", text.clean_brief(F.col("text")).alias("text"))


@query("SELECT rec_key, CASE " + " ".join(f"WHEN regexp_matches(text, {q(p)}) THEN length(string_split_regex(text, {q(p)})[1])" for p in L.WORDING_STARTS) + f" ELSE length(regexp_extract(text, {q(L.WORDING_HEADER)})) END::INTEGER AS start_at FROM {BRIEF}")
def wording_starts(spark: SparkSession, sf: str) -> DataFrame:
    return recs(spark, sf).select("rec_key", recommend.wording_start(text.clean_brief(F.col("text"))).alias("start_at"))


@query("SELECT rec_key, CASE " + " ".join(f"WHEN regexp_matches(lower(text), {q(p)}) THEN {q(name)} || " + (f"upper(regexp_extract(lower(text), {q(shown)}))" if shown else "''") for p, shown, name in L.OPENING_METHODS) + f" ELSE 'semantic_match' END AS method FROM {RECS}")
def opening_methods(spark: SparkSession, sf: str) -> DataFrame:
    return recs(spark, sf).select("rec_key", classify.opening_method(F.col("text")).alias("method"))


@query()
def recommendations_by_likeness(spark: SparkSession, sf: str) -> DataFrame:
    return recommend.extract_by_likeness(numbered_reports(spark, sf))


@query()
def headings_inspected(spark: SparkSession, sf: str) -> DataFrame:
    return recommend.inspected(numbered_reports(spark, sf))


@query()
def paragraph_view(spark: SparkSession, sf: str) -> DataFrame:
    return recs(spark, sf).select("rec_key", segment.paragraphs(F.col("text")).alias("text"))


@query("SELECT doc_id, replace(text, chr(12), chr(10) || chr(10) || '--- PAGE BREAK ---' || chr(10) || chr(10)) AS value FROM documents WHERE text IS NOT NULL")
def page_break_dump(spark: SparkSession, sf: str) -> DataFrame:
    return segment.page_break_dump(documents(spark, sf))


@query("SELECT doc_id, ((length(lower(text)) - length(replace(lower(text), 'not for release', ''))) // 15)::INTEGER AS markers FROM documents WHERE text IS NOT NULL")
def marker_counts(spark: SparkSession, sf: str) -> DataFrame:
    return writers.marker_counts(documents(spark, sf), "NOT FOR RELEASE")


UNTAGGED = "regexp_replace(matched_text, '<[^>]+>', '', 'g')"
for _old, _new in [("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'")]:
    UNTAGGED = f"replace({UNTAGGED}, {q(_old)}, {q(_new)})"


@query(f"""WITH m AS (SELECT '{QUERY}' AS "Query", '{", ".join(search.query_words(QUERY))}' AS "Meaningful_Words", doc_id::VARCHAR AS "Document", 'smart' AS "Match_Type", score AS "Score", page_number AS "Page_Number", position AS "Position", 0.0::DOUBLE AS "Percentage_Through",
        coalesce(nullif({squeeze(UNTAGGED)}, ''), 'No content available') AS "Complete_Context" FROM ({SMART}))
    SELECT row_number() OVER (ORDER BY "Score" DESC, "Document", "Position", "Complete_Context") AS "Match_Number", *, len(list_filter(string_split_regex("Complete_Context", '{SPACE}+'), lambda x: x <> ''))::INTEGER AS "Word_Count", length("Complete_Context")::INTEGER AS "Character_Count" FROM m""")
def export_search(spark: SparkSession, sf: str) -> DataFrame:
    found = search.smart(documents(spark, sf), QUERY).withColumn("match_type", F.lit("smart"))
    return writers.search_rows(found, QUERY)


ALIGNED = f"""(SELECT k.*, r.text AS rec_text, r.confidence, r.method, p.text AS resp_text, p.source_document, CASE WHEN k.has_response THEN 'keyword' END AS match_method
    FROM ({CATALOG_SQL["align_keyword"]}) k JOIN {RECS} r ON r.rec_key = k.rec_key LEFT JOIN {RESPS} p ON p.resp_key = k.resp_key)"""


def _aligned(spark: SparkSession, sf: str) -> DataFrame:
    left, right = recs(spark, sf), resps(spark, sf)
    own = left.select("rec_key", F.col("text").alias("rec_text"), "confidence", "method")
    other = right.select("resp_key", F.col("text").alias("resp_text"), "source_document")
    rows = align.best_matches(left, right).join(own, "rec_key").join(other, "resp_key", "left")
    return rows.withColumn("match_method", F.when(F.col("has_response"), "keyword"))


@query(f"""SELECT row_number() OVER (ORDER BY rec_key) AS "AlignmentIndex", coalesce(rec_text, '') AS "RecommendationText", coalesce(confidence, 0) AS "RecommendationConfidence", coalesce(method, 'unknown') AS "RecommendationMethod",
    CASE WHEN has_response THEN coalesce(status, 'Unclear') ELSE 'No Response' END AS "ResponseStatus", CASE WHEN has_response THEN coalesce(similarity, 0) ELSE 0 END::DOUBLE AS "ResponseSimilarity", CASE WHEN has_response THEN coalesce(resp_text, '') ELSE '' END AS "ResponseText",
    CASE WHEN has_response THEN coalesce(match_method, 'semantic') ELSE '' END AS "ResponseMatchMethod", CASE WHEN has_response THEN coalesce(source_document, 'unknown') ELSE '' END AS "ResponseSourceDocument", has_response AS "HasResponse" FROM {ALIGNED}""")
def export_alignments(spark: SparkSession, sf: str) -> DataFrame:
    return writers.alignment_rows(_aligned(spark, sf))


def _markdown_sql() -> str:
    nl = "chr(10)"
    status = "CASE WHEN has_response THEN coalesce(status, 'No Response') ELSE 'No Response' END"
    counts = " || ".join(f"{nl} || '- {k}: ' || count_if({status} = '{k}')" for k in ("Accepted", "Partial", "Rejected", "No Response"))
    head = f"'# Recommendation-Response Alignment Report' || {nl} || 'Generated: 2024-01-02 03:04:05' || {nl} || {nl} || '## Summary' || {nl} || '- Total Recommendations: ' || count(*) || {nl} || '- Responses Found: ' || count_if(has_response) || {counts} || {nl} || {nl} || '## Details'"
    body = f"'### Recommendation ' || row_number() OVER (ORDER BY rec_key) || {nl} || '**Status:** ' || {status} || {nl} || {nl} || '**Recommendation:**' || {nl} || '> ' || coalesce(rec_text, '') || {nl} || {nl} || '**Response:**' || {nl} || '> ' || coalesce(CASE WHEN has_response THEN resp_text END, 'No response found') || {nl} || {nl} || '---'"
    return f"SELECT 0::BIGINT AS part, {head} AS value FROM {ALIGNED} UNION ALL SELECT row_number() OVER (ORDER BY rec_key) AS part, {body} AS value FROM {ALIGNED}"


@query(_markdown_sql())
def export_markdown(spark: SparkSession, sf: str) -> DataFrame:
    return writers.markdown(_aligned(spark, sf), F.lit("2024-01-02 03:04:05").cast("timestamp"))


@query(f"""WITH t AS ({TOP_THREE}), n AS (SELECT rec_key, count(*) AS n FROM t GROUP BY rec_key)
    SELECT row_number() OVER (ORDER BY coalesce(r.confidence, 0) DESC, r.rec_key) AS "ID", r.text AS "Recommendation", coalesce(r.verb, 'unknown') AS "Action Verb", coalesce(r.method, 'unknown') AS "Detection Method", round_even(coalesce(r.confidence, 0) * 100, 0)::INTEGER || '%' AS "Detection Confidence",
    r.source_document AS "Document", CASE WHEN t.resp_key IS NULL THEN 'No response found' WHEN t.same_document THEN 'Direct response' WHEN t.combined_score >= 0.5 THEN 'Possible response' ELSE 'Uncertain' END AS "Alignment Status",
    coalesce(n.n, 0)::INTEGER AS "Response Count", coalesce(p.text, 'No response found') AS "Top Response", coalesce(p.source_document, '') AS "Response Document", round_even(coalesce(t.combined_score, 0) * 100, 0)::INTEGER || '%' AS "Alignment Confidence"
    FROM {RECS} r LEFT JOIN (SELECT * FROM t WHERE rank = 1) t ON t.rec_key = r.rec_key LEFT JOIN n ON n.rec_key = r.rec_key LEFT JOIN {RESPS} p ON p.resp_key = t.resp_key""")
def export_nested_alignments(spark: SparkSession, sf: str) -> DataFrame:
    left, right = recs(spark, sf), resps(spark, sf)
    return writers.nested_alignment_rows(align.nested(align.top_three(left, right), left), left, right)


@query("SELECT result_id, CASE WHEN relevance_score > 0.8 THEN 'very high' WHEN relevance_score > 0.6 THEN 'high' WHEN relevance_score > 0.4 THEN 'medium' ELSE 'low' END AS similar, CASE WHEN relevance_score > 0.7 THEN 'high' WHEN relevance_score > 0.5 THEN 'medium' ELSE 'low' END AS relevance, CASE WHEN relevance_score > 0.7 THEN 'high' WHEN relevance_score > 0.4 THEN 'medium' ELSE 'low' END AS match FROM (SELECT DISTINCT result_id, relevance_score FROM search_results WHERE NOT isnan(relevance_score))")
def score_bands(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "search_results").select("result_id", "relevance_score").distinct().filter(F.col("relevance_score").isNotNull() & ~F.isnan("relevance_score"))
    return rows.select("result_id", *(classify.named_band(F.col("relevance_score"), n).alias(n) for n in ("similar", "relevance", "match")))
