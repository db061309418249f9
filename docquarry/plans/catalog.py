"""Registered queries of the core operators, each over whole tables, with its SQL where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docquarry.functions import classify, text
from docquarry.functions import lexicon as L
from docquarry.functions.similarity import content_words, dot, jaccard, simple_similarity
from docquarry.operators import align, engine, highlight, recommend, respond, search, segment, stats, tables
from docquarry.session import spread, table

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}

QUERY = "emergency stock list"
SYNONYM_QUERY = "review policy"
TARGET = "The emergency stock list in the discharge lounge was reviewed"
PATTERNS = ["training programme", "escalation policy", "fire-door"]
SPACE = text.SPACE
STOPS = ", ".join(f"'{w}'" for w in L.STOP_WORDS)


def query(sql: str | None = None) -> Callable[[Query], Query]:
    """Registers a query under its name, and its SQL."""

    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def documents(spark: SparkSession, sf: str) -> DataFrame:
    own = table(spark, sf, "documents").select("doc_id", "text", "filename", "word_count", "file_type", "source", "document_type")
    return spread(own.filter(F.col("text").isNotNull()))


def recs(spark: SparkSession, sf: str) -> DataFrame:
    """Recommendations with a text, repeated deliveries counted once."""
    return table(spark, sf, "recommendations").filter(F.col("text").isNotNull()).dropDuplicates(["rec_key"])


def resps(spark: SparkSession, sf: str) -> DataFrame:
    """Responses with a text, repeated deliveries counted once."""
    return table(spark, sf, "responses").filter(F.col("text").isNotNull()).dropDuplicates(["resp_key"])


def strip(x: str) -> str:
    return f"regexp_replace({x}, '^{SPACE}+|{SPACE}+$', '', 'g')"


def squeeze(x: str) -> str:
    return f"trim(regexp_replace({x}, '{SPACE}+', ' ', 'g'))"


def q(s: str) -> str:
    """A string as an SQL literal."""
    return "'" + s.replace("'", "''") + "'"


def holds(x: str, words: list[str]) -> str:
    return "(" + " OR ".join(f"contains({x}, {q(w)})" for w in words) + ")"


def matches(x: str, patterns: list[str]) -> str:
    return f"regexp_matches({x}, {q('|'.join(f'(?:{p})' for p in patterns))})"


def whole(pattern: str) -> str:
    """A pattern between word boundaries of any script, which the SQL engine's own boundary is not."""
    return r"(?:^|[^\p{L}\p{N}_])" + pattern.removeprefix(r"\b").removesuffix(r"\b") + r"(?:$|[^\p{L}\p{N}_])"


RECS = "(SELECT DISTINCT ON (rec_key) * FROM recommendations WHERE text IS NOT NULL)"
RESPS = "(SELECT DISTINCT ON (resp_key) * FROM responses WHERE text IS NOT NULL)"
DOCS = "(SELECT * FROM documents WHERE length(text) > 0)"
ALL = f"(SELECT doc_id, text, list_transform(string_split_regex(text, '[.!?]+'), lambda x: {strip('x')}) AS l FROM {DOCS})"


def parts(least: int, renumber: bool) -> str:
    """SQL of ``plain_sentences``."""
    if renumber:
        inner = f"SELECT doc_id, text, list_filter(l, lambda x: length(x) >= {least}) AS l FROM {ALL}"
        return f"(SELECT doc_id, text, unnest(l) AS sentence, unnest(range(len(l)))::INTEGER AS ordinal FROM ({inner}))"
    return f"(SELECT * FROM (SELECT doc_id, text, unnest(l) AS sentence, unnest(range(len(l)))::INTEGER AS ordinal FROM {ALL}) WHERE length(sentence) >= {least})"


PAGE = "greatest(1, (position // 2000)::INTEGER + 1)::INTEGER"


@query(f"SELECT doc_id, ordinal, sentence, (instr(text, sentence) - 1)::INTEGER AS position FROM {parts(11, True)}")
def sentences(spark: SparkSession, sf: str) -> DataFrame:
    return segment.plain_sentences(documents(spark, sf), 11, renumber=True)


@query(f"SELECT word, count(*) AS n FROM (SELECT unnest(regexp_extract_all(lower(text), '{text.WORD}')) AS word FROM {DOCS}) WHERE length(word) > 1 AND word NOT IN ({STOPS}) GROUP BY word")
def tokens_ui(spark: SparkSession, sf: str) -> DataFrame:
    return documents(spark, sf).select(F.explode(text.meaningful(F.col("text"))).alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("n"))


@query(f"SELECT word, count(*) AS n FROM (SELECT unnest(regexp_extract_all(text, '{text.HYPHEN_WORD}')) AS word FROM {DOCS}) WHERE length(word) > 2 AND lower(word) NOT IN ({STOPS}) GROUP BY word")
def tokens_core(spark: SparkSession, sf: str) -> DataFrame:
    return documents(spark, sf).select(F.explode(text.meaningful_cased(F.col("text"))).alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("n"))


@query(f"""SELECT doc_id, unnest(l) AS sentence, unnest(range(len(l)))::INTEGER AS ordinal FROM
    (SELECT doc_id, string_split(regexp_replace(text, '([.!?])[ \\t\\n\\f\\r]+([A-Z])', '\\1' || chr(1) || '\\2', 'g'), chr(1)) AS l FROM {DOCS})""")
def sentence_split_terminators(spark: SparkSession, sf: str) -> DataFrame:
    return segment.full_sentences(documents(spark, sf))


@query(f"""WITH p AS (SELECT doc_id, list_filter(string_split(regexp_replace(text, '([.!?][ \\t\\n\\f\\r]+)', '\\1' || chr(1), 'g'), chr(1)), lambda x: length(x) > 0) AS l FROM {DOCS}),
    e AS (SELECT doc_id, unnest(range(len(l)))::INTEGER AS ordinal, unnest(list_transform(l, lambda x: length(x))) AS n FROM p)
    SELECT doc_id, ordinal, (sum(n) OVER w - n)::INTEGER AS start_at, (sum(n) OVER w)::INTEGER AS end_at FROM e WINDOW w AS (PARTITION BY doc_id ORDER BY ordinal)""")
def sentence_spans(spark: SparkSession, sf: str) -> DataFrame:
    return segment.sentence_spans(documents(spark, sf))


@query(f"""SELECT doc_id, ordinal, sentence, context FROM (SELECT doc_id, unnest(l) AS sentence, unnest(range(len(l)))::INTEGER AS ordinal,
    unnest(list_transform(l, lambda x, i: array_to_string(list_filter(l[greatest(i - 2, 1):i + 2], lambda y: y <> ''), ' '))) AS context FROM {ALL}) WHERE sentence <> ''""")
def sentence_context(spark: SparkSession, sf: str) -> DataFrame:
    return segment.sentence_context(documents(spark, sf))


@query(f"""SELECT doc_id, length(text)::INTEGER AS chars, len(list_filter(string_split_regex(text, '{SPACE}+'), lambda x: x <> ''))::INTEGER AS words,
    len(list_filter(string_split_regex(text, '[.!?]+'), lambda x: {strip("x")} <> ''))::INTEGER AS sentences, greatest(1, length(text) // 2000)::INTEGER AS pages FROM documents WHERE text IS NOT NULL""")
def text_metrics(spark: SparkSession, sf: str) -> DataFrame:
    return segment.metrics(documents(spark, sf))


HITS = " + ".join(f"contains(lower(sentence), '{w}')::INTEGER" for w in search.query_words(QUERY))
SMART = f"""SELECT doc_id, ordinal, position, sentence AS matched_text, least(100.0, word_matches * 100.0 / {len(search.query_words(QUERY))} * CASE WHEN word_matches > 1 THEN 1.2 ELSE 1.0 END)::DOUBLE AS score,
    word_matches, {PAGE} AS page_number FROM (SELECT *, ({HITS})::INTEGER AS word_matches, (instr(text, sentence) - 1)::INTEGER AS position FROM {parts(11, True)}) WHERE word_matches > 0"""


@query(SMART)
def smart_search(spark: SparkSession, sf: str) -> DataFrame:
    return search.smart(documents(spark, sf), QUERY)


@query(f"SELECT * FROM ({SMART}) QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY ordinal) <= 10")
def smart_search_topn(spark: SparkSession, sf: str) -> DataFrame:
    found = search.first_per_document(search.smart(documents(spark, sf), QUERY), 10, "ordinal")
    return found.orderBy(F.desc("score"), "doc_id", "ordinal")


@query(f"""WITH d AS (SELECT doc_id, text, list_transform(string_split(lower(text), '{QUERY}'), lambda x: length(x)) AS l FROM documents WHERE contains(lower(text), '{QUERY}')),
    e AS (SELECT doc_id, text, unnest(list_transform(range(1, len(l)), lambda k: list_sum(l[1:k]) + (k - 1) * {len(QUERY)}))::INTEGER AS position FROM d)
    SELECT doc_id, position, substr(text, greatest(position - 150, 0) + 1, least(position + {len(QUERY)} + 150, length(text)) - greatest(position - 150, 0)) AS context, {PAGE} AS page_number FROM e""")
def exact_search(spark: SparkSession, sf: str) -> DataFrame:
    return search.exact(documents(spark, sf), QUERY)


@query(f"SELECT doc_id, ((length(text) - length(replace(lower(text), '{QUERY}', ''))) // {len(QUERY)})::INTEGER AS matches FROM documents WHERE contains(lower(text), '{QUERY}')")
def basic_search(spark: SparkSession, sf: str) -> DataFrame:
    return search.basic(documents(spark, sf), QUERY)


WANTED = "[" + ", ".join(f"'{w}'" for w in sorted(set(search.query_words(TARGET)))) + "]"


@query(f"""SELECT doc_id, ordinal, sentence, len(list_intersect(w, {WANTED}))::DOUBLE / len(list_distinct(list_concat(w, {WANTED}))) AS similarity FROM
    (SELECT *, list_distinct(list_filter(regexp_extract_all(lower(sentence), '{text.WORD}'), lambda x: length(x) > 1 AND x NOT IN ({STOPS}))) AS w FROM {parts(20, False)})
    WHERE len(w) > 0 AND len(list_intersect(w, {WANTED}))::DOUBLE / len(list_distinct(list_concat(w, {WANTED}))) >= 0.3""")
def similar_content(spark: SparkSession, sf: str) -> DataFrame:
    return search.similar_content(documents(spark, sf), TARGET)


def _synonym_sql() -> str:
    rows = [f"SELECT *, {q(w)} AS query_word, greatest({', '.join(f'CASE WHEN contains(lower(sentence), {q(r)}) THEN {s} END' for x, r, s in search.synonym_scores(SYNONYM_QUERY) if x == w)})::DOUBLE AS score FROM {parts(1, False)}" for w in search.query_words(SYNONYM_QUERY)]
    return "SELECT doc_id, ordinal, (instr(text, sentence) - 1)::INTEGER AS position, sentence AS matched_text, query_word, score FROM (" + " UNION ALL ".join(rows) + ") WHERE score IS NOT NULL"


@query(_synonym_sql())
def synonym_matches(spark: SparkSession, sf: str) -> DataFrame:
    return search.synonyms(documents(spark, sf), SYNONYM_QUERY)


def greedy(inner: str, *ties: str) -> str:
    """SQL of ``remove_overlaps`` by position, length and score within a document."""
    order = ", ".join(["score DESC", "a", "b", *ties])
    return f"""WITH RECURSIVE m AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY {order}) AS rn FROM (SELECT *, position AS a, position + length(matched_text) AS b FROM ({inner}))),
        g AS (SELECT DISTINCT doc_id, 0::BIGINT AS i, []::STRUCT(x BIGINT, y BIGINT)[] AS kept, false AS ok FROM m
              UNION ALL SELECT doc_id, rn, CASE WHEN free THEN list_append(kept, {{'x': a::BIGINT, 'y': b::BIGINT}}) ELSE kept END, free
              FROM (SELECT m.doc_id, m.rn, m.a, m.b, g.kept, len(list_filter(g.kept, lambda k: k.x < m.b AND m.a < k.y)) = 0 AS free FROM g JOIN m ON m.doc_id = g.doc_id AND m.rn = g.i + 1))
        SELECT m.* EXCLUDE (a, b, rn) FROM m JOIN g ON m.doc_id = g.doc_id AND m.rn = g.i WHERE g.ok"""


@query(greedy(_synonym_sql(), "ordinal", "query_word"))
def synonym_search(spark: SparkSession, sf: str) -> DataFrame:
    return search.synonym_search(documents(spark, sf), SYNONYM_QUERY)


@query(greedy(SMART, "ordinal"))
def overlap_removal(spark: SparkSession, sf: str) -> DataFrame:
    found = search.smart(documents(spark, sf), QUERY).withColumn("upto", F.col("position") + F.length("matched_text"))
    return segment.remove_overlaps(found, "position", "upto", "score", "doc_id", ties=("ordinal",)).drop("upto")


HYBRID = "review"


def _hybrid_sql() -> str:
    smart_part = SMART.replace(HITS, f"contains(lower(sentence), '{HYBRID}')::INTEGER").replace(f"/ {len(search.query_words(QUERY))} *", "/ 1 *")
    synonym_part = f"SELECT doc_id, (instr(text, sentence) - 1)::INTEGER AS position, sentence AS matched_text, greatest({', '.join(f'CASE WHEN contains(lower(sentence), {q(r)}) THEN {s} END' for _, r, s in search.synonym_scores(HYBRID))})::DOUBLE AS score FROM {parts(1, False)}"
    return f"""SELECT doc_id, position, matched_text, score, source FROM (SELECT doc_id, position, matched_text, score, 'smart' AS source FROM ({smart_part})
        UNION ALL SELECT doc_id, position, matched_text, score, 'semantic' FROM ({synonym_part}) WHERE score IS NOT NULL)
        QUALIFY row_number() OVER (PARTITION BY doc_id, position, matched_text ORDER BY score DESC, source DESC) = 1"""


@query(_hybrid_sql())
def hybrid_merge(spark: SparkSession, sf: str) -> DataFrame:
    return search.hybrid(documents(spark, sf), HYBRID)


@query()
def fuzzy_search(spark: SparkSession, sf: str) -> DataFrame:
    return search.fuzzy(documents(spark, sf), "eskalation registry")


def _clean_sql() -> str:
    x = "text"
    for old, new in [("â€™", "'"), ("â€œ", '"'), ("â€", '"'), ("ﬁ", "fi"), ("ﬂ", "fl"), ("ﬀ", "ff"), ("ﬃ", "ffi"), ("ﬄ", "ffl"), ("–", "-"), ("—", "-"), ("…", "...")]:
        x = f"replace({x}, {q(old)}, {q(new)})"
    for cp, new in [(0xA0, "' '"), (0x2009, "' '"), (0x200B, "''"), (0x202F, "' '"), (0x2028, "chr(10)"), (0x2029, "chr(10) || chr(10)")]:
        x = f"replace({x}, chr({cp}), {new})"
    for p in (rf"\n{SPACE}*\d+{SPACE}*\n", rf"(?i)\n{SPACE}*Page{SPACE}+\d+{SPACE}*\n", rf"(?i)\n{SPACE}*\d+{SPACE}+of{SPACE}+\d+{SPACE}*\n"):
        x = f"regexp_replace({x}, '{p}', chr(10), 'g')"
    lines = f"SELECT doc_id, string_split({x}, chr(10)) AS l FROM documents WHERE text IS NOT NULL"
    often = f"SELECT doc_id, line FROM (SELECT doc_id, unnest(list_transform(l, lambda y: {strip('y')})) AS line FROM a) WHERE length(line) BETWEEN 11 AND 99 GROUP BY ALL HAVING count(*) > 3"
    kept = f"SELECT a.doc_id, array_to_string(list_filter(l, lambda y: NOT list_contains(coalesce(f, []), {strip('y')})), chr(10)) AS t FROM a LEFT JOIN (SELECT doc_id, list(line) AS f FROM b GROUP BY doc_id) USING (doc_id)"
    y = f"regexp_replace(t, '\\n{SPACE}*\\d+[a-z]?{SPACE}*\\n', chr(10), 'g')"
    y = f"regexp_replace(regexp_replace(regexp_replace({y}, '([a-z,;])\\n([a-z])', '\\1 \\2', 'g'), ' {{2,}}', ' ', 'g'), '\\n{{3,}}', chr(10) || chr(10), 'g')"
    last = f"array_to_string(list_filter(string_split({y}, chr(10)), lambda z: NOT regexp_matches({strip('z')}, '^(?:\\p{{Nd}}{{1,9}}|\\p{{L}}{{1,3}})$')), chr(10))"
    return f"WITH a AS ({lines}), b AS ({often}), c AS ({kept}) SELECT doc_id, {strip(last)} AS text FROM c"


@query(_clean_sql())
def clean_document(spark: SparkSession, sf: str) -> DataFrame:
    return documents(spark, sf).select("doc_id", text.clean_document(F.col("text")).alias("text"))


PRINTED = "concat('03/04/2021, 10:15 AM ', text, ' https://www.gov.uk/report 2/7 Government response to the rapid review page GOV.UK 12')"


@query(f"""SELECT rec_key, trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace({PRINTED}, '\\d{{1,2}}/\\d{{1,2}}/\\d{{2,4}},?\\s+\\d{{1,2}}:\\d{{2}}\\s*(?:AM|PM)?\\s*', '', 'g'),
    'https?://[^\\s]+', '', 'g'), '(?i)Government response to the rapid review.*?GOV\\.UK[^\\n]*', '', 'g'), '{SPACE}+', ' ', 'g')) AS text, {matches(PRINTED, ["(?i)" + p for p in L.ARTIFACTS])} AS marked FROM {RECS}""")
def clean_pdf(spark: SparkSession, sf: str) -> DataFrame:
    own = F.expr(PRINTED)
    return recs(spark, sf).select("rec_key", text.clean_pdf(own).alias("text"), text.has_artifacts(own).alias("marked"))


def _strict_sql() -> str:
    x = "text"
    for old, new in [("â€™", "'"), ("â€œ", '"'), ("â€", '"'), ("Â ", " "), ("\xa0", " "), ("\ufffd", "")]:
        x = f"replace({x}, {q(old)}, {q(new)})"
    between = (r"([a-z])\s+\d{1,2}\s+([a-z])", r"\1 \2")  # twice, since a match takes the letter that the next one begins with
    steps = [
        (r"https?://[^\s<>\"']+", ""), (r"www\.[^\s<>\"']+", ""), (r"[a-zA-Z0-9.-]+\.gov\.uk[^\s]*", ""), (r"[a-zA-Z0-9.-]+\.org\.uk[^\s]*", ""), (r"[a-zA-Z0-9.-]+\.nhs\.uk[^\s]*", ""),
        (r"(?i)\d{1,2}/\d{1,2}/\d{2,4},?\s*\d{1,2}:\d{2}\s*(?:AM|PM)?[^A-Z]*", " "), (r"\b(\d{1,2})/(\d{1,3})\b", ""), (r"(?i)\bPage\s+\d+\s+(?:of\s+\d+)?", ""),
        (r"\s+\d{1,2}\s*$", ""), (r"^\s*\d{1,2}\s+([A-Z])", r"\1"), (r"\n\s*\d{1,2}\s*\n", "\n"), (r"([.!?])\s*\d{1,2}\s*([A-Z])", r"\1 \2"), between, between,
        (r"(?i)Rapid review into data on mental health inpatient settings:.*?GOV\.?UK", ""), (r"(?i)final report and recommendations\s*-?\s*GOV\.?UK?", ""), (r"(?i)-\s*GOV\.?\s*UK?\s*", ""),
        (r"(?i)\bRecommendations\s+Recommendation\s+(\d+)\b", r"Recommendation \1"), (r"^UK\s+", ""),
    ]
    for pattern, new in steps:
        x = f"regexp_replace({x}, {q(pattern)}, {q(new)}, 'g')"
    return f"SELECT rec_key, {squeeze(x)} AS text FROM {RECS}"


@query(_strict_sql())
def clean_strict(spark: SparkSession, sf: str) -> DataFrame:
    return recs(spark, sf).select("rec_key", text.clean_strict(F.col("text")).alias("text"))


HTML = "concat('<p class=\"a\">', coalesce(text, ''), '</p>&amp;<b>&lt;x&gt;</b>')"


@query(f"SELECT doc_id, {squeeze(f'''replace(replace(replace(replace(replace(regexp_replace({HTML}, '<[^>]+>', '', 'g'), '&amp;', '&'), '&lt;', '<'), '&gt;', '>'), '&quot;', '\"'), '&#39;', chr(39))''')} AS text FROM documents WHERE text IS NOT NULL")
def clean_html(spark: SparkSession, sf: str) -> DataFrame:
    return documents(spark, sf).select("doc_id", text.clean_html(F.expr(HTML)).alias("text"))


@query(f"SELECT doc_id, line, count(*) AS times FROM (SELECT doc_id, unnest(list_transform(string_split(text, chr(10)), lambda x: {strip('x')})) AS line FROM documents WHERE text IS NOT NULL) WHERE length(line) BETWEEN 11 AND 99 GROUP BY ALL HAVING count(*) > 3")
def repeated_lines(spark: SparkSession, sf: str) -> DataFrame:
    return segment.repeated_lines(documents(spark, sf))


@query(f"""WITH p AS (SELECT doc_id, text, unnest(string_split(text, chr(10) || chr(10))) AS para, unnest(range(len(string_split(text, chr(10) || chr(10))))) AS pos FROM documents WHERE text IS NOT NULL),
    k AS (SELECT *, row_number() OVER (PARTITION BY doc_id, {strip("para")} ORDER BY pos) AS r FROM p)
    SELECT doc_id, CASE WHEN length(any_value(text)) < 100 THEN any_value(text) ELSE string_agg(para, chr(10) || chr(10) ORDER BY pos) END AS text FROM k WHERE r = 1 OR length({strip("para")}) < 50 GROUP BY doc_id""")
def repeated_paragraphs(spark: SparkSession, sf: str) -> DataFrame:
    return segment.distinct_paragraphs(documents(spark, sf))


def _pages_sql() -> str:
    each = "SELECT doc_id, unnest(string_split(text, chr(12))) AS body, unnest(range(len(string_split(text, chr(12))))) + 1 AS page FROM documents WHERE length(text) > 0"
    lines = f"SELECT doc_id, page, list_filter(list_transform(string_split(body, chr(10)), lambda x: {strip('x')}), lambda x: x <> '') AS l FROM e"
    norm = f"regexp_replace(regexp_replace({squeeze('line')}, '\\b\\d+/\\d+\\b', 'PAGE_NUM/TOTAL', 'g'), '\\d{{1,2}}/\\d{{1,2}}/\\d{{2,4}},?\\s+\\d{{1,2}}:\\d{{2}}(?::\\d{{2}})?\\s*(?:AM|PM)?', 'DATE_TIME', 'g')"
    return f"""WITH e AS ({each}), l AS ({lines}), x AS (SELECT doc_id, page::INTEGER AS page, unnest(l) AS line, unnest(range(len(l)))::INTEGER AS elem, len(l) AS n FROM l),
        y AS (SELECT *, {norm} AS norm, (elem < 2)::INTEGER + (elem >= n - 3)::INTEGER AS times FROM x),
        z AS (SELECT doc_id, norm FROM (SELECT doc_id, norm, sum(times) AS times FROM y WHERE times > 0 AND length(norm) >= 10 GROUP BY ALL) JOIN (SELECT doc_id, count(DISTINCT page) AS pages FROM x GROUP BY doc_id) USING (doc_id)
              WHERE times >= greatest(2, floor(pages * 0.3)))
        SELECT doc_id, page, elem, line FROM y ANTI JOIN z USING (doc_id, norm)"""


@query(_pages_sql())
def header_footer(spark: SparkSession, sf: str) -> DataFrame:
    return segment.without_running_lines(segment.pages(documents(spark, sf))).select("doc_id", "page", "elem", "line")


@query(f"""WITH p AS (SELECT doc_id, page, string_agg(line, chr(10) ORDER BY elem) AS text FROM ({_pages_sql()}) GROUP BY doc_id, page)
    SELECT doc_id, page, start_at, (start_at + length(text))::INTEGER AS end_at FROM (SELECT *, coalesce(sum(length(text) + 2) OVER (PARTITION BY doc_id ORDER BY page ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::INTEGER AS start_at FROM p)""")
def page_spans(spark: SparkSession, sf: str) -> DataFrame:
    return segment.page_texts(segment.without_running_lines(segment.pages(documents(spark, sf)))).select("doc_id", "page", "start_at", "end_at")


THEME = "CASE " + " ".join(f"WHEN {holds('lower(sentence)', words)} THEN '{name}'" for name, words in L.THEMES) + " ELSE 'General' END"


@query(f"SELECT doc_id, ordinal, sentence, position, CASE WHEN position >= 0 THEN {PAGE} ELSE 1 END AS page_number, {THEME} AS content_type FROM (SELECT *, (instr(text, sentence) - 1)::INTEGER AS position FROM {parts(1, False)}) WHERE {holds('lower(sentence)', PATTERNS)}")
def pattern_match(spark: SparkSession, sf: str) -> DataFrame:
    return search.pattern_matches(documents(spark, sf), PATTERNS)


@query(f"SELECT rec_key, {THEME} AS content_type FROM (SELECT rec_key, text AS sentence FROM {RECS})")
def content_type(spark: SparkSession, sf: str) -> DataFrame:
    return recs(spark, sf).select("rec_key", classify.theme(F.col("text")).alias("content_type"))


@query(f"""SELECT doc_id, CASE WHEN text = '' THEN 'unknown' {" ".join(f"WHEN regexp_matches(lower(text), {q(whole(p))}) THEN '{k}'" for k, p in L.DOCUMENT_TYPES)}
    WHEN {holds("lower(filename)", ["report", "analysis"])} THEN 'report' WHEN {holds("lower(filename)", ["inquiry", "investigation"])} THEN 'inquiry' ELSE 'general' END AS kind,
    CASE WHEN contains(lower(text), 'recommendation') OR contains(lower(filename), 'recommend') THEN 'recommendation' WHEN contains(lower(text), 'response') OR contains(lower(filename), 'response') THEN 'response'
    WHEN contains(lower(text), 'policy') OR contains(lower(filename), 'policy') THEN 'policy' ELSE 'document' END AS engine_kind FROM documents WHERE text IS NOT NULL""")
def document_type(spark: SparkSession, sf: str) -> DataFrame:
    t, f = F.col("text"), F.col("filename")
    return documents(spark, sf).select("doc_id", classify.document_type(t, f).alias("kind"), classify.engine_document_type(t, f).alias("engine_kind"))


# Response documents of every layout, made of the responses of the table: the same expression in both engines.
NL = "chr(10)"
ID = "concat('R/2024/', lpad(cast(resp_key % 900 AS VARCHAR(9)), 3, '0'))"
REPORT = f"""CASE resp_key % 6
    WHEN 0 THEN concat('Recommendations 40, 5,41 and 42 relate to other organisations', {NL}, 'Recommendation ', cast(resp_key % 30 + 1 AS VARCHAR(9)), ' *', {NL}, 'The ward must keep a log.', {NL}, 'TEWV response: ', text, {NL},
        'Recommendation 3 1', {NL}, 'Trust response: This was completed in full before the visit took place.', {NL}, 'Recommendation 40', {NL}, 'Trust response: This one is for another organisation to answer.')
    WHEN 1 THEN concat('Summary', {NL}, 'NHS England', {NL}, 'HSSIB recommends that NHS England acts.', {NL}, 'Safety recommendation ', {ID}, {NL}, 'Response', {NL}, text, {NL}, 'Actions planned to deliver', {NL}, 'None.', {NL},
        'The Shelford Group', {NL}, 'Safety recommendation R/2023/001', {NL}, 'Response', {NL}, 'We will share this learning with all of our members soon.', {NL}, 'Response received on 4 May', {NL}, 'Safety actions', {NL}, 'Text.')
    WHEN 2 THEN concat('HSIB recommends that NHS England reviews the guidance for planning.', {NL}, 'Response', {NL}, text, {NL}, 'Response received on 3 May 2021', {NL}, 'HSIB recommends that the Care Quality Commission updates its process.', {NL}, 'Response', {NL},
        'Care Quality Commission is working on this with its partners.', {NL}, 'Safety observation one.')
    WHEN 3 THEN concat('Recommendation 2018/006: act now.', {NL}, 'Response', {NL}, text, {NL}, 'Recommendation 2018/007: act later.', {NL}, 'Response', {NL}, 'NHS England has begun work with partners on the second point.', {NL})
    WHEN 4 THEN concat('Recommendation ', cast(resp_key % 20 + 1 AS VARCHAR(9)), ' The board should act. Government response to recommendation ', cast(resp_key % 20 + 1 AS VARCHAR(9)), ' ', text, ' Recommendation 50 The panel should meet. ',
        'The government accepts that this work must be done by the end of the year. We accept it. We recommend that nobody waits for the next inspection to begin.')
    ELSE text END"""


def reports(spark: SparkSession, sf: str) -> DataFrame:
    """Response documents of every layout."""
    return resps(spark, sf).select(F.col("resp_key").alias("doc_id"), F.expr(REPORT).alias("text")).filter(F.length("text") > 0)


REPORTS = f"(SELECT * FROM (SELECT resp_key AS doc_id, {REPORT} AS text FROM {RESPS}) WHERE length(text) > 0)"
STRUCTURED_LINES = r"(?im)(?:^|\n)(?:The\s+Shelford\s+Group|NHS\s+England|Department\s+of\s+Health\s+and\s+Social\s+Care|DHSC|Care\s+Quality\s+Commission|NICE)\s*\n"
ANY_LINES = r"(?im)(?:^|\n)\s*(?:NHS\s+England|Care\s+Quality\s+Commission|National\s+Institute|Royal\s+College|NICE|DHSC|The\s+Shelford\s+Group)\s*(?:\n|$)"
LAYOUT = f"""CASE WHEN regexp_matches(text, '(?i)(?:TEWV|Trust)\\s+response[:\\s]') AND regexp_matches(text, '(?i)Recommendation\\s+\\d+') THEN 'trust'
    WHEN regexp_matches(text, '(?i)HSSIB\\s+recommends') AND regexp_matches(text, 'R/\\d{{4}}/\\d{{3}}') AND regexp_matches(text, '(?m)(?:^|\\n)Response\\n') AND regexp_matches(text, {q(STRUCTURED_LINES)})
        AND regexp_matches(text, '(?i)Actions\\s+planned\\s+to\\s+deliver|Response\\s+received\\s+on') THEN 'hssib_org'
    WHEN regexp_matches(text, '(?i)HSIB\\s+recommends') AND (regexp_matches(text, '(?i)\\bResponse\\b\\s*(?:NHS\\s+England|Care\\s+Quality\\s+Commission|The\\s+National|We\\s+(?:are|have|welcome)|NICE\\s+is)') OR regexp_matches(text, '(?m)(?:^|\\n)\\s*Response\\s*(?:\\n|$)'))
        AND (regexp_matches(text, {q(ANY_LINES)}) OR regexp_matches(text, '(?i)(?:process|planning|guidance|services|management)[.\\s]+(?:Response\\s+)?(?:NHS\\s+England|Care\\s+Quality\\s+Commission|National\\s+Institute|Royal\\s+College)')
        OR len(list_distinct(regexp_extract_all(lower(text), {q("(?i)" + L.ORG_NAMES)}))) >= 2) AND NOT regexp_matches(text, 'R/\\d{{4}}/\\d{{3}}') THEN 'hsib_org'
    WHEN regexp_matches(text, '[Rr]ecommendation\\s*[R/]?\\s*\\d{{4}}\\s*/\\s*\\d{{3}}') OR (regexp_matches(text, '(?i)\\bH[SS]I?B\\b') AND regexp_matches(text, '(?i)\\bResponse\\b')) THEN 'hsib' ELSE 'government' END"""


@query(f"SELECT doc_id, {LAYOUT} AS layout FROM {REPORTS}")
def layout_detect(spark: SparkSession, sf: str) -> DataFrame:
    return reports(spark, sf).select("doc_id", classify.layout(F.col("text")).alias("layout"))


@query(f"""SELECT doc_id, CASE {" ".join(f"WHEN {holds('lower(text)', p)} THEN '{k}'" for k, p in L.ORGANISATIONS)} END AS org, CASE {" ".join(f"WHEN regexp_matches(text, {q('(?i)' + p)}) THEN '{k}'" for p, k in L.DIRECTED)} END AS directed,
    CASE WHEN {holds("lower(substr(text, 1, 2000))", ["tewv response", "tees, esk and wear"])} THEN 'tewv' WHEN contains(lower(substr(text, 1, 2000)), 'hsib recommends that nhs england') THEN 'multi_org_hsib'
    WHEN contains(lower(substr(text, 1, 2000)), 'government response') THEN 'government' END AS author FROM {REPORTS}""")
def target_org(spark: SparkSession, sf: str) -> DataFrame:
    t = F.col("text")
    return reports(spark, sf).select("doc_id", classify.organisation(t).alias("org"), classify.directed_organisation(t).alias("directed"), classify.responding_organisation(t).alias("author"))


@query(f"""SELECT doc_id, n FROM (SELECT doc_id, unnest(list_sort(list_distinct(list_transform(regexp_extract_all(regexp_extract(text, '(?i)recommendations?\\s+([\\d,\\s]+(?:and\\s+\\d+)?)\\s+relate\\s+to\\s+other\\s+organi[sz]ations', 1), '\\d+'), lambda x: x::INTEGER)))) AS n FROM {REPORTS})""")
def excluded_recs(spark: SparkSession, sf: str) -> DataFrame:
    return reports(spark, sf).select("doc_id", F.explode(classify.excluded_numbers(F.col("text"))).alias("n"))


@query(f"SELECT rec_key AS key, regexp_matches({strip('lower(text)')}, {q('^(?:' + '|'.join(L.RECOMMENDING) + ')')}) AS recommends, regexp_matches({strip('lower(text)')}, {q('^(?:' + '|'.join(L.RESPONDING) + ')')}) AS responds, {matches('lower(text)', L.META)} AS meta FROM {RECS}")
def sentence_roles(spark: SparkSession, sf: str) -> DataFrame:
    t = F.col("text")
    return recs(spark, sf).select(F.col("rec_key").alias("key"), classify.is_recommendation_text(t).alias("recommends"), classify.is_genuine_response(t).alias("responds"), classify.is_meta(t).alias("meta"))


def _responses(name: str) -> Query:
    def run(spark: SparkSession, sf: str) -> DataFrame:
        docs = reports(spark, sf).filter(classify.layout(F.col("text")) == name)
        return respond.LAYOUTS[name](docs)

    return run


for _name in respond.LAYOUTS:
    QUERIES[f"responses_{_name}"] = _responses(_name)

@query()
def responses_all(spark: SparkSession, sf: str) -> DataFrame:
    return respond.extract(reports(spark, sf))


@query()
def responses_v2(spark: SparkSession, sf: str) -> DataFrame:
    pre = table(spark, sf, "preprocessed_text").dropDuplicates(["doc_id"]).select("doc_id", "text", "sentence_spans")
    spans = F.array().cast("array<struct<start_at:int,end_at:int>>")
    return respond.extract_preprocessed(pre.unionByName(reports(spark, sf).select((F.col("doc_id") + 10_000_000).alias("doc_id"), "text", spans.alias("sentence_spans"))))


# Reports with numbered recommendations, made of the recommendations of the table.
NUMBERED = """CASE rec_key % 4
    WHEN 0 THEN concat('Introduction. Recommendation ', cast(rec_key % 9 + 1 AS VARCHAR(9)), ': ', text, ' Recommendation ', cast(rec_key % 9 + 2 AS VARCHAR(9)), ': NHS England should review its guidance on staffing and publish it. Lessons learned from the visits follow here.')
    WHEN 1 THEN concat('Safety recommendation R/2023/220: ', text, ' Appendix A holds the tables.') WHEN 2 THEN concat('Recommendation 2018/006: ', text) ELSE text END"""


def numbered_reports(spark: SparkSession, sf: str) -> DataFrame:
    return recs(spark, sf).select(F.col("rec_key").alias("doc_id"), F.expr(NUMBERED).alias("text"))


@query()
def recommendations_headings(spark: SparkSession, sf: str) -> DataFrame:
    return recommend.distinct_numbers(recommend.numbered(numbered_reports(spark, sf)))


@query()
def recommendations_sentences(spark: SparkSession, sf: str) -> DataFrame:
    return recommend.distinct_openings(recommend.from_sentences(recs(spark, sf).select(F.col("rec_key").alias("doc_id"), "text")))


@query()
def recommendations_all(spark: SparkSession, sf: str) -> DataFrame:
    return recommend.extract(numbered_reports(spark, sf))


@query()
def recommendations_v2(spark: SparkSession, sf: str) -> DataFrame:
    pre = table(spark, sf, "preprocessed_text").dropDuplicates(["doc_id"]).select("doc_id", "text", "sentence_spans")
    spans = F.array().cast("array<struct<start_at:int,end_at:int>>")
    return recommend.extract_preprocessed(pre.unionByName(numbered_reports(spark, sf).select((F.col("doc_id") + 10_000_000).alias("doc_id"), "text", spans.alias("sentence_spans"))))


@query(f"""SELECT rec_key, strong > 0 OR weak > 1 AS is_recommendation, CASE WHEN text = '' THEN 0.0 WHEN strong > 0 THEN least(0.7 + strong * 0.1, 0.95) WHEN weak > 1 THEN 0.6 ELSE 0.3 END::DOUBLE AS confidence FROM
    (SELECT rec_key, text, {" + ".join(f"contains(lower(text), '{w}')::INTEGER" for w in ("should", "must", "shall", "recommend", "require", "needs to", "ought to", "is required to"))} AS strong,
    {" + ".join(f"contains(lower(text), '{w}')::INTEGER" for w in ("consider", "review", "ensure", "develop", "implement"))} AS weak FROM {RECS})""")
def recommendation_likeness(spark: SparkSession, sf: str) -> DataFrame:
    e = classify.recommendation_likeness(F.col("text"))
    return recs(spark, sf).select("rec_key", e["is_recommendation"].alias("is_recommendation"), e["confidence"].alias("confidence"))


@query(f"""WITH w AS (SELECT doc_id, rec_key AS position, text, list_distinct(list_filter(string_split_regex(lower(text), '{SPACE}+'), lambda x: x <> '')) AS w FROM {RECS})
    SELECT doc_id, position, text FROM w a WHERE NOT EXISTS (SELECT 1 FROM w b WHERE b.doc_id = a.doc_id AND b.position < a.position AND len(a.w) > 0 AND len(b.w) > 0
        AND len(list_intersect(a.w, b.w))::DOUBLE / len(list_distinct(list_concat(a.w, b.w))) > 0.85)""")
def recommendations_alike(spark: SparkSession, sf: str) -> DataFrame:
    return recommend.distinct_alike(recs(spark, sf).select("doc_id", F.col("rec_key").alias("position"), "text"))


def entries(column: str) -> F.Column:
    """A map as text."""
    return F.array_join(F.transform(F.map_entries(column), lambda e: F.concat(e["key"], F.lit(":"), e["value"].cast("string"))), ",")


@query(f"""WITH r AS (SELECT *, coalesce(method, 'unknown') AS m, coalesce(verb, 'unknown') AS v FROM {RECS})
    SELECT count(*) AS total, count(DISTINCT verb) AS unique_verbs, round(avg(confidence), 3) AS mean_confidence, count_if(in_section) AS in_section, count_if(confidence >= 0.9) AS high,
    count_if(confidence >= 0.75 AND confidence < 0.9) AS medium, (SELECT string_agg(m || ':' || n, ',' ORDER BY m) FROM (SELECT m, count(*) AS n FROM r GROUP BY m)) AS methods,
    (SELECT string_agg(v || ':' || n, ',' ORDER BY n DESC, v) FROM (SELECT v, count(*) AS n FROM r GROUP BY v ORDER BY n DESC, v LIMIT 10)) AS top_verbs FROM r""")
def rec_statistics(spark: SparkSession, sf: str) -> DataFrame:
    return recommend.statistics(recs(spark, sf)).withColumns({c: entries(c) for c in ("methods", "top_verbs")})


@query(f"SELECT doc_id, rec_number, rec_key FROM (SELECT *, CASE WHEN regexp_matches(rec_number, '^[0-9]+$') THEN rec_number END AS n FROM {RECS} WHERE rec_number IS NOT NULL) QUALIFY row_number() OVER (PARTITION BY doc_id, rec_number ORDER BY length(text) DESC, position NULLS FIRST, rec_key) = 1")
def rec_dedup(spark: SparkSession, sf: str) -> DataFrame:
    rows = recs(spark, sf).filter(F.col("rec_number").isNotNull()).withColumn("position", F.struct("position", "rec_key"))
    return recommend.distinct_numbers(rows).select("doc_id", "rec_number", "rec_key")


def _status_sql(x: str) -> tuple[str, str]:
    """SQL of the status and of its confidence; the look-ahead is counted instead."""
    ahead = r"\bbroadly\s+support(?:s|ed)?(?!\s+(?:the|this)\s+recommendation)"
    label, conf = [], []
    for k, (status, c, patterns) in enumerate(L.STATUS_RULES):
        met = matches(x, [p for p in patterns if p != ahead])
        if ahead in patterns:
            met = f"({met} OR len(regexp_extract_all({x}, '\\bbroadly\\s+support')) > len(regexp_extract_all({x}, '\\bbroadly\\s+support\\s+(?:the|this)\\s+recommendation')))"
        label.append(f"WHEN {met} THEN '{status}'")
        conf.append(f"WHEN {met} THEN {c}")
        if k == 1:
            met = f"{matches(x, L.REFUSED_MEANS)} AND regexp_matches({x}, '{L.SOFTENED}')"
            label.append(f"WHEN {met} THEN 'Partial'")
            conf.append(f"WHEN {met} THEN 0.8")
    return f"CASE {' '.join(label)} ELSE 'Unclear' END", f"(CASE {' '.join(conf)} ELSE 0.5 END)::DOUBLE"


STATUS, CONFIDENCE = _status_sql("lower(text)")


@query(f"SELECT resp_key, {STATUS} AS status, {CONFIDENCE} AS confidence FROM {RESPS}")
def response_status(spark: SparkSession, sf: str) -> DataFrame:
    return resps(spark, sf).withColumn("s", classify.response_status(F.col("text"))).select("resp_key", "s.status", "s.confidence")


@query("SELECT coalesce(status, 'No Response') AS status, count(*) AS n FROM (SELECT DISTINCT * FROM alignments) GROUP BY 1")
def status_counts(spark: SparkSession, sf: str) -> DataFrame:
    return stats.status_counts(table(spark, sf, "alignments").distinct())


@query("""SELECT count(*) AS total, count_if(has_response) AS answered, avg(CASE WHEN NOT isnan(similarity) THEN similarity END) AS mean_similarity, count_if(NOT isnan(similarity) AND similarity > 0.7) AS high FROM (SELECT DISTINCT * FROM alignments)""")
def alignment_summary(spark: SparkSession, sf: str) -> DataFrame:
    return stats.alignment_summary(table(spark, sf, "alignments").distinct())


BODY = "CASE " + " ".join(f"WHEN instr(lower(text), '{p}') > 1 THEN substr(text, instr(lower(text), '{p}'))" for p in L.REPLY_OPENINGS) + " ELSE text END"
REC_NUMBER = "coalesce(nullif(regexp_extract(text, 'R/\\d{4}/\\d{3}'), ''), nullif(regexp_extract(text, '\\b(\\d{4}/\\d{3})\\b', 1), ''), nullif(regexp_extract(lower(text), 'recommendation\\s+(\\d+)', 1), ''))"
CONTENT = f"list_filter(list_distinct(regexp_extract_all(lower(text), '{text.WORD}')), lambda x: x NOT IN ({STOPS}))"


def normal(x: str) -> str:
    return f"nullif(regexp_replace({strip(x)}, '^R/', ''), '')"


SELF = """(CASE WHEN ra = rb THEN true WHEN length(ra) > 100 AND length(rb) > 100 AND (contains(rb, ra) OR contains(ra, rb)) THEN NOT (contains(substr(rb, 1, 100), 'government response') OR contains(substr(rb, 1, 100), 'the government'))
    ELSE length(ra) > 150 AND length(rb) > 150 AND substr(ra, 1, 150) = substr(rb, 1, 150) END)"""
TERMS = "[" + ", ".join(f"'{w}'" for w in L.GOVERNMENT_TERMS) + "]"


@query(f"""WITH l AS (SELECT doc_id, rec_key, text, {CONTENT} AS a, {normal(f"coalesce({REC_NUMBER}, rec_number)")} AS rn, regexp_replace({strip("lower(text)")}, '\\s+', ' ', 'g') AS ra FROM {RECS}),
    b AS (SELECT doc_id, resp_key, {BODY} AS text, {normal("coalesce(rec_number, rec_id)")} AS pn FROM {RESPS}),
    r AS (SELECT *, {CONTENT} AS b, {holds("lower(text)", L.REPLY_PHRASES)} AS reply, regexp_replace({strip("lower(text)")}, '\\s+', ' ', 'g') AS rb, {STATUS} AS status, {CONFIDENCE} AS status_confidence FROM b),
    p AS (SELECT rec_key, resp_key, status, status_confidence, CASE WHEN len(a) = 0 OR len(b) = 0 THEN 0.0 ELSE least(len(list_intersect(a, b))::DOUBLE / len(list_distinct(list_concat(a, b)))
            + least(len(list_intersect(list_intersect(a, b), {TERMS})) * 0.05::DOUBLE, 0.15::DOUBLE), 1.0::DOUBLE) END + CASE WHEN rn = pn THEN 0.4 ELSE 0.0 END::DOUBLE + CASE WHEN reply THEN 0.2 ELSE 0.0 END::DOUBLE AS score
          FROM l JOIN r USING (doc_id) WHERE NOT {SELF}),
    m AS (SELECT * FROM p WHERE score >= 0.25 QUALIFY row_number() OVER (PARTITION BY rec_key ORDER BY round(score, 12) DESC, resp_key) = 1)
    SELECT rec_key, resp_key, CASE WHEN score > 1 THEN 1.0::DOUBLE ELSE score END AS similarity, status, status_confidence, resp_key IS NOT NULL AS has_response FROM (SELECT rec_key FROM l) LEFT JOIN m USING (rec_key)""")
def align_keyword(spark: SparkSession, sf: str) -> DataFrame:
    return align.by_keywords(recs(spark, sf), resps(spark, sf))


CASED = f"list_distinct(list_filter(regexp_extract_all(text, '{text.HYPHEN_WORD}'), lambda x: length(x) > 2 AND lower(x) NOT IN ({STOPS})))"


TOP_THREE = f"""WITH l AS (SELECT doc_id, rec_key, position AS p, {CASED} AS a FROM {RECS}), r AS (SELECT doc_id AS rd, resp_key, position AS pp, {CASED} AS b FROM {RESPS}),
    k AS (SELECT rec_key, resp_key, count(*) AS shared FROM (SELECT rec_key, unnest(a) AS word FROM l) JOIN (SELECT resp_key, unnest(b) AS word FROM r) USING (word) GROUP BY ALL),
    s AS (SELECT rec_key, resp_key, coalesce(doc_id = rd, false) AS same_document, shared::DOUBLE / (len(a) + len(b) - shared) * CASE WHEN doc_id = rd THEN 1.2::DOUBLE ELSE 1.0::DOUBLE END
          * CASE WHEN doc_id = rd AND pp > p THEN 1.1::DOUBLE ELSE 1.0::DOUBLE END AS similarity_score FROM k JOIN l USING (rec_key) JOIN r USING (resp_key)),
    c AS (SELECT *, least(similarity_score, 1.0::DOUBLE) AS combined_score FROM s WHERE similarity_score >= 0.3::DOUBLE)
    SELECT rec_key, row_number() OVER w::INTEGER AS rank, resp_key, combined_score, similarity_score, same_document FROM c
    WINDOW w AS (PARTITION BY rec_key ORDER BY round(combined_score, 12) DESC, resp_key) QUALIFY row_number() OVER w <= 3"""


@query(TOP_THREE)
def align_legacy_top3(spark: SparkSession, sf: str) -> DataFrame:
    return align.top_three(recs(spark, sf), resps(spark, sf))


@query(f"""SELECT rec_key, coalesce(n, 0)::INTEGER AS answers, resp_key AS best, coalesce(combined_score, 0.0::DOUBLE) AS alignment_confidence,
    CASE WHEN resp_key IS NULL THEN 'No response found' WHEN same_document THEN 'Direct response' WHEN combined_score >= 0.5 THEN 'Possible response' ELSE 'Uncertain' END AS alignment_status
    FROM (SELECT rec_key FROM {RECS}) LEFT JOIN (SELECT *, count(*) OVER (PARTITION BY rec_key) AS n FROM ({TOP_THREE}) QUALIFY rank = 1) USING (rec_key)""")
def align_legacy_nested(spark: SparkSession, sf: str) -> DataFrame:
    own = recs(spark, sf)
    rows = align.nested(align.top_three(own, resps(spark, sf)), own)
    return rows.select("rec_key", F.coalesce(F.size("responses"), F.lit(0)).alias("answers"), F.get("responses", F.lit(0))["resp_key"].alias("best"), "alignment_confidence", "alignment_status")


@query(f"""WITH l AS (SELECT doc_id, rec_key, rec_id, TRY_CAST(rec_number AS INTEGER) AS n, list_distinct(regexp_extract_all(lower(text), '{text.WORD}')) AS a FROM {RECS}),
    r AS (SELECT doc_id, resp_key, rec_id AS pid, TRY_CAST(rec_number AS INTEGER) AS pn, list_distinct(regexp_extract_all(lower(text), '{text.WORD}')) AS b FROM {RESPS}),
    p AS (SELECT rec_key, resp_key, CASE WHEN rec_id = pid AND rec_id <> '' THEN 1 WHEN n = pn THEN 2 ELSE 3 END AS tier, len(list_intersect(a, b))::DOUBLE / greatest(1, len(list_distinct(list_concat(a, b)))) AS similarity FROM l JOIN r USING (doc_id)),
    m AS (SELECT * FROM p WHERE similarity > 0 QUALIFY row_number() OVER (PARTITION BY rec_key ORDER BY tier, similarity DESC, resp_key) = 1)
    SELECT rec_key, resp_key, similarity, CASE tier WHEN 1 THEN 'label_first' WHEN 2 THEN 'number_first' WHEN 3 THEN 'keyword' ELSE 'none' END AS match_method FROM (SELECT rec_key FROM l) LEFT JOIN m USING (rec_key)""")
def align_v2(spark: SparkSession, sf: str) -> DataFrame:
    return align.by_label(recs(spark, sf), resps(spark, sf))


@query(f"""WITH RECURSIVE l AS (SELECT doc_id, rec_key, rec_id, TRY_CAST(rec_number AS INTEGER) AS n, list_distinct(regexp_extract_all(lower(text), '{text.WORD}')) AS a, row_number() OVER (PARTITION BY doc_id ORDER BY rec_key) AS rn FROM {RECS}),
    r AS (SELECT doc_id, resp_key, rec_id AS pid, TRY_CAST(rec_number AS INTEGER) AS pn, list_distinct(regexp_extract_all(lower(text), '{text.WORD}')) AS b FROM {RESPS}),
    p AS (SELECT rec_key, resp_key, CASE WHEN rec_id = pid AND rec_id <> '' THEN 1 WHEN n = pn THEN 2 ELSE 3 END AS tier, len(list_intersect(a, b))::DOUBLE / greatest(1, len(list_distinct(list_concat(a, b)))) AS similarity FROM l JOIN r USING (doc_id)),
    c AS (SELECT rec_key, list({{'k': resp_key, 't': tier, 's': similarity}} ORDER BY tier, similarity DESC, resp_key) AS all_of FROM p WHERE similarity > 0 GROUP BY rec_key),
    o AS (SELECT l.doc_id, l.rec_key, l.rn, coalesce(all_of, []) AS all_of FROM l LEFT JOIN c USING (rec_key)),
    g AS (SELECT DISTINCT doc_id, 0::BIGINT AS i, []::BIGINT[] AS used, NULL::BIGINT AS rec_key, NULL::STRUCT(k BIGINT, t INTEGER, s DOUBLE) AS best FROM o
          UNION ALL SELECT doc_id, rn, CASE WHEN best IS NULL THEN used ELSE list_append(used, best.k) END, rec_key, best
          FROM (SELECT o.doc_id, o.rn, o.rec_key, g.used, list_filter(o.all_of, lambda x: NOT list_contains(g.used, x.k))[1] AS best FROM g JOIN o ON o.doc_id IS NOT DISTINCT FROM g.doc_id AND o.rn = g.i + 1))
    SELECT rec_key, best.k AS resp_key, best.s AS similarity, CASE best.t WHEN 1 THEN 'label_first' WHEN 2 THEN 'number_first' WHEN 3 THEN 'keyword' ELSE 'none' END AS match_method FROM g WHERE i > 0""")
def align_v2_one_to_one(spark: SparkSession, sf: str) -> DataFrame:
    return align.one_to_one(recs(spark, sf), resps(spark, sf))


DIRECTED = "CASE " + " ".join(f"WHEN regexp_matches(text, {q('(?i)' + p)}) THEN '{k}'" for p, k in L.DIRECTED) + " END"
RECOMMENDS = f"regexp_matches({strip('lower(text)')}, {q('^(?:' + '|'.join(L.RECOMMENDING) + ')')})"


def _tiers_sql() -> str:
    dot_of = "list_sum(list_transform(list_zip(p.va, p.vb), lambda x: x[1]::DOUBLE * x[2]::DOUBLE))"
    norm_of = lambda v: f"sqrt(list_sum(list_transform({v}, lambda x: x::DOUBLE * x::DOUBLE)))"
    return f"""WITH e AS (SELECT vec_id % (SELECT count(*) FROM embeddings) AS v, embedding FROM embeddings), n AS (SELECT count(*) AS n FROM embeddings),
        l AS (SELECT doc_id, rec_key, text AS lt, {normal(f"coalesce({REC_NUMBER}, rec_number)")} AS rn, regexp_replace({strip("lower(text)")}, '\\s+', ' ', 'g') AS ra, {DIRECTED} AS org, e.embedding AS va FROM {RECS}, n, e WHERE e.v = rec_key % n.n),
        b AS (SELECT doc_id, resp_key, {BODY} AS text, {normal("coalesce(rec_number, rec_id)")} AS pn, coalesce(source_org, org_name) AS porg, e.embedding AS vb FROM {RESPS}, n, e WHERE e.v = resp_key % n.n),
        r AS (SELECT *, regexp_replace({strip("lower(text)")}, '\\s+', ' ', 'g') AS rb, {holds("lower(text)", L.REPLY_PHRASES)} AS reply, {RECOMMENDS} AS recommends FROM b),
        p AS (SELECT * FROM l JOIN r USING (doc_id) WHERE NOT {SELF}),
        s AS (SELECT rec_key, resp_key, rn, pn, org, porg, reply, recommends, round({dot_of} / ({norm_of('p.va')} * {norm_of('p.vb')}), 12) AS sem FROM p),
        k AS (SELECT *, row_number() OVER (PARTITION BY rec_key ORDER BY sem DESC, resp_key DESC) AS place FROM s),
        t AS (SELECT *, CASE WHEN rn = pn AND sem >= 0.3 THEN 1 WHEN org = porg AND sem >= 0.55 THEN 2 WHEN place <= 6 AND sem >= 0.4 AND NOT recommends THEN 3 END AS tier FROM k),
        f AS (SELECT *, CASE tier WHEN 1 THEN least(sem + 0.5, 1.0) WHEN 2 THEN least(sem + 0.15, 0.95) ELSE sem * CASE WHEN reply THEN 1.0 ELSE 0.7 END END AS score FROM t WHERE tier IS NOT NULL),
        m AS (SELECT * FROM f QUALIFY row_number() OVER (PARTITION BY rec_key ORDER BY tier, round(score, 10) DESC, resp_key) = 1)
        SELECT rec_key, resp_key, round(score, 9)::DOUBLE AS similarity, CASE tier WHEN 1 THEN 'id_match' WHEN 2 THEN 'org_match' WHEN 3 THEN 'semantic' END AS match_method FROM (SELECT rec_key FROM l) LEFT JOIN m USING (rec_key)"""


@query(_tiers_sql())
def align_tiers(spark: SparkSession, sf: str) -> DataFrame:
    vectors = table(spark, sf, "embeddings")
    n = vectors.count()
    numbered = vectors.select((F.col("vec_id") % n).alias("v"), "embedding").dropDuplicates(["v"])
    with_vector = lambda df, key: df.withColumn("v", F.pmod(F.col(key), F.lit(n))).join(numbered, "v")
    left = with_vector(recs(spark, sf), "rec_key").withColumn("org", classify.directed_organisation(F.col("text")))
    right = with_vector(resps(spark, sf), "resp_key").withColumn("org", F.coalesce("source_org", "org_name"))
    return align.by_tiers(left, right).withColumn("similarity", F.round("similarity", 9))


@query("""SELECT e.resp_key, m.rec_id AS before FROM (SELECT DISTINCT ON (resp_key) doc_id, resp_key, position FROM responses WHERE text IS NOT NULL) e
    LEFT JOIN LATERAL (SELECT rec_id FROM (SELECT DISTINCT ON (rec_key) * FROM recommendations WHERE text IS NOT NULL) r WHERE r.doc_id = e.doc_id AND r.rec_id IS NOT NULL AND r.position < e.position ORDER BY r.position DESC, r.rec_id DESC LIMIT 1) m ON true""")
def preceding_id_asof(spark: SparkSession, sf: str) -> DataFrame:
    marks = recs(spark, sf).filter(F.col("rec_id").isNotNull()).groupBy("doc_id", "position").agg(F.max("rec_id").alias("before"))
    events = resps(spark, sf).select("doc_id", "resp_key", "position")
    return respond.preceding(events.filter("position is not null"), marks.filter("position is not null"), "doc_id", "position", "before").select("resp_key", "before")


@query("""SELECT resp_key FROM (SELECT DISTINCT ON (resp_key) doc_id, resp_key, span.start_at AS p FROM responses WHERE span.start_at IS NOT NULL) e
    WHERE NOT EXISTS (SELECT 1 FROM recommendations r WHERE r.doc_id = e.doc_id AND r.span.start_at <= e.p AND r.span.end_at > e.p)""")
def span_anti_join(spark: SparkSession, sf: str) -> DataFrame:
    points = table(spark, sf, "responses").filter("span.start_at is not null").dropDuplicates(["resp_key"]).select("doc_id", "resp_key", F.col("span.start_at").alias("p"))
    spans = table(spark, sf, "recommendations").filter("span.start_at is not null").select("doc_id", "span.start_at", "span.end_at")
    return respond.outside(points.filter("doc_id is not null"), spans, "doc_id", "p").select("resp_key")


@query(f"SELECT rec_key, len(list_intersect(a, b))::DOUBLE / greatest(1, len(list_distinct(list_concat(a, b)))) AS similarity FROM (SELECT rec_key, {CASED} AS a, {CASED.replace('(text,', '(verb_text,')} AS b FROM (SELECT rec_key, text, concat(coalesce(verb, ''), ' ', text) AS verb_text FROM {RECS}))")
def simple_similarities(spark: SparkSession, sf: str) -> DataFrame:
    return recs(spark, sf).select("rec_key", simple_similarity(F.col("text"), F.concat(F.coalesce("verb", F.lit("")), F.lit(" "), F.col("text"))).alias("similarity"))


@query(f"SELECT rec_key, len(list_intersect(a, b))::DOUBLE / greatest(1, len(list_distinct(list_concat(a, b)))) AS similarity FROM (SELECT rec_key, {CONTENT} AS a, ['training', 'programme', 'policy', 'board', 'review'] AS b FROM {RECS})")
def keyword_similarities(spark: SparkSession, sf: str) -> DataFrame:
    return recs(spark, sf).select("rec_key", jaccard(content_words(F.col("text")), text.array_of(["training", "programme", "policy", "board", "review"])).alias("similarity"))


DOT = "list_sum(list_transform(list_zip(a.embedding, b.embedding), lambda x: x[1]::DOUBLE * x[2]::DOUBLE))"
NORM = "sqrt(list_sum(list_transform({}.embedding, lambda x: x::DOUBLE * x::DOUBLE)))"
COSINE = f"{DOT} / ({NORM.format('a')} * {NORM.format('b')})"


@query(f"""SELECT query_id, vec_id, round(s, 9) AS similarity FROM (SELECT a.vec_id AS query_id, b.vec_id AS vec_id, {COSINE} AS s FROM embeddings a, embeddings b WHERE a.vec_id % 20 = 0)
    QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY round(s, 9) DESC, vec_id) <= 10""")
def cosine_topk(spark: SparkSession, sf: str) -> DataFrame:
    vectors = table(spark, sf, "embeddings")
    queries = vectors.filter("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), "embedding")
    return search.nearest(queries, vectors, 10).withColumn("similarity", F.round("similarity", 9))


@query(f"SELECT vec_id, round(max(s), 9) AS similarity FROM (SELECT b.vec_id AS vec_id, {COSINE} AS s FROM embeddings a, embeddings b WHERE a.vec_id IN (SELECT vec_id FROM embeddings ORDER BY vec_id LIMIT 3)) GROUP BY vec_id")
def max_over_variants(spark: SparkSession, sf: str) -> DataFrame:
    vectors = table(spark, sf, "embeddings")
    variants = [r.embedding for r in vectors.orderBy("vec_id").limit(3).collect()]
    return vectors.select("vec_id", F.round(engine.best_cosine(F.col("embedding"), variants), 9).alias("similarity"))


@query("""SELECT document_id, round(max(relevance_score) * 0.7 + avg(relevance_score) * 0.3, 9) AS overall_score, max(relevance_score) AS best_match_score, count(*) AS total_matches FROM
    (SELECT * FROM (SELECT DISTINCT result_id, document_id, relevance_score FROM search_results) WHERE NOT isnan(relevance_score)) GROUP BY document_id""")
def doc_rollup(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "search_results").select("result_id", "document_id", "relevance_score").distinct().filter(~F.isnan("relevance_score") & F.col("relevance_score").isNotNull())
    return search.roll_up(rows, "document_id", "relevance_score").withColumn("overall_score", F.round("overall_score", 9))


@query("SELECT vec_id, round(list_sum(list_transform(embedding, lambda x: x::DOUBLE * x::DOUBLE)), 6) AS square FROM embeddings")
def dot_products(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "embeddings").select("vec_id", F.round(dot(F.col("embedding"), F.col("embedding")), 6).alias("square"))


@query("SELECT result_id, round(CASE WHEN isnan(cross_encoder_score) OR cross_encoder_score IS NULL THEN relevance_score ELSE relevance_score * 0.6 + cross_encoder_score * 0.4 END, 9) AS score FROM (SELECT DISTINCT result_id, relevance_score, cross_encoder_score FROM search_results WHERE NOT isnan(relevance_score))")
def rerank(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "search_results").select("result_id", "relevance_score", "cross_encoder_score").distinct().filter(F.col("relevance_score").isNotNull() & ~F.isnan("relevance_score"))
    cross = F.when(~F.isnan("cross_encoder_score"), F.col("cross_encoder_score"))
    return rows.select("result_id", F.round(search.rerank(F.col("relevance_score"), cross), 9).alias("score"))


CONCEPT_STOPS = ", ".join(f"'{w}'" for w in L.CONCEPT_STOPS)


@query(f"""SELECT rec_key, array_to_string(list_sort(list_filter(list_intersect(list_distinct(string_split_regex({strip("lower(text)")}, '{SPACE}+')), ['the', 'board', 'should', 'review', 'training', 'policy', 'for', 'within', 'months']), lambda x: length(x) > 2 AND x NOT IN ({CONCEPT_STOPS})))[1:5], ',') AS concepts FROM {RECS}""")
def matched_concepts(spark: SparkSession, sf: str) -> DataFrame:
    return recs(spark, sf).select("rec_key", F.array_join(text.matched_concepts(F.lit("the board should review training policy for within months"), F.col("text")), ",").alias("concepts"))


@query("""SELECT name, unnest(list_concat(list_concat([name], CASE WHEN regexp_matches(name, '\\? *$') THEN [] ELSE ['What about ' || name || '?', 'Information about ' || name] END),
    CASE WHEN regexp_matches(lower(name), 'recommendation|response|policy|action') THEN ['government ' || name] ELSE [] END)) AS variant FROM (SELECT DISTINCT p_name AS name FROM part)""")
def query_expansion(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "part").select(F.col("p_name").alias("name")).distinct().select("name", F.explode(text.expand_query(F.col("name"))).alias("variant"))


@query("SELECT count(*) AS documents, sum(length(text))::BIGINT AS chars, sum(word_count)::BIGINT AS words, floor(sum(word_count) / count(*))::BIGINT AS mean_words FROM documents WHERE text IS NOT NULL")
def corpus_stats(spark: SparkSession, sf: str) -> DataFrame:
    return stats.corpus(documents(spark, sf))


@query("SELECT file_type, count(*) AS n, count(*) * 100.0::DOUBLE / sum(count(*)) OVER () AS percent FROM documents WHERE text IS NOT NULL GROUP BY file_type")
def filetype_share(spark: SparkSession, sf: str) -> DataFrame:
    return stats.shares(documents(spark, sf), "file_type")


@query(f"SELECT doc_id, regexp_replace(regexp_replace(text, '(?i)(\\bregister[0-9A-Za-z_]*)', '[\\1]', 'g'), '(?i)(\\bpolicy[0-9A-Za-z_]*)', '[\\1]', 'g') AS text FROM {DOCS}")
def highlight_brackets(spark: SparkSession, sf: str) -> DataFrame:
    return documents(spark, sf).filter(F.length("text") > 0).select("doc_id", highlight.prefixed(F.col("text"), ["register", "policy"]).alias("text"))


def _chunks_sql(target: int = 300, overlap: int = 50) -> str:
    two = "array_to_string(buf[-2:], ' ')"
    alone, full = f"(length(s) > {target} AND len(buf) = 0)", f"(n + length(s) > {target} AND len(buf) > 0)"
    kept = f"CASE WHEN len(buf) <= 1 THEN [] WHEN length({two}) <= {overlap} THEN buf[-2:] ELSE buf[-1:] END"
    kept_n = f"CASE WHEN len(buf) <= 1 THEN 0 WHEN length({two}) <= {overlap} THEN length({two}) ELSE length(buf[-1]) END"
    return f"""WITH RECURSIVE d AS (SELECT doc_id, text, list_transform(list_filter(list_transform(string_split(text, '.'), lambda x: {strip('x')}), lambda x: x <> ''), lambda x: x || '.') AS l FROM {DOCS}),
        g AS (SELECT doc_id, 0::BIGINT AS i, []::VARCHAR[] AS made, []::VARCHAR[] AS buf, 0::BIGINT AS n FROM d WHERE len(l) > 0
              UNION ALL SELECT doc_id, i + 1, CASE WHEN {alone} THEN list_append(made, s) WHEN {full} THEN list_append(made, array_to_string(buf, ' ')) ELSE made END,
                  CASE WHEN {alone} THEN buf WHEN {full} THEN list_append({kept}, s) ELSE list_append(buf, s) END, CASE WHEN {alone} THEN n WHEN {full} THEN {kept_n} + length(s) + 1 ELSE n + length(s) + 1 END
              FROM (SELECT g.*, d.l[i + 1] AS s FROM g JOIN d USING (doc_id) WHERE i < len(d.l))),
        f AS (SELECT g.doc_id, CASE WHEN len(buf) > 0 THEN list_append(made, array_to_string(buf, ' ')) ELSE made END AS c FROM g JOIN d USING (doc_id) WHERE i = len(d.l) UNION ALL SELECT doc_id, [text] FROM d WHERE len(l) = 0)
        SELECT doc_id, unnest(range(len(c)))::INTEGER AS chunk_idx, unnest(c) AS chunk FROM f"""


CHUNKS = _chunks_sql()
CHUNK_CONTEXT = f"SELECT doc_id, chunk_idx, chunk, array_to_string(list(chunk) OVER (PARTITION BY doc_id ORDER BY chunk_idx ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING), ' ... ') AS context FROM ({CHUNKS})"


@query(CHUNKS)
def chunks(spark: SparkSession, sf: str) -> DataFrame:
    return segment.chunks(documents(spark, sf))


@query(CHUNK_CONTEXT)
def chunk_context(spark: SparkSession, sf: str) -> DataFrame:
    return segment.chunk_context(segment.chunks(documents(spark, sf)))


@query(f"""SELECT rec_key, CASE WHEN length(text) <= 200 THEN text WHEN contains(substr(text, 1, 200), '.') AND 200 - instr(reverse(substr(text, 1, 200)), '.') > 140 THEN substr(text, 1, 200 - instr(reverse(substr(text, 1, 200)), '.') + 1)
    ELSE substr(text, 1, 200 - instr(reverse(substr(text, 1, 200)), ' ')) || '...' END AS snippet FROM {RECS}""")
def snippets(spark: SparkSession, sf: str) -> DataFrame:
    return recs(spark, sf).select("rec_key", text.snippet(F.col("text")).alias("snippet"))


@query("""SELECT c_custkey, 'Name: ' || c_name || ' | Segment: ' || c_mktsegment || ' | Column 3: ' || c_nationkey AS text FROM customer""")
def table_text(spark: SparkSession, sf: str) -> DataFrame:
    head = F.array(F.lit("Name"), F.lit(" Segment "), F.lit(None).cast("string"))
    return table(spark, sf, "customer").select("c_custkey", tables.as_text(F.array(head, F.array("c_name", "c_mktsegment", F.col("c_nationkey").cast("string")))).alias("text"))


@query("""SELECT c_custkey, 'Recommendation 1: ' || c_name || ' Action: call [Owner: ' || c_mktsegment || '] [Timescale: ' || c_nationkey || ']' || ' Action: write' AS text FROM customer""")
def table_recommendations(spark: SparkSession, sf: str) -> DataFrame:
    head = F.array(F.lit("Recommendation"), F.lit("Action"), F.lit("Owner"), F.lit("Timescale"))
    first = F.array(F.col("c_name"), F.lit("a call"), F.col("c_mktsegment"), F.col("c_nationkey").cast("string"))
    second = F.array(F.lit(""), F.lit("write"), F.lit(None).cast("string"), F.lit(""))
    return table(spark, sf, "customer").select("c_custkey", tables.as_text(F.array(head, first, second)).alias("text"))


@query("SELECT rec_key, status, CASE WHEN confidence > 0.95 THEN 'high' WHEN confidence > 0.85 THEN 'medium' ELSE 'low' END AS band FROM (SELECT DISTINCT ON (rec_key) rec_key, confidence, CASE WHEN text IS NULL THEN 'none' ELSE 'text' END AS status FROM recommendations WHERE text IS NOT NULL AND confidence IS NOT NULL)")
def confidence_bands(spark: SparkSession, sf: str) -> DataFrame:
    return recs(spark, sf).filter(F.col("confidence").isNotNull()).select("rec_key", F.lit("text").alias("status"), classify.band(F.col("confidence"), (0.95, "high"), (0.85, "medium"), rest="low").alias("band"))


@query(f"SELECT doc_id, ordinal, sentence FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY ordinal) AS r, count(*) OVER (PARTITION BY doc_id) AS n FROM {parts(21, False)}) WHERE r <= 50 OR r > n - 50")
def first_and_last(spark: SparkSession, sf: str) -> DataFrame:
    return search.ends_of(segment.plain_sentences(documents(spark, sf), 21), 50, "ordinal").select("doc_id", "ordinal", "sentence")


@query(f"SELECT doc_id, count(*) AS matches, max(score) AS best FROM ({SMART}) GROUP BY doc_id")
def matches_by_document(spark: SparkSession, sf: str) -> DataFrame:
    return stats.by_document(search.smart(documents(spark, sf), QUERY), "score")
