"""Recommendations in texts: numbered ones by their headings, others by their sentences."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from docquarry.functions import lexicon as L
from docquarry.functions.classify import action_verb, garbage, is_meta, opening_method, recommendation_likeness, recommendation_rule, scattered_recommendation, section_boundary
from docquarry.functions.similarity import jaccard
from docquarry.functions.text import clean_brief, clean_strict, finditer, first_match, let, part, prefix_sums, squeeze, strip, tokens
from docquarry.operators.segment import full_sentences
from docquarry.session import cut, staged

LONGEST, SHORTEST = 2_500, 50  # characters of a numbered recommendation
PHASES = [
    r"(?i)Safety\s+recommendation\s+(R/\d{4}/\d{3})[:\s]",
    r"(?i)Recommendation\s+(\d{4}/\d{3})[:\s]",
    r"(?i)(?:Recommendations?\s+)?Recommendation\s+(\d{1,2})(?:\s+(\d))?(?::|(?=\s+[A-Z]))\s*",
]


def _starts_section(tail: Column) -> Column:
    """Whether a section begins with ``tail``, the next characters of a text on one line."""
    left = F.ltrim(tail)
    # Openings of the narrative that follows recommendations.
    narrative = (
        r"HSSIB proposes|While national guidance|Current research only|The investigation|During the investigation|In the following sections|This section considers|This section explores|"
        r"Staff told the investigation|Subject matter advisors|Mental health practitioners told|New builds and|Infrastructure\s*[-–]"
    )
    line = F.trim(tail)
    words = tokens(line)
    sentence = F.exists(words, lambda w: F.lower(w).rlike(r"^(?:is|are|was|were|have|has|had|will|would|could|should|may|might|because|although|however|therefore)$"))
    capital = F.size(F.filter(words, lambda w: w.rlike(r"^\p{Lu}") | F.lower(w).isin("and", "the", "of", "for", "to", "in", "a", "an")))
    title = (F.length(line).between(5, 80)) & ~line.endswith(".") & ~line.rlike(r"^(?:The|A|An|This|That|It|We|They) ") & line.rlike(r"^\p{Lu}") & (F.size(words) >= 2)
    title = title & (((F.size(words) <= 8) & ~sentence) | (capital >= F.size(words) * 0.7))
    return left.rlike(rf"^(?:\d+\.\d+\.\d+\s|\d+\.\d+\s+[A-Z]|{narrative})") | tail.rlike(r"^\s*\d+\.\d+(?:\.\d+)?\s+[A-Z]|^\s*\d+\.?\d*\.?\s+[A-Z][a-z]+") | title


def with_end(rows: DataFrame) -> DataFrame:
    """``rows`` of ``text``, ``start`` and ``following`` with ``end``, where the numbered recommendation at ``start`` ends.

    That is at the next one, a section's mark or heading, a section's begin, or its greatest length, whichever comes first;
    columns that several later ones need are made in steps of their own.
    """
    after = F.col("start") + SHORTEST
    inline = first_match(part(F.col("text"), after, F.col("following")), "(?i)" + L.INLINE_HEADING)
    rows = staged(rows, limit=F.coalesce(after + inline, F.col("following")))
    rows = staged(rows, tail=part(F.col("text"), after, F.col("limit")))
    stop = first_match(F.col("tail"), "(?i)(?:" + "|".join(L.HARD_STOPS) + ")")
    mark = first_match(F.col("tail"), "(?i)(?:" + "|".join(L.SECTION_MARKS) + ")")
    head = first_match(F.col("tail"), rf"(?i)(?:^|[.!?]\s+)(?:{'|'.join(L.HEADINGS)})")
    rows = staged(rows, head=head)
    skipped = F.length(F.regexp_extract(F.substring("tail", F.col("head") + 1, F.lit(50)), r"^[^\p{L}]*", 0))
    rows = staged(rows, earliest=F.least(F.col("limit"), after + stop, after + mark, after + F.col("head") + skipped))
    upto = F.least(F.col("earliest"), after + 3000)
    probes = F.when(upto > after, F.sequence(after, upto - 1, F.lit(100))).otherwise(F.array().cast("array<int>"))
    looks = F.transform(probes, lambda p: F.struct(p.alias("at"), F.substring("text", p + 1, F.lit(300)).alias("tail")))
    section = F.get(F.filter(looks, lambda x: _starts_section(x["tail"])), F.lit(0))["at"]
    rows = staged(rows, earliest=F.least("earliest", section)).withColumn("block", F.substring("text", F.col("start") + 1, F.lit(LONGEST)))
    stops = F.length("block") - F.locate(" .", F.reverse("block")) - 1
    capped = F.when((F.locate(" .", F.reverse("block")) > 0) & (stops > SHORTEST), F.col("start") + stops + 1).otherwise(F.col("start") + LONGEST)
    end = F.when(F.col("earliest") > F.col("start") + LONGEST, capped).otherwise(F.col("earliest"))
    return rows.withColumn("end", end).drop("limit", "tail", "head", "earliest", "block")


def _judged(rows: DataFrame, least: float, numbered: bool) -> DataFrame:
    """The rows whose ``body`` is a recommendation, with ``verb``, ``method`` and ``confidence``; each step's costly columns are made once."""
    rows = staged(rows, again=clean_strict(F.col("body")))
    rows = rows.filter(garbage(F.col("again"), numbered).isNull())
    rows = staged(rows, rule=recommendation_rule(F.col("again"), numbered)).filter(F.col("rule.confidence") >= least)
    verb = F.coalesce("rule.verb", action_verb(F.col("rule.rest")))
    return rows.withColumn("verb", verb).withColumn("method", F.col("rule.method")).withColumn("confidence", F.round("rule.confidence", 3)).drop("rule", "again")


def numbered(docs: DataFrame, least: float = 0.75) -> DataFrame:
    """Recommendations under headings, the first kind of heading that gives any: ``doc_id``, ``phase`` and the recommendation's columns."""
    cleaned = staged(docs.filter(strip(F.col("text")) != "").select("doc_id", "text"), text=clean_strict(F.col("text")))
    out = None
    for k, pattern in enumerate(PHASES):
        heads = cleaned.filter(F.col("text").rlike(pattern)).select("doc_id", "text", finditer(F.col("text"), pattern, 2 if k == 2 else 1).alias("h"))
        rows = heads.select("doc_id", "text", F.posexplode("h").alias("position", "m"), F.col("h").alias("all"))
        following = F.coalesce(F.get("all", F.col("position") + 1)["at"], F.length("text"))
        number = F.col("m.g1")
        if k == 2:
            number = F.when((F.col("m.g2") != "") & (F.length("m.g1") == 1), F.concat("m.g1", "m.g2")).otherwise(F.col("m.g1"))
        rows = rows.select("doc_id", "position", number.alias("rec_number"), "text", F.col("m.at").alias("start"), following.alias("following"))
        rows = with_end(rows)
        rows = staged(rows, body=clean_strict(part(F.col("text"), F.col("start"), F.col("end")))).drop("text")
        rows = _judged(rows, least, True)
        if k == 2:
            plain = F.regexp_replace("body", r"(?i)^(?:Recommendations?\s+)?Recommendation\s+(\d{1,2})(?:\s+(\d))?:?\s*", "")
            rows = rows.withColumn("body", F.when(F.col("body").rlike(r"(?i)^(?:Recommendations?\s+)?Recommendation\s+\d{1,2}"), F.concat(F.lit("Recommendation "), "rec_number", F.lit(" "), plain)).otherwise(F.col("body")))
        rows = rows.select("doc_id", F.lit(k).alias("phase"), F.col("body").alias("text"), "verb", "method", "confidence", "position", F.lit(True).alias("in_section"), "rec_number")
        out = rows if out is None else out.unionByName(rows)
    return out


def from_sentences(docs: DataFrame, least: float = 0.75) -> DataFrame:
    """Recommendations among the sentences, with the same columns as ``numbered``."""
    rows = full_sentences(docs).filter(F.length("sentence") >= SHORTEST)
    rows = staged(rows, body=clean_strict(F.col("sentence")))
    rows = _judged(rows.filter(~is_meta(F.col("body"))), least, False)
    return rows.select("doc_id", F.lit(3).alias("phase"), F.col("body").alias("text"), "verb", "method", "confidence", F.col("ordinal").alias("position"), F.lit(False).alias("in_section"), F.lit(None).cast("string").alias("rec_number"))


def distinct_numbers(rows: DataFrame) -> DataFrame:
    """Of each number in a document the longest text, the first of equal ones."""
    w = Window.partitionBy("doc_id", "rec_number").orderBy(F.desc(F.length("text")), "position")
    return rows.withColumn("r", F.row_number().over(w)).filter("r = 1").drop("r")


def distinct_openings(rows: DataFrame, size: int = 150) -> DataFrame:
    """Of texts with equal first characters in a document the first."""
    w = Window.partitionBy("doc_id", F.substring(squeeze(F.lower("text")), 1, size)).orderBy("position")
    return rows.withColumn("r", F.row_number().over(w)).filter("r = 1").drop("r")


def extract(docs: DataFrame, least: float = 0.75) -> DataFrame:
    """All recommendations of each document by the first way that finds any there."""
    found = distinct_numbers(numbered(docs, least)).unionByName(distinct_openings(from_sentences(docs, least)))
    first = F.min("phase").over(Window.partitionBy("doc_id"))
    return found.withColumn("first", first).filter("phase = first").drop("first")


def number_order(c: str = "rec_number") -> list[Column]:
    """Plain numbers first, then those with a year, then others; each by value."""
    year, serial = F.regexp_extract(c, r"^(?:R/)?(\d+)/(\d+)$", 1), F.regexp_extract(c, r"^(?:R/)?(\d+)/(\d+)$", 2)
    kind = F.when(F.col(c).rlike(r"^\d+$"), 0).when(year != "", 1).otherwise(2)
    return [kind, F.coalesce(F.col(c).try_cast("int"), year.try_cast("int"), F.lit(0)), F.coalesce(serial.try_cast("int"), F.lit(0))]


def headed(docs: DataFrame) -> DataFrame:
    """Recommendations of preprocessed texts: blocks from a heading at a line's start to the next; ``doc_id``, ``text``, ``start_at``, ``end_at``, ``rec_id``, ``rec_number``."""
    pattern = r"(?i)(?:(?<=\n)|^)(?:Recommendations?\s+)?Recommendation\b"
    heads = docs.filter(strip(F.col("text")) != "").select("doc_id", F.col("text").alias("whole"), finditer(F.col("text"), pattern).alias("h"))
    rows = heads.select("doc_id", "whole", F.posexplode("h").alias("i", "m"), F.col("h").alias("all"))
    end = F.coalesce(F.get("all", F.col("i") + 1)["at"], F.length("whole"))
    rows = rows.select("doc_id", "whole", F.col("m.at").alias("start_at"), F.col("m.upto").alias("upto"), end.alias("end_at"))
    after = F.ltrim(F.regexp_replace(part(F.col("whole"), F.col("upto"), F.col("upto") + 200), r"^\s+", ""))
    label = F.nullif(F.regexp_extract(after, r"^([^\s:]+):", 1), F.lit(""))
    spaced = F.when(after.rlike(r"^\d{1,2}\s+\d\b"), F.concat(F.regexp_extract(after, r"^(\d{1,2})\s+(\d)\b", 1), F.regexp_extract(after, r"^(\d{1,2})\s+(\d)\b", 2)))
    plain = F.nullif(F.regexp_extract(after, r"^(\d{1,3})\b", 1), F.lit(""))
    rows = rows.withColumn("rec_id", F.coalesce(label, spaced, plain))
    body = F.regexp_replace(part(F.col("whole"), F.col("start_at"), F.col("end_at")), r"(?i)\bRecommendations\s+Recommendation\s+(\d+)\b", "Recommendation $1")
    body = F.regexp_replace(body, r"(?i)\bRecommendation\s+1\s+1\b", "Recommendation 11")
    return rows.select("doc_id", strip(body).alias("text"), "start_at", "end_at", "rec_id", F.when(F.col("rec_id").rlike(r"^\d+$"), F.col("rec_id").try_cast("int")).alias("rec_number"))


def scattered(docs: DataFrame) -> DataFrame:
    """Sentences of 40 to 500 characters that recommend, by the given ``sentence_spans``, with the columns of ``headed``."""
    each = docs.filter(F.size("sentence_spans") > 0).select("doc_id", "text", F.explode("sentence_spans").alias("s"))
    rows = each.select("doc_id", strip(part(F.col("text"), F.col("s.start_at"), F.col("s.end_at"))).alias("text"), "s.start_at", "s.end_at")
    rows = rows.filter(F.length("text").between(40, 500) & scattered_recommendation(F.col("text")))
    return rows.select("doc_id", "text", "start_at", "end_at", F.lit(None).cast("string").alias("rec_id"), F.lit(None).cast("int").alias("rec_number"))


def extract_preprocessed(docs: DataFrame) -> DataFrame:
    """The headed recommendations, and in documents without any the scattered ones."""
    found = headed(docs)
    return found.unionByName(scattered(docs).join(found.select("doc_id").distinct(), "doc_id", "left_anti"))


def likely_sentences(docs: DataFrame, least: float = 0.6) -> DataFrame:
    """Sentences that the keyword estimate takes for recommendations: ``doc_id``, ``ordinal``, ``sentence`` and ``confidence``."""
    rows = full_sentences(docs).withColumn("e", recommendation_likeness(F.col("sentence")))
    return rows.filter(F.col("e.is_recommendation") & (F.col("e.confidence") >= least)).select("doc_id", "ordinal", "sentence", "e.confidence")


def distinct_alike(rows: DataFrame, least: float = 0.85) -> DataFrame:
    """Rows of each document but those whose words are like an earlier row's beyond ``least``.

    Two rows so alike share one of the first n - ceil(least n) + 1 words of each in the order of rarity, by which they meet;
    a document's rows are not all paired.
    """
    words = rows.withColumn("w", F.array_distinct(tokens(F.lower("text"))))
    keyed = words.filter(F.size("w") > 0).select("doc_id", "position", "w", F.size("w").alias("n"))
    each = keyed.select("doc_id", "position", "n", F.explode("w").alias("word"))
    often = each.groupBy("word").agg(F.count(F.lit(1)).alias("often"))
    order = Window.partitionBy("doc_id", "position").orderBy("often", "word")
    rare = each.join(often, "word").withColumn("k", F.row_number().over(order)).filter(F.col("k") <= F.col("n") - F.ceil(F.col("n") * least) + 1)
    left = rare.select("doc_id", "word", "position", "n")
    right = rare.select("doc_id", "word", F.col("position").alias("earlier"), F.col("n").alias("m"))
    met = left.join(right, ["doc_id", "word"]).filter((F.col("earlier") < F.col("position")) & (F.col("m") >= F.col("n") * least) & (F.col("n") >= F.col("m") * least))
    met = met.select("doc_id", "position", "earlier").distinct().join(keyed.select("doc_id", "position", "w"), ["doc_id", "position"])
    met = met.join(keyed.select("doc_id", F.col("position").alias("earlier"), F.col("w").alias("v")), ["doc_id", "earlier"])
    again = met.filter(jaccard(F.col("w"), F.col("v")) > least).select("doc_id", "position").distinct()
    return rows.join(again, ["doc_id", "position"], "left_anti")


def wording_start(text: Column) -> Column:
    """Where a recommendation's own wording begins: at "That" with an organisation, at an organisation that should act, else after its header."""
    header = F.length(F.regexp_extract(text, L.WORDING_HEADER, 0))
    return F.coalesce(*(first_match(text, p) for p in L.WORDING_STARTS), header, F.lit(0))


def wording_end(text: Column, start: Column) -> Column:
    """Where it ends: before the first sentence that is a heading or, past the first one, does not recommend; else with the text."""
    said = F.transform(F.split(part(text, start, F.length(text)), r"(?<=[.!?])\s+", -1), strip)

    def stop(own: Column) -> Column:
        before = prefix_sums(F.transform(own, lambda s: F.length(s) + 1))
        judged = F.zip_with(own, before, lambda s, at: F.struct(s.alias("s"), at.alias("at"), recommendation_likeness(s).alias("e")))
        ends = F.filter(judged, lambda x, i: (x["s"] != "") & (section_boundary(x["s"]) | ((i > 0) & ~x["e"]["is_recommendation"] & (x["e"]["confidence"] < 0.4))))
        return F.when(F.size(own) > 1, F.get(ends, F.lit(0))["at"])

    return F.coalesce(start + let(said, stop), F.length(text))


def with_wording(rows: DataFrame, longest: int = 1_500) -> DataFrame:
    """``rows`` of ``block`` and ``rec_number`` with ``body``: a recommendation's wording within the block under its heading.

    It has at most ``longest`` characters, and its header is put back where it was cut off; costly columns are made in steps
    of their own.
    """
    rows = staged(rows, text=clean_brief(F.col("block")))
    rows = staged(rows, a=wording_start(F.col("text")))
    rows = staged(rows, b=wording_end(F.col("text"), F.col("a")))
    head = F.substring("text", F.col("a") + 1, F.lit(longest))
    stop = F.length(head) - F.locate(".", F.reverse(head))
    late = (F.locate(".", head) > 0) & (stop > longest * 0.5)
    end = F.when(F.col("b") - F.col("a") <= longest, F.col("b")).when(late, F.col("a") + stop + 1).otherwise(F.col("a") + longest)
    rows = staged(rows, body=strip(part(F.col("text"), F.col("a"), end)))
    header = F.when(F.col("rec_number").startswith("R/"), "Safety recommendation ").when(F.col("rec_number").contains("/"), "Recommendation ")
    headless = ~F.lower("body").rlike("^(?:recommendation|safety recommendation|that )") & header.isNotNull()
    return staged(rows, body=F.when(headless, F.concat(header, "rec_number", F.lit(": "), "body")).otherwise(F.col("body"))).drop("block", "text", "a", "b")


def extract_by_likeness(docs: DataFrame, least: float = 0.75) -> DataFrame:
    """Recommendations judged by the keyword estimate: under the first kind of heading that gives any in a document, else among its sentences.

    The columns are those of ``numbered``; of alike texts of a document the first stays.
    """
    # The kinds of headings, in this order.
    phases = [*PHASES[:2], r"(?i)(?:Recommendations?\s+)?Recommendation\s+(\d{1,2})(?:\s+(\d))?\b"]
    cleaned = staged(docs.filter(strip(F.col("text")) != "").select("doc_id", F.col("text").alias("raw")), text=clean_brief(F.col("raw")))
    out = None
    for k, pattern in enumerate(phases):
        heads = cleaned.filter(F.col("text").rlike(pattern)).select("doc_id", "text", finditer(F.col("text"), pattern, 2 if k == 2 else 1).alias("h"))
        rows = heads.select("doc_id", "text", F.posexplode("h").alias("position", "m"), F.col("h").alias("all"))
        following = F.coalesce(F.get("all", F.col("position") + 1)["at"], F.length("text"))
        number = F.col("m.g1") if k < 2 else F.when((F.col("m.g2") != "") & (F.length("m.g1") == 1), F.concat("m.g1", "m.g2")).otherwise(F.col("m.g1"))
        rows = rows.select("doc_id", "position", number.alias("rec_number"), part(F.col("text"), F.col("m.at"), following).alias("block"))
        rows = with_wording(rows).withColumn("phase", F.lit(k)).withColumn("in_section", F.lit(True))
        out = rows if out is None else out.unionByName(rows)
    said = full_sentences(docs.filter(strip(F.col("text")) != ""))
    plain = staged(said, body=clean_brief(F.col("sentence"))).select("doc_id", F.col("ordinal").alias("position"), F.lit(None).cast("string").alias("rec_number"), "body", F.lit(3).alias("phase"), F.lit(False).alias("in_section"))
    rows = out.unionByName(plain.filter(F.length("body") <= 500))
    special = F.length(F.regexp_replace("body", r"[\p{L}\p{N}\s.,;:!?'\"()\[\]-]", ""))
    rows = rows.filter((F.length("body") >= SHORTEST) & (special / F.length("body") <= 0.12))
    rows = staged(rows, e=recommendation_likeness(F.col("body"))).filter("e.is_recommendation").withColumn("method", opening_method(F.col("body")))
    sure = F.when(F.col("method").rlike("hsib|numbered"), 0.95).when(F.col("method").isin("entity_should", "we_recommend", "that_entity"), 0.9).otherwise(0.0)
    rows = rows.withColumn("confidence", F.round(F.greatest(F.col("e.confidence"), sure), 3)).filter(F.col("confidence") >= least)
    first = F.min("phase").over(Window.partitionBy("doc_id"))
    rows = rows.withColumn("first", first).filter("phase = first").select("doc_id", "phase", F.col("body").alias("text"), "method", "confidence", "position", "in_section", "rec_number")
    rows = rows.withColumn("verb", action_verb(F.col("text"), after_should_only=True))
    return distinct_alike(cut(rows))  # which reads the rows several times


def inspected(docs: DataFrame, least: float = 0.75) -> DataFrame:
    """``doc_id``, ``phase``, ``position``, ``heading`` and ``verdict`` of every heading: kept, or why its text is no recommendation."""
    cleaned = staged(docs.filter(strip(F.col("text")) != "").select("doc_id", "text"), text=clean_strict(F.col("text")))
    out = None
    for k, pattern in enumerate(PHASES):
        heads = cleaned.filter(F.col("text").rlike(pattern)).select("doc_id", "text", finditer(F.col("text"), pattern).alias("h"))
        rows = heads.select("doc_id", "text", F.posexplode("h").alias("position", "m"), F.col("h").alias("all"))
        following = F.coalesce(F.get("all", F.col("position") + 1)["at"], F.length("text"))
        rows = with_end(rows.select("doc_id", "position", "text", F.col("m.match").alias("heading"), F.col("m.at").alias("start"), following.alias("following")))
        rows = staged(rows, body=clean_strict(part(F.col("text"), F.col("start"), F.col("end")))).withColumn("phase", F.lit(k))
        out = rows if out is None else out.unionByName(rows)
    out = staged(out, rule=recommendation_rule(F.col("body"), True))
    verdict = F.coalesce(garbage(F.col("body"), True), F.when(F.col("rule").isNull(), "no_rule"), F.when(F.col("rule.confidence") < least, "low_confidence"), F.lit("kept"))
    return out.select("doc_id", "phase", "position", "heading", verdict.alias("verdict"))


def statistics(rows: DataFrame) -> DataFrame:
    """One row of counts: total, distinct verbs, mean confidence, how many in sections, high and medium; methods and top verbs as maps."""
    high = F.col("confidence") >= 0.9
    total = rows.agg(
        F.count(F.lit(1)).alias("total"), F.countDistinct("verb").alias("unique_verbs"), F.round(F.avg("confidence"), 3).alias("mean_confidence"),
        F.count_if(F.col("in_section")).alias("in_section"), F.count_if(high).alias("high"), F.count_if((F.col("confidence") >= 0.75) & ~high).alias("medium"),
    )
    rows = rows.select(F.coalesce("method", F.lit("unknown")).alias("method"), F.coalesce("verb", F.lit("unknown")).alias("verb"))
    methods = rows.groupBy("method").agg(F.count(F.lit(1)).alias("n")).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("method", "n")))).alias("methods"))
    verbs = rows.groupBy("verb").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "verb").limit(10)
    ordered = F.transform(F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("o"), "verb"))), lambda x: F.struct(x["verb"], -x["o"]))
    return total.join(methods).join(verbs.agg(F.map_from_entries(ordered).alias("top_verbs")))
