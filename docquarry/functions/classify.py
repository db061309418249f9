"""Labels by ordered rules: Column in, Column out."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from docquarry.functions import lexicon as L
from docquarry.functions.text import any_contains, let, line_endings, strip, tokens


def _rule(patterns: list[str]) -> str:
    return "|".join(f"(?:{p})" for p in patterns)


def response_status(text: Column, strict_negation: bool = False) -> Column:
    """``status`` and ``confidence`` of a response by the first rule that it meets.

    ``strict_negation`` takes "do not accept this recommendation" as a rejection too; without it such a text counts as accepted.
    """
    low = F.lower(text)
    pair = lambda status, conf: F.struct(F.lit(status).alias("status"), F.lit(conf).alias("confidence"))
    out = None
    for k, (status, conf, patterns) in enumerate(L.STATUS_RULES):
        if k == 0 and strict_negation:
            patterns = [*patterns, r"\bdo\s+not\s+(?:accept|support|agree\s+with)\s+(?:this\s+|the\s+)?recommendation", r"\bdoes\s+not\s+support\s+(?:this\s+|the\s+)?recommendation"]
        met = low.rlike(_rule(patterns))
        out = F.when(met, pair(status, conf)) if out is None else out.when(met, pair(status, conf))
        if k == 1:
            out = out.when(low.rlike(_rule(L.REFUSED_MEANS)) & low.rlike(L.SOFTENED), pair("Partial", 0.8))
    return out.otherwise(pair("Unclear", 0.5))


def theme(sentence: Column) -> Column:
    low, out = F.lower(sentence), None
    for name, words in L.THEMES:
        met = any_contains(low, words)
        out = F.when(met, name) if out is None else out.when(met, name)
    return out.otherwise("General")


def document_type(text: Column, filename: Column) -> Column:
    low, name = F.lower(text), F.lower(filename)
    out = F.when(F.coalesce(text, F.lit("")) == "", "unknown")
    for kind, pattern in L.DOCUMENT_TYPES:
        out = out.when(low.rlike(pattern), kind)
    return out.when(any_contains(name, ["report", "analysis"]), "report").when(any_contains(name, ["inquiry", "investigation"]), "inquiry").otherwise("general")


def engine_document_type(text: Column, filename: Column) -> Column:
    low, name = F.lower(text), F.lower(filename)
    out = F.when(low.contains("recommendation") | name.contains("recommend"), "recommendation")
    for kind in ("response", "policy"):
        out = out.when(low.contains(kind) | name.contains(kind), kind)
    return out.otherwise("document")


def organisation(text: Column) -> Column:
    """The key of the first known organisation in a text, or null."""
    low, out = F.lower(text), None
    for key, phrases in L.ORGANISATIONS:
        met = any_contains(low, phrases)
        out = F.when(met, key) if out is None else out.when(met, key)
    return out


def directed_organisation(text: Column) -> Column:
    """The key of the organisation that a recommendation directs to act, or null."""
    out = None
    for pattern, key in L.DIRECTED:
        met = text.rlike("(?i)" + pattern)
        out = F.when(met, key) if out is None else out.when(met, key)
    return out


def responding_organisation(text: Column) -> Column:
    """Who wrote a response document, by its first 2,000 characters, or null."""
    low = F.lower(F.substring(text, 1, 2000))
    out = F.when(any_contains(low, ["tewv response", "tees, esk and wear"]), "tewv")
    return out.when(low.contains("hsib recommends that nhs england"), "multi_org_hsib").when(low.contains("government response"), "government")


def is_recommendation_text(text: Column) -> Column:
    return strip(F.lower(text)).rlike("^(?:" + "|".join(L.RECOMMENDING) + ")")


def is_genuine_response(text: Column) -> Column:
    return strip(F.lower(text)).rlike("^(?:" + "|".join(L.RESPONDING) + ")")


def is_meta(text: Column) -> Column:
    return F.lower(text).rlike(_rule(L.META))


def excluded_numbers(text: Column) -> Column:
    """The numbers of recommendations that a document says it does not answer, ascending."""
    numbers = r"(?i)recommendations?\s+([\d,\s]+(?:and\s+\d+)?)\s+"
    ends = [r"relate\s+to\s+other\s+organi[sz]ations", r"(?:are|is)\s+(?:therefore\s+)?not\s+included", r"(?:are\s+)?for\s+other\s+organi[sz]ations"]
    text = line_endings(text)
    found = F.concat(*(F.regexp_extract_all(F.regexp_extract(text, numbers + e, 1), F.lit(r"\d+"), F.lit(0)) for e in ends))
    return F.array_sort(F.array_distinct(F.transform(found, lambda x: x.cast("int"))))


def layout(text: Column) -> Column:
    """Which of the five layouts of response documents a text has: the first that it meets."""
    t = line_endings(F.coalesce(text, F.lit("")))
    ids = t.rlike(r"R/\d{4}/\d{3}")
    trust = t.rlike(r"(?i)(?:TEWV|Trust)\s+response[:\s]") & t.rlike(r"(?i)Recommendation\s+\d+")
    org_line = t.rlike(r"(?im)(?:^|\n)(?:The\s+Shelford\s+Group|NHS\s+England|Department\s+of\s+Health\s+and\s+Social\s+Care|DHSC|Care\s+Quality\s+Commission|NICE)\s*\n")
    structured = t.rlike(r"(?i)HSSIB\s+recommends") & ids & t.rlike(r"(?m)(?:^|\n)Response\n") & org_line & t.rlike(r"(?i)Actions\s+planned\s+to\s+deliver|Response\s+received\s+on")
    header = t.rlike(r"(?i)\bResponse\b\s*(?:NHS\s+England|Care\s+Quality\s+Commission|The\s+National|We\s+(?:are|have|welcome)|NICE\s+is)") | t.rlike(r"(?m)(?:^|\n)\s*Response\s*(?:\n|$)")
    on_line = t.rlike(r"(?im)(?:^|\n)\s*(?:NHS\s+England|Care\s+Quality\s+Commission|National\s+Institute|Royal\s+College|NICE|DHSC|The\s+Shelford\s+Group)\s*(?:\n|$)")
    after = t.rlike(r"(?i)(?:process|planning|guidance|services|management)[.\s]+(?:Response\s+)?(?:NHS\s+England|Care\s+Quality\s+Commission|National\s+Institute|Royal\s+College)")
    several = F.size(F.array_distinct(F.regexp_extract_all(F.lower(t), F.lit("(?i)" + L.ORG_NAMES), F.lit(1)))) >= 2
    by_org = t.rlike(r"(?i)HSIB\s+recommends") & header & (on_line | after | several) & ~ids
    standard = t.rlike(r"[Rr]ecommendation\s*[R/]?\s*\d{4}\s*/\s*\d{3}") | (t.rlike(r"(?i)\bH[SS]I?B\b") & t.rlike(r"(?i)\bResponse\b"))
    return F.when(trust, "trust").when(structured, "hssib_org").when(by_org, "hsib_org").when(standard, "hsib").otherwise("government")


def garbage(c: Column, numbered: bool = False) -> Column:
    """Why a cleaned candidate is no recommendation at all, or null."""
    n = F.length(c)
    special = F.length(F.regexp_replace(c, r"[\p{L}\p{N}\s.,;:!?'\"()\[\]-]", ""))
    digits = n - F.length(F.regexp_replace(c, r"\p{Nd}", ""))
    out = F.when(F.coalesce(c, F.lit("")) == "", "empty").when(n < 50, "too_short")
    if not numbered:
        out = out.when(n > 500, "too_long")
    out = out.when(c.rlike(r"(?i)^(?:Appendix|Section|Chapter|Table|Figure|Footnote)\s+\d+"), "header").when(special / n > 0.12, "corrupted")
    return out if numbered else out.when(digits / n > 0.15, "too_many_numbers")


def action_verb(text: Column, after_should_only: bool = False) -> Column:
    """The main verb of a recommendation: after should, must or recommends that (or should alone), else the longest action verb in it."""
    low = F.lower(text)
    after = lambda p: F.when(F.regexp_extract(low, p, 1).isin(L.ACTION_VERBS), F.regexp_extract(low, p, 1))
    ordered = sorted(L.ACTION_VERBS, key=lambda v: (-len(v), v))
    present = F.regexp_extract_all(low, F.lit(r"\b(" + "|".join(ordered) + r")s?\b"), F.lit(1))
    longest = F.element_at(F.array_sort(present, lambda a, b: F.when(F.length(a) != F.length(b), F.length(b) - F.length(a)).when(a < b, -1).when(a > b, 1).otherwise(0)), 1)
    return F.when(F.coalesce(text, F.lit("")) == "", "unknown").otherwise(
        F.coalesce(
            after(r"\bshould\s+(?:also\s+)?(?:urgently\s+)?(?:be\s+)?(\w+)"),
            *([] if after_should_only else [after(r"\bmust\s+(?:also\s+)?(?:be\s+)?(\w+)"), after(r"\brecommends?\s+that\s+[\w\s]+\s+(\w+)")]),
            F.when(F.size(present) > 0, longest), F.lit("unknown"),
        )
    )


def _entity(verb: Column, made) -> Column:
    """``made`` of a verb that is made once, or null without one."""
    return let(verb, lambda v: F.when(v.isNotNull(), made(v)))


def recommendation_rule(c: Column, numbered: bool = False) -> Column:
    """``confidence``, ``method`` and ``verb`` by the first rule that a cleaned candidate meets, or null.

    Where the rule itself gives no verb, ``rest`` is the text to take it from.
    """
    low = F.lower(c)
    none = F.lit(None).cast("string")
    row = lambda conf, method, verb, rest: F.struct(F.lit(conf).alias("confidence"), method.alias("method"), verb.alias("verb"), rest.alias("rest"))
    patterns = [r"(?is)^Safety\s+recommendation\s+(R/\d{4}/\d{3})[:\s]+(.+)", r"(?is)^Recommendation\s+(\d{4}/\d{3})[:\s]+(.+)", r"(?is)^Recommendation\s+(\d{1,2}):\s*(.+)"]
    rules = []
    for k, p in enumerate(patterns):
        prefix = F.lit("hsib_recommendation_" if k < 2 else "numbered_recommendation_")
        rules.append(F.when(c.rlike(p), row(0.98, F.concat(prefix, F.regexp_extract(c, p, 1)), none, F.regexp_extract(c, p, 2))))
    p = r"(?is)^(?:Recommendations?\s+)?Recommendation\s+(\d{1,2})(?:\s+(\d))?\s+(.+)"
    first, extra = F.regexp_extract(c, p, 1), F.regexp_extract(c, p, 2)
    number = F.when((extra != "") & (F.length(first) == 1), F.concat(first, extra)).otherwise(first)
    rules.append(F.when(c.rlike(p), row(0.98, F.concat(F.lit("numbered_recommendation_"), number), none, F.regexp_extract(c, p, 3))))
    p = r"(?is)^HSSIB\s+recommends\s+that\s+(.+)"
    rules.append(F.when(c.rlike(p), row(0.96, F.lit("hssib_recommends"), none, F.regexp_extract(c, p, 1))))
    for modal, tail in (("should", r"(?:also\s+)?(?:urgently\s+)?(?:\w+ly\s+)?(\w+)"), ("must", r"(?:also\s+)?(?:\w+ly\s+)?(\w+)")):
        verbs = F.array(*(F.lower(F.regexp_extract(c, rf"(?i){e}\s+{modal}\s+{tail}", 1)) for e in L.ENTITIES))
        found = F.get(F.filter(verbs, lambda v: v.isin(L.ACTION_VERBS) | v.endswith("e")), F.lit(0))
        met = F.when(c.rlike(rf"(?i)\s{modal}\s"), found)
        method = F.lit(f"entity_{modal}")
        rules.append(_entity(met, lambda v, m=method: row(0.95, m, v, none)))
    rules.append(F.when(low.rlike(r"\bwe\s+recommend\b"), row(0.90, F.lit("we_recommend"), none, c)))
    rules.append(F.when(low.rlike(r"\bit\s+is\s+recommended\s+that\b"), row(0.90, F.lit("it_is_recommended"), none, c)))
    p = r"(\w+(?:\s+\w+)?)\s+should\s+be\s+(\w+ed)\b"
    rules.append(F.when(low.rlike(p) & ~F.regexp_extract(low, p, 1).isin("this", "it", "that", "recommendation", "the recommendation"), row(0.85, F.lit("should_be_passive"), F.regexp_extract(low, p, 2), none)))
    verb, opening, long = F.regexp_extract(low, r"\b(?:should|must|shall)\s+(\w+)\b", 1), F.regexp_extract(low, r"^\s*(\S+)", 1), F.size(tokens(c)) >= 10
    rules.append(F.when(verb.isin(L.ACTION_VERBS) & long & ~low.rlike(r"recommendations?\s+(?:should|must|shall)"), row(0.80, F.lit("modal_verb"), verb, none)))
    rules.append(F.when(opening.isin(L.ACTION_VERBS) & long, row(0.75, F.lit("imperative"), opening, none)))
    met = F.coalesce(*rules)
    return met if numbered else F.when(F.length(c) <= 500, met)


def recommendation_likeness(text: Column) -> Column:
    """The keyword estimate that a text recommends: ``is_recommendation`` and ``confidence``."""
    low = F.lower(F.coalesce(text, F.lit("")))
    # Strong and weak signs of a recommendation.
    strong = sum((low.contains(w).cast("int") for w in ("should", "must", "shall", "recommend", "require", "needs to", "ought to", "is required to")), F.lit(0))
    weak = sum((low.contains(w).cast("int") for w in ("consider", "review", "ensure", "develop", "implement")), F.lit(0))
    pair = lambda yes, conf: F.struct(F.lit(yes).alias("is_recommendation"), conf.cast("double").alias("confidence"))
    return F.when(low == "", pair(False, F.lit(0.0))).when(strong >= 1, pair(True, F.least(0.7 + strong * 0.1, F.lit(0.95)))).when(weak >= 2, pair(True, F.lit(0.6))).otherwise(pair(False, F.lit(0.3)))


def recommendation_number(text: Column) -> Column:
    """The identifier in a recommendation's text, or null."""
    found = [F.regexp_extract(text, r"R/\d{4}/\d{3}", 0), F.regexp_extract(text, r"\b(\d{4}/\d{3})\b", 1), F.regexp_extract(F.lower(text), r"recommendation\s+(\d+)", 1)]
    return F.coalesce(*(F.nullif(x, F.lit("")) for x in found))


def normal_id(c: Column) -> Column:
    """An identifier without white space around it and without its leading ``R/``; empty ones are null."""
    return F.nullif(F.regexp_replace(strip(c), "^R/", ""), F.lit(""))


def has_reply_language(text: Column) -> Column:
    return any_contains(F.lower(text), L.REPLY_PHRASES)


def reply_body(text: Column) -> Column:
    """A response from the first opening phrase that is found beyond its start, or whole."""
    low = F.lower(text)
    at = F.coalesce(*(F.when(F.locate(p, low) > 1, F.locate(p, low)) for p in L.REPLY_OPENINGS))
    return F.when(at.isNotNull(), F.substring(text, at, F.length(text))).otherwise(text)


def self_match(rec: Column, resp: Column) -> Column:
    """Whether a response only repeats the recommendation."""
    a, b = F.regexp_replace(strip(F.lower(rec)), r"\s+", " "), F.regexp_replace(strip(F.lower(resp)), r"\s+", " ")
    both = lambda n: (F.length(a) > n) & (F.length(b) > n)
    inside = both(100) & (b.contains(a) | a.contains(b))
    official = any_contains(F.substring(b, 1, 100), ["government response", "the government"])
    return F.when(a == b, True).when(inside, ~official).otherwise(both(150) & (F.substring(a, 1, 150) == F.substring(b, 1, 150)))


def band(score: Column, *cuts: tuple[float, str], rest: str) -> Column:
    """The label of the first cut that a score is above."""
    out = None
    for least, label in cuts:
        out = F.when(score > least, label) if out is None else out.when(score > least, label)
    return out.otherwise(rest)


def alignment_status(has: Column, same: Column, score: Column) -> Column:
    return F.when(~has, "No response found").when(same, "Direct response").when(score >= 0.5, "Possible response").otherwise("Uncertain")


def scattered_recommendation(sentence: Column) -> Column:
    low = F.lower(sentence)
    padded = F.concat(F.lit(" "), low, F.lit(" "))
    return low.contains("we recommend") | (low.rlike(r"\b(?:should|must|shall)\b") & padded.rlike(" (?:" + "|".join(L.ACTION_VERBS) + ") "))


def scattered_response(sentence: Column) -> Column:
    return any_contains(F.lower(sentence), L.REPLY_PHRASES[1:6])


def opening_method(text: Column) -> Column:
    """The name of the way that a recommendation's wording was detected by."""
    low, out = F.lower(text), F.lit("semantic_match")
    for pattern, shown, name in reversed(L.OPENING_METHODS):
        taken = F.regexp_extract(low, shown, 0) if shown else F.lit("")
        out = F.when(low.rlike(pattern), F.concat(F.lit(name), F.upper(taken))).otherwise(out)
    return out


def section_boundary(sentence: Column) -> Column:
    """Whether a sentence is a numbered heading, or a short one in title case that opens a section without recommendations."""
    line = strip(sentence)
    words = tokens(line)
    titled = F.size(F.filter(words, lambda w: w.rlike(r"^\p{Lu}"))) >= F.size(words) * 0.8
    return line.rlike(r"^\d+\.[\d.]*\s+[A-Z]") | ((F.size(words) <= 6) & titled & any_contains(F.lower(line), L.BOUNDARY_WORDS) & (line != ""))


# The cuts of scores that reports use, best label first.
BANDS = {
    "relevance": ([(0.7, "high"), (0.5, "medium")], "low"),
    "confidence": ([(0.95, "high"), (0.85, "medium")], "low"),
    "match": ([(0.7, "high"), (0.4, "medium")], "low"),
    "alignment": ([(0.7, "high"), (0.5, "medium")], "low"),
    "similar": ([(0.8, "very high"), (0.6, "high"), (0.4, "medium")], "low"),
}


def named_band(score: Column, name: str) -> Column:
    """The label of a score by the cuts of that name."""
    cuts, rest = BANDS[name]
    return band(score, *cuts, rest=rest)
