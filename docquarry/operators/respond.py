"""Responses in documents of five layouts, and in preprocessed texts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from docquarry.functions import lexicon as L
from docquarry.functions.classify import excluded_numbers, is_genuine_response, is_recommendation_text, layout, organisation, scattered_response
from docquarry.functions.similarity import containment
from docquarry.session import staged
from docquarry.functions.text import clean_pdf, finditer, first_match, line_endings, part, squeeze, strip, tokens, with_spaces_after

LONGEST, SHORTEST = 2_000, 30
COLUMNS = ["doc_id", "text", "position", "response_type", "confidence", "rec_number", "rec_id", "source_org", "org_name", "excluded"]
KINDS = {"position": "int", "confidence": "double", "excluded": "boolean"}


def _shape(rows: DataFrame, **values) -> DataFrame:
    for c in COLUMNS[1:]:
        if c in values or c not in rows.columns:
            rows = rows.withColumn(c, values.get(c, F.lit(None)))
    return rows.select("doc_id", *(F.col(c).cast(KINDS.get(c, "string")) for c in COLUMNS[1:]))


def _sections(docs: DataFrame, pattern: str, groups: int, text: Column) -> DataFrame:
    """``doc_id``, ``whole``, ``i``, the match ``m`` and ``until``, where the next match or the text's end is."""
    heads = staged(docs.select("doc_id", "text"), whole=text).drop("text").filter(F.col("whole").rlike(pattern))
    heads = staged(heads, h=finditer(F.col("whole"), pattern, groups))
    rows = heads.select("doc_id", "whole", F.posexplode("h").alias("i", "m"), F.col("h").alias("all"))
    return rows.withColumn("until", F.coalesce(F.get("all", F.col("i") + 1)["at"], F.length("whole"))).drop("all")


def trust(docs: DataFrame) -> DataFrame:
    """Sections ``Recommendation N`` with a trust's response; the numbers that a document excludes come out as not applicable."""
    marker = r"(?i)(?:TEWV|Trust)\s+response[:\s]*"
    rows = _sections(docs, r"(?i)Recommendation\s+(\d+)\s*(\d)?\s*\*?\s*(?:\n|(?=[A-Za-z]))", 2, line_endings(F.col("text")))
    number = F.concat(F.col("m.g1"), F.coalesce(F.col("m.g2"), F.lit(""))).try_cast("int")
    rows = staged(rows, n=number, section=part(F.col("whole"), F.col("m.at"), F.col("until"))).withColumn("marked", F.col("section").rlike(marker))
    w = Window.partitionBy("doc_id", "n").orderBy(F.desc("marked"), "i")
    rows = rows.withColumn("r", F.row_number().over(w)).filter("r = 1 and marked")
    begin = first_match(F.col("section"), marker) + F.length(F.regexp_extract("section", marker, 0))
    rows = rows.withColumn("begin", begin).withColumn("text", squeeze(part(F.col("section"), F.col("begin"), F.length("section")))).filter(F.length("text") >= SHORTEST)
    out = docs.select("doc_id", F.explode(excluded_numbers(F.col("text"))).alias("n"))
    rows = rows.join(out, ["doc_id", "n"], "left_anti")
    answered = _shape(rows.withColumn("text", F.substring("text", 1, LONGEST)), position=F.col("m.at") + F.col("begin"), response_type=F.lit("trust_response"), confidence=F.lit(0.95), rec_number=F.col("n"), rec_id=F.col("n"), source_org=F.lit("tewv"), excluded=F.lit(False))
    note = F.concat(F.lit("N/A - Recommendation "), F.col("n").cast("string"), F.lit(" is addressed to another organisation and not included in this response document"))
    return answered.unionByName(_shape(out, text=note, position=F.lit(0), response_type=F.lit("trust_excluded"), confidence=F.lit(1.0), rec_number=F.col("n"), rec_id=F.col("n"), excluded=F.lit(True)))


def _before_safety(text: Column) -> Column:
    """A text up to its sections of safety observations and actions."""
    cut = F.least(first_match(text, r"(?i)\nSafety\s+observations?\s*\n"), first_match(text, r"(?i)\nSafety\s+actions?\s*\n"))
    return F.when(cut.isNotNull(), part(text, F.lit(0), cut)).otherwise(text)


def by_organisation(docs: DataFrame) -> DataFrame:
    """Sections under a line with an organisation's name, each with a recommendation's identifier and a response."""
    rows = _sections(docs, rf"(?im)(?:^|\n)({L.ORG_LINE})\s*\n", 1, _before_safety(line_endings(F.col("text"))))
    rows = staged(rows.withColumn("org_name", strip(F.col("m.g1"))), section=part(F.col("whole"), F.col("m.upto"), F.col("until")))
    ids = F.regexp_extract("section", r"(?i)recommendation\s+(R/\d{4}/\d{3})", 1)
    first = F.regexp_extract("section", r"(?i)Safety\s+recommendation\s+(R/\d{4}/\d{3})", 1)
    rec_id = F.coalesce(F.nullif(first, F.lit("")), F.nullif(ids, F.lit("")), (F.col("i") + 1).cast("string"))
    line, joined = r"(?i)\nResponse\n", r"(?i)\nResponse\s*(?=The|NHS|We|DHSC|NICE|Care)"
    begin = F.coalesce(first_match(F.col("section"), line) + F.length(F.regexp_extract("section", line, 0)), first_match(F.col("section"), joined) + F.length(F.regexp_extract("section", joined, 0)))
    rows = staged(rows, begin=begin).filter("begin is not null").withColumn("rest", part(F.col("section"), F.col("begin"), F.length("section")))
    end = first_match(F.col("rest"), r"(?i)Actions\s+planned\s+to\s+deliver|Response\s+received\s+on")
    rows = rows.withColumn("text", squeeze(part(F.col("rest"), F.lit(0), F.coalesce(end, F.length("rest"))))).filter(F.length("text") >= SHORTEST)
    name = F.lower("org_name")
    org = F.when(name.contains("shelford"), "shelford_group").when(name.contains("department of health"), "dhsc").otherwise(organisation(F.col("org_name")))
    return _shape(rows.withColumn("text", F.substring("text", 1, LONGEST)), position=F.col("m.upto") + F.col("begin"), response_type=F.lit("hssib_org_structured"), confidence=F.lit(0.95), rec_number=rec_id, rec_id=rec_id, source_org=org)


def by_recommends(docs: DataFrame) -> DataFrame:
    """Sections that begin with what is recommended to an organisation, numbered in order."""
    pattern = r"(?i)HSIB\s+recommends\s+that\s+(?:the\s+)?(NHS\s+England|Care\s+Quality\s+Commission|National\s+Institute[^.]*|Royal\s+College[^.]*|NICE|DHSC)"
    rows = _sections(docs, pattern, 1, line_endings(F.col("text")))
    rows = staged(rows, section=part(F.col("whole"), F.col("m.at"), F.col("until")))
    begin = first_match(F.col("section"), r"(?i)\bResponse\b")
    rows = rows.withColumn("begin", begin + 8).filter("begin is not null").withColumn("rest", part(F.col("section"), F.col("begin"), F.length("section")))
    end = first_match(F.col("rest"), r"(?i)\bActions\s+planned\s+to\s+deliver|\bResponse\s+received\s+on|\bSafety\s+observation|\bSafety\s+action")
    rows = rows.withColumn("text", squeeze(part(F.col("rest"), F.lit(0), F.coalesce(end, F.length("rest"))))).filter(F.length("text") >= SHORTEST)
    number, name = (F.col("i") + 1).cast("string"), strip(F.col("m.g1"))
    return _shape(rows.withColumn("text", F.substring("text", 1, LONGEST)), position=F.col("m.at") + F.col("begin"), response_type=F.lit("org_based_hsib"), confidence=F.lit(0.95), rec_number=number, rec_id=number, source_org=organisation(name), org_name=name)


def standard(docs: DataFrame) -> DataFrame:
    """Responses under a line ``Response``, each with the latest identifier before it."""
    text = staged(docs.filter(F.col("text").isNotNull()).select("doc_id", "text"), text=line_endings(F.col("text")))
    text = staged(text, whole=_before_safety(F.col("text"))).drop("text")
    kind = "array<struct<at:int,upto:int>>"
    plain = lambda p: F.transform(finditer(F.col("whole"), p), lambda m: F.struct(m["at"].alias("at"), m["upto"].alias("upto")))
    heads = F.array_sort(F.concat(plain(r"(?im)(?:^|\n)\s*Response\s*\n"), plain(r"(?i)Response(?=[A-Z][a-z])")))
    apart = F.aggregate(heads, F.array().cast(kind), lambda kept, h: F.when((F.size(kept) == 0) | (h["at"] - F.get(kept, F.size(kept) - 1)["at"] > 20), F.concat(kept, F.array(h))).otherwise(kept))
    ids = F.concat(*(F.transform(finditer(F.col("whole"), p, 1), lambda m: F.struct(m["at"].alias("at"), m["g1"].alias("id"))) for p in (r"(?i)Safety\s+recommendation\s+(R/\d{4}/\d{3})[:\s]", r"(?i)Recommendation\s+(\d{4}/\d{3})[:\s]")))
    orgs = F.transform(finditer(F.col("whole"), r"(?im)(?:^|\n)\s*(?:NHS\s+England|Care\s+Quality\s+Commission|National\s+Institute\s+for\s+Health\s+and\s+Care\s+Excellence|National\s+Institute|Royal\s+College\s+of\s+Psychiatrists|Royal\s+College|The\s+Shelford\s+Group|DHSC)\s*\n"), lambda m: m["at"])
    rows = staged(text, h=apart, ids=ids, orgs=orgs)
    rows = rows.select("doc_id", "whole", "ids", "orgs", F.col("h").alias("all"), F.posexplode("h").alias("i", "m")).withColumn("start", F.col("m.upto"))
    end = F.coalesce(F.get("all", F.col("i") + 1)["at"], F.length("whole"))
    end = F.least(end, F.array_min(F.filter("orgs", lambda o: o > F.col("start"))))
    rows = rows.withColumn("end", end)
    for mark in (r"(?i)\n\s*Actions\s+planned\s+to\s+deliver", r"(?i)\n\s*Safety\s+(?:observation|action)", r"(?i)\n\s*Response\s+received\s+on"):
        at = first_match(part(F.col("whole"), F.col("start"), F.col("end")), mark)
        rows = rows.withColumn("end", F.when(at > 50, F.col("start") + at).otherwise(F.col("end")))
    rows = rows.withColumn("text", squeeze(part(F.col("whole"), F.col("start"), F.col("end")))).filter(F.length("text") >= SHORTEST)
    rec_id = F.array_max(F.filter("ids", lambda x: x["at"] < F.col("m")["at"]))["id"]
    return _shape(rows, position=F.col("start"), response_type=F.lit("hsib_structured"), confidence=F.lit(0.95), rec_number=rec_id, rec_id=rec_id, source_org=organisation(F.col("text")))


def government(docs: DataFrame) -> DataFrame:
    """Sections ``Government response to recommendation N``, and responding sentences outside them that they do not repeat."""
    text = staged(docs.filter(F.col("text").isNotNull()).select("doc_id", "text"), text=clean_pdf(line_endings(F.col("text"))))
    rows = _sections(text, r"(?i)Government\s+response\s+to\s+recommendation\s+(\d+)", 1, F.col("text"))
    nexts = F.transform(finditer(F.col("whole"), r"Recommendation\s+(\d+)\s+([A-Z])"), lambda m: m["at"])
    end = F.least(F.col("until"), F.array_min(F.filter(nexts, lambda p: p > F.col("m")["upto"])))
    rows = staged(rows.withColumn("start", F.col("m.upto")), end=end)
    rows = staged(rows, text=clean_pdf(part(F.col("whole"), F.col("start"), F.col("end")))).filter("text <> ''")
    structured = _shape(rows, position=F.col("start"), response_type=F.lit("structured"), confidence=F.lit(0.95), rec_number=F.col("m.g1"))
    held = rows.groupBy("doc_id").agg(F.collect_list(F.struct(F.col("start"), F.col("end"), squeeze(F.lower("text")).alias("low"))).alias("held"))
    parts = with_spaces_after(F.col("text"))
    lengths = F.transform(parts, lambda p: F.length(p))
    begins = F.aggregate(lengths, F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("out")), lambda a, n: F.struct((a["at"] + n).alias("at"), F.concat(a["out"], F.array(a["at"])).alias("out")), lambda a: a["out"])
    each = text.select("doc_id", F.posexplode(F.arrays_zip(begins.alias("at"), parts.alias("s"))).alias("i", "p"))
    each = staged(each.select("doc_id", "i", F.col("p.at").alias("at"), F.col("p.s").alias("s")).filter(F.length("s") >= 40), s=clean_pdf(F.col("s")))
    each = each.filter(F.length("s").between(40, 500) & ~is_recommendation_text(F.col("s")) & is_genuine_response(F.col("s")))
    each = each.join(held, "doc_id", "left").withColumn("held", F.coalesce("held", F.array().cast("array<struct<start:int,end:int,low:string>>")))
    low = squeeze(F.lower("s"))
    inside = F.exists("held", lambda h: (h["start"] <= F.col("at")) & (F.col("at") < h["end"]))
    repeated = F.exists("held", lambda h: h["low"].contains(low) | (containment(tokens(low), tokens(h["low"])) >= 0.8))
    each = each.filter(~inside & ~repeated)
    w = Window.partitionBy("doc_id", F.lower(F.substring("s", 1, 100))).orderBy("i")
    each = each.withColumn("r", F.row_number().over(w)).filter("r = 1")
    number = F.nullif(F.regexp_extract(F.lower("s"), r"recommendation\s+(\d+)", 1), F.lit(""))
    return structured.unionByName(_shape(each, text=F.col("s"), position=F.col("i"), response_type=F.lit("sentence"), confidence=F.lit(0.85), rec_number=number))


LAYOUTS = {"trust": trust, "hssib_org": by_organisation, "hsib_org": by_recommends, "hsib": standard, "government": government}


def extract(docs: DataFrame) -> DataFrame:
    """All responses, each document by the one way that its layout asks for."""
    named = docs.filter(F.length("text") > 0).withColumn("layout", layout(F.col("text")))
    out = None
    for name, way in LAYOUTS.items():
        rows = way(named.filter(F.col("layout") == name).drop("layout"))
        out = rows if out is None else out.unionByName(rows)
    return out


def headed(docs: DataFrame) -> DataFrame:
    """Responses of preprocessed texts under their headers: ``doc_id``, ``text``, ``start_at``, ``end_at``, ``response_type``, ``rec_id``, ``rec_number``."""
    rows = _sections(docs.filter(strip(F.col("text")) != ""), r"(?i)Government\s+response\s+to\s+recommendation\s+([^\s:]+)", 1, F.col("text"))
    rows = rows.withColumn("text", strip(part(F.col("whole"), F.col("m.upto"), F.col("until")))).filter("text <> ''")
    number = F.when(F.col("m.g1").rlike(r"^\d+$"), F.col("m.g1").try_cast("int"))
    return rows.select("doc_id", "text", F.col("m.upto").alias("start_at"), F.col("until").alias("end_at"), F.lit("structured").alias("response_type"), F.col("m.g1").alias("rec_id"), number.alias("rec_number"))


def scattered(docs: DataFrame) -> DataFrame:
    """Responding sentences of 40 to 500 characters by the given ``sentence_spans``, with the columns of ``headed``."""
    each = docs.filter(F.size("sentence_spans") > 0).select("doc_id", "text", F.explode("sentence_spans").alias("s"))
    rows = each.select("doc_id", strip(part(F.col("text"), F.col("s.start_at"), F.col("s.end_at"))).alias("text"), "s.start_at", "s.end_at")
    rows = rows.filter(F.length("text").between(40, 500) & scattered_response(F.col("text")))
    rec_id = F.nullif(F.regexp_extract(F.lower("text"), r"recommendation\s+([^\s:]+)", 1), F.lit(""))
    return rows.select("doc_id", "text", "start_at", "end_at", F.lit("scattered").alias("response_type"), rec_id.alias("rec_id"), F.when(rec_id.rlike(r"^\d+$"), rec_id.try_cast("int")).alias("rec_number"))


def extract_preprocessed(docs: DataFrame) -> DataFrame:
    """The headed responses, and in documents without any the scattered ones."""
    found = headed(docs)
    return found.unionByName(scattered(docs).join(found.select("doc_id").distinct(), "doc_id", "left_anti"))


def preceding(events: DataFrame, marks: DataFrame, key: str, at: str, value: str) -> DataFrame:
    """``events`` with the ``value`` of the latest of ``marks`` before each: one sort of both, no join."""
    both = events.select(key, at, F.lit(None).cast(dict(marks.dtypes)[value]).alias(value), F.struct(*events.columns).alias("e"), F.lit(1).alias("k"))
    both = both.unionByName(marks.select(key, at, value, F.lit(None).cast(dict(both.dtypes)["e"]).alias("e"), F.lit(0).alias("k")))
    w = Window.partitionBy(key).orderBy(at, F.desc("k")).rowsBetween(Window.unboundedPreceding, -1)
    return both.withColumn("found", F.last(value, ignorenulls=True).over(w)).filter("k = 1").select("e.*", F.col("found").alias(value))


def outside(points: DataFrame, spans: DataFrame, key: str, at: str) -> DataFrame:
    """``points`` that lie in none of ``spans`` (``start_at``, ``end_at``) of their key: by the greatest end among spans that begin before."""
    both = points.select(key, F.col(at).alias("p"), F.lit(None).cast("int").alias("e"), F.struct(*points.columns).alias("row"), F.lit(1).alias("k"))
    both = both.unionByName(spans.select(key, F.col("start_at").alias("p"), F.col("end_at").alias("e"), F.lit(None).cast(dict(both.dtypes)["row"]).alias("row"), F.lit(0).alias("k")))
    w = Window.partitionBy(key).orderBy("p", "k").rowsBetween(Window.unboundedPreceding, 0)
    return both.withColumn("far", F.max("e").over(w)).filter("k = 1 and (far is null or far <= p)").select("row.*")
