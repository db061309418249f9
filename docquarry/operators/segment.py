"""Texts as rows of sentences, chunks, pages and sections; every operator keeps ``doc_id``."""

from __future__ import annotations

import bisect

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from docquarry.functions.text import SPACE, any_contains, norm_line, position, strip, with_spaces_after

SENTENCE_END = r"[.!?]+"


def plain_sentences(docs: DataFrame, least: int = 1, renumber: bool = False) -> DataFrame:
    """``doc_id``, ``ordinal``, ``sentence`` and ``position`` of the parts between stops that have ``least`` characters.

    The ordinal counts all parts, or only those kept (``renumber``); positions are those of the first occurrence.
    """
    raw = F.transform(F.split("text", SENTENCE_END, -1), strip)
    parts = F.transform(raw, lambda s, i: F.struct(i.alias("ordinal"), s.alias("sentence")))
    parts = F.filter(parts, lambda p: F.length(p["sentence"]) >= least)
    if renumber:
        parts = F.transform(parts, lambda p, i: F.struct(i.alias("ordinal"), p["sentence"].alias("sentence")))
    rows = docs.filter(F.length("text") > 0).select("doc_id", "text", F.explode(parts).alias("p")).select("doc_id", "text", "p.*")
    return rows.withColumn("position", position(F.col("text"), F.col("sentence"))).drop("text")


def full_sentences(docs: DataFrame) -> DataFrame:
    """``doc_id``, ``ordinal`` and ``sentence``, stops kept, cut where a capital follows the white space after a stop."""
    return docs.filter(F.length("text") > 0).select("doc_id", F.posexplode(F.split("text", r"(?<=[.!?])\s+(?=[A-Z])", -1)).alias("ordinal", "sentence"))


def sentence_spans(docs: DataFrame) -> DataFrame:
    """``doc_id``, ``ordinal``, ``start_at`` and ``end_at`` of sentences with the white space that follows them."""
    parts = with_spaces_after(F.col("text"))
    ends = F.transform(parts, lambda p, i: F.struct(i.alias("ordinal"), F.length(p).alias("n")))
    rows = docs.filter(F.length("text") > 0).select("doc_id", F.explode(ends).alias("p")).select("doc_id", "p.*")
    w = Window.partitionBy("doc_id").orderBy("ordinal").rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn("end_at", F.sum("n").over(w).cast("int")).select("doc_id", "ordinal", (F.col("end_at") - F.col("n")).alias("start_at"), "end_at")


def sentence_context(docs: DataFrame, width: int = 2) -> DataFrame:
    """``doc_id``, ``ordinal``, ``sentence`` and ``context``, the non-empty sentences within ``width`` of it."""
    raw = F.transform(F.split("text", SENTENCE_END, -1), strip)
    near = lambda i: F.array_join(F.filter(F.slice("all", F.greatest(i - width + 1, F.lit(1)), F.least(i, F.lit(width)) + width + 1), lambda s: s != ""), " ")
    rows = docs.filter(F.length("text") > 0).select("doc_id", raw.alias("all"))
    parts = F.filter(F.transform("all", lambda s, i: F.struct(i.alias("ordinal"), s.alias("sentence"), near(i).alias("context"))), lambda p: p["sentence"] != "")
    return rows.select("doc_id", F.explode(parts).alias("p")).select("doc_id", "p.*")


def chunks(docs: DataFrame, target: int = 300, overlap: int = 50) -> DataFrame:
    """``doc_id``, ``chunk_idx`` and ``chunk``: sentences joined up to ``target`` characters.

    A chunk that is full passes its last two sentences on if they fit the overlap, else its last one if it had more; a
    sentence beyond the target is a chunk of its own when nothing waits. The state is folded over the sentences in the JVM.
    """
    sentences = F.transform(F.filter(F.transform(F.split("text", r"\."), strip), lambda s: s != ""), lambda s: F.concat(s, F.lit(".")))
    state = F.struct(F.array().cast("array<string>").alias("out"), F.array().cast("array<string>").alias("buf"), F.lit(0).alias("n"))
    row = lambda out, buf, n: F.struct(out.alias("out"), buf.alias("buf"), n.cast("int").alias("n"))

    def step(acc: Column, s: Column) -> Column:
        out, buf, n = acc["out"], acc["buf"], acc["n"]
        size, waits = F.length(s), F.size(acc["buf"])
        two = F.array_join(F.slice(buf, -2, 2), " ")
        keep2 = (waits > 1) & (F.length(two) <= overlap)
        kept = F.when(F.lit(overlap <= 0) | (waits <= 1), F.array().cast("array<string>")).when(keep2, F.slice(buf, -2, 2)).otherwise(F.slice(buf, -1, 1))
        kept_n = F.when(F.lit(overlap <= 0) | (waits <= 1), F.lit(0)).when(keep2, F.length(two)).otherwise(F.length(F.element_at(buf, -1)))
        alone = row(F.concat(out, F.array(s)), buf, n)
        flushed = row(F.concat(out, F.array(F.array_join(buf, " "))), F.concat(kept, F.array(s)), kept_n + size + 1)
        return F.when((size > target) & (waits == 0), alone).when((n + size > target) & (waits > 0), flushed).otherwise(row(out, F.concat(buf, F.array(s)), n + size + 1))

    last = lambda acc: F.when(F.size(acc["buf"]) > 0, F.concat(acc["out"], F.array(F.array_join(acc["buf"], " ")))).otherwise(acc["out"])
    made = F.aggregate(sentences, state, step, last)
    made = F.when(F.size(sentences) == 0, F.array("text")).otherwise(made)
    return docs.filter(F.length("text") > 0).select("doc_id", F.posexplode(made).alias("chunk_idx", "chunk"))


def chunk_context(parts: DataFrame, width: int = 1) -> DataFrame:
    """``parts`` with ``context``, the chunks within ``width`` joined by dots."""
    w = Window.partitionBy("doc_id").orderBy("chunk_idx").rowsBetween(-width, width)
    return parts.withColumn("context", F.array_join(F.collect_list("chunk").over(w), " ... "))


def pages(docs: DataFrame, mark: str = "\f") -> DataFrame:
    """``doc_id``, ``page``, ``elem``, ``line``: the non-blank lines of pages divided by ``mark``."""
    each = docs.filter(F.length("text") > 0).select("doc_id", F.posexplode(F.split("text", mark)).alias("page", "body"))
    lines = F.filter(F.transform(F.split("body", "\n"), strip), lambda x: x != "")
    return each.select("doc_id", (F.col("page") + 1).alias("page"), F.posexplode(lines).alias("elem", "line"))


def without_running_lines(elements: DataFrame, top: int = 2, bottom: int = 3, share: float = 0.3, least: int = 10) -> DataFrame:
    """``elements`` without the lines that stand at the head or foot of many of their document's pages.

    Only the edges of pages, taken within each page, are counted; the pages of a document are counted with them.
    """
    named = elements.withColumn("norm", norm_line(F.col("line")))
    held = named.groupBy("doc_id", "page").agg(F.array_sort(F.collect_list(F.struct("elem", "norm"))).alias("all"))
    ends = F.concat(F.slice("all", 1, top), F.slice("all", -F.least(F.lit(bottom), F.size("all")), F.lit(bottom)))
    counted = held.select("doc_id", "page", F.explode(F.concat(F.transform(ends, lambda x: x["norm"]), F.array(F.lit(None).cast("string")))).alias("norm"))
    counted = counted.groupBy("doc_id", "norm").agg(F.count(F.lit(1)).alias("times"))
    pages_of = F.max(F.when(F.col("norm").isNull(), F.col("times"))).over(Window.partitionBy("doc_id"))
    often = counted.withColumn("pages", pages_of).filter((F.length("norm") >= least) & (F.col("times") >= F.greatest(F.lit(2), F.floor(F.col("pages") * share))))
    return named.join(often.select("doc_id", "norm"), ["doc_id", "norm"], "left_anti").drop("norm")


def element_pages(elements: DataFrame) -> DataFrame:
    """``page_texts`` of elements as a layout reader gives them (``doc_id``, ``page_number``, ``elem_idx``, ``text``), those without a page on the first.

    Running lines go, pages without a line are left out.
    """
    rows = elements.select("doc_id", F.coalesce("page_number", F.lit(1)).alias("page"), F.col("elem_idx").alias("elem"), strip(F.col("text")).alias("line")).filter(F.length("line") > 0)
    return page_texts(without_running_lines(rows))


def page_break_dump(docs: DataFrame, mark: str = "\f", shown: str = "\n\n--- PAGE BREAK ---\n\n") -> DataFrame:
    """``doc_id`` and ``value``, the text with its page breaks written out."""
    return docs.select("doc_id", F.replace(F.col("text"), F.lit(mark), F.lit(shown)).alias("value"))


def paragraphs(text: Column, words: tuple[str, ...] = ("however", "furthermore", "additionally", "therefore", "moreover", "meanwhile")) -> Column:
    """A text's sentences as paragraphs of four, or of three where the third or a later one holds a connective, each behind a mark."""
    said = F.filter(F.transform(F.split(text, r"(?<=[.!?])\s+", -1), strip), lambda s: s != "")
    none = F.array().cast("array<string>")
    state = F.struct(none.alias("out"), none.alias("now"))

    def step(acc: Column, s: Column) -> Column:
        now = F.concat(acc["now"], F.array(s))
        full = (F.size(now) >= 4) | ((F.size(now) >= 3) & any_contains(F.lower(s), list(words)))
        return F.struct(F.when(full, F.concat(acc["out"], F.array(F.array_join(now, " ")))).otherwise(acc["out"]).alias("out"), F.when(full, none).otherwise(now).alias("now"))

    last = lambda acc: F.when(F.size(acc["now"]) > 0, F.concat(acc["out"], F.array(F.array_join(acc["now"], " ")))).otherwise(acc["out"])
    return F.array_join(F.transform(F.aggregate(said, state, step, last), lambda p: F.concat(F.lit("> "), p)), "\n\n")


def page_texts(elements: DataFrame) -> DataFrame:
    """``doc_id``, ``page``, ``text``, ``start_at`` and ``end_at``: pages put together, with their place in the text of all pages joined by blank lines."""
    body = elements.groupBy("doc_id", "page").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("elem", "line"))), lambda x: x["line"]), "\n").alias("text"))
    w = Window.partitionBy("doc_id").orderBy("page").rowsBetween(Window.unboundedPreceding, -1)
    start = F.coalesce(F.sum(F.length("text") + 2).over(w), F.lit(0)).cast("int")
    return body.withColumn("start_at", start).withColumn("end_at", F.col("start_at") + F.length("text"))


def repeated_lines(docs: DataFrame, more_than: int = 3) -> DataFrame:
    """``doc_id``, ``line`` and ``times`` of the lines of 11 to 99 characters that a text repeats."""
    lines = docs.select("doc_id", F.explode(F.transform(F.split("text", "\n"), strip)).alias("line")).filter(F.length("line").between(11, 99))
    return lines.groupBy("doc_id", "line").agg(F.count(F.lit(1)).alias("times")).filter(F.col("times") > more_than)


def distinct_paragraphs(docs: DataFrame, least: int = 50) -> DataFrame:
    """``doc_id`` and ``text`` without the later copies of paragraphs of ``least`` characters; short texts stay whole."""
    paras = docs.select("doc_id", F.posexplode(F.split("text", "\n\n", -1)).alias("pos", "para")).withColumn("key", strip(F.col("para")))
    w = Window.partitionBy("doc_id", "key").orderBy("pos")
    kept = paras.withColumn("r", F.row_number().over(w)).filter((F.col("r") == 1) | (F.length("key") < least))
    joined = kept.groupBy("doc_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "para"))), lambda x: x["para"]), "\n\n").alias("kept"))
    return docs.select("doc_id", "text").join(joined, "doc_id").select("doc_id", F.when(F.length("text") < 100, F.col("text")).otherwise(F.col("kept")).alias("text"))


def metrics(docs: DataFrame) -> DataFrame:
    """``doc_id``, ``chars``, ``words``, ``sentences`` and ``pages`` of every text."""
    text = F.coalesce("text", F.lit(""))
    tokens = F.size(F.filter(F.split(text, f"{SPACE}+"), lambda w: w != ""))
    sentences = F.size(F.filter(F.split(text, SENTENCE_END, -1), lambda s: strip(s) != ""))
    return docs.select("doc_id", F.length(text).alias("chars"), tokens.alias("words"), sentences.alias("sentences"), F.greatest(F.lit(1), F.floor(F.length(text) / 2000).cast("int")).alias("pages"))


def remove_overlaps(matches: DataFrame, start: str, end: str, score: str, *keys: str, ties: tuple[str, ...] = ()) -> DataFrame:
    """The matches of each group of ``keys`` that overlap none kept before them, by score, then start, end and ``ties``; an order-dependent choice made a group at a time."""
    order = [score, start, end, *ties]

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        starts, ends, kept = [], [], []
        pdf = pdf.sort_values(order, ascending=[False] + [True] * (len(order) - 1)).reset_index(drop=True)
        for at, (a, b) in enumerate(zip(pdf[start].tolist(), pdf[end].tolist(), strict=True)):
            k = bisect.bisect_right(starts, a)
            if (k and ends[k - 1] > a) or (k < len(starts) and starts[k] < b):
                continue
            starts.insert(k, a)
            ends.insert(k, b)
            kept.append(at)
        return pdf.loc[kept]

    return matches.groupBy(*keys).applyInPandas(run, matches.schema)
