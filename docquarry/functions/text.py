"""Cleaning, tokens and positions: Column in, Column out, all in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from docquarry.functions.lexicon import ARTIFACTS, CONCEPT_STOPS, STOP_WORDS

SPACE = r"[\t-\r \x{1c}-\x{1f}\x{85}\x{a0}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
WORD = r"[\p{L}\p{N}_]+"
HYPHEN_WORD = r"[\p{L}\p{N}_-]+"


def strip(c: Column) -> Column:
    """Without white space of any kind at both ends."""
    return F.regexp_replace(c, f"^{SPACE}+|{SPACE}+$", "")


def squeeze(c: Column) -> Column:
    """Runs of white space as one space, none at the ends."""
    return F.trim(F.regexp_replace(c, f"{SPACE}+", " "))


def array_of(words: list[str]) -> Column:
    return F.array(*(F.lit(w) for w in words))


def any_contains(c: Column, words: list[str]) -> Column:
    """Whether ``c`` holds one of ``words`` as a substring."""
    found = F.lit(False)
    for w in words:
        found = found | c.contains(w)
    return found


def words(c: Column) -> Column:
    """Lower-cased words in order, with repeats."""
    return F.regexp_extract_all(F.lower(c), F.lit(WORD), F.lit(0))


def meaningful(c: Column) -> Column:
    """Lower-cased words of more than one letter that are no stop words, with repeats."""
    return F.filter(words(c), lambda w: (F.length(w) > 1) & ~w.isin(STOP_WORDS))


def meaningful_cased(c: Column) -> Column:
    """Words and hyphenated words of more than two letters in their own case that are no stop words."""
    return F.filter(F.regexp_extract_all(c, F.lit(HYPHEN_WORD), F.lit(0)), lambda w: (F.length(w) > 2) & ~F.lower(w).isin(STOP_WORDS))


def tokens(c: Column) -> Column:
    """White-space separated tokens."""
    return F.filter(F.split(c, f"{SPACE}+"), lambda w: w != "")


def without_stop_words(c: Column) -> Column:
    """A query without its stop words, or whole if nothing would be left."""
    kept = F.array_join(F.filter(tokens(c), lambda w: ~F.lower(w).isin(STOP_WORDS)), " ")
    return F.when(kept == "", c).otherwise(kept)


def matched_concepts(query: Column, text: Column) -> Column:
    """The first five common tokens of query and text, in order, short and frequent ones left out."""
    both = F.array_intersect(tokens(F.lower(query)), tokens(F.lower(text)))
    return F.slice(F.array_sort(F.filter(both, lambda w: (F.length(w) > 2) & ~w.isin(CONCEPT_STOPS))), 1, 5)


def expand_query(query: Column) -> Column:
    """The variants of a query that are searched for besides it."""
    asked = F.rtrim(query).endswith("?")
    variants = F.when(asked, F.array(query)).otherwise(F.array(query, F.concat(F.lit("What about "), query, F.lit("?")), F.concat(F.lit("Information about "), query)))
    official = any_contains(F.lower(query), ["recommendation", "response", "policy", "action"])
    return F.when(official, F.concat(variants, F.array(F.concat(F.lit("government "), query)))).otherwise(variants)


def position(text: Column, part: Column) -> Column:
    """Where ``part`` first occurs, from 0, or -1."""
    return F.instr(text, part) - 1


def page(at: Column) -> Column:
    """The page that a position is on, at 2,000 characters a page."""
    return F.greatest(F.lit(1), F.floor(at / 2000).cast("int") + 1)


def progress(at: Column, text: Column) -> Column:
    """A position in percent of the text."""
    return F.when(F.length(text) > 0, at / F.length(text) * 100).otherwise(0.0)


def snippet(c: Column, most: int = 200) -> Column:
    """The text, cut at the last full stop of its first ``most`` characters if that is late enough, else at the last space."""
    head = F.substring(c, 1, most)
    stop = F.length(head) - F.locate(".", F.reverse(head))
    gap = F.length(head) - F.locate(" ", F.reverse(head))
    at_stop = F.substring(c, F.lit(1), stop + 1)
    at_gap = F.concat(F.when(F.locate(" ", head) > 0, F.substring(c, F.lit(1), gap)).otherwise(head), F.lit("..."))
    return F.when(F.length(c) <= most, c).when((F.locate(".", head) > 0) & (stop > most * 0.7), at_stop).otherwise(at_gap)


def let(value: Column, body) -> Column:
    """``body`` of ``value``, which is made once however often ``body`` uses it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def with_spaces_after(c: Column) -> Column:
    """A text's sentences with their stops and the white space that follows them; together they are the text."""
    return F.regexp_extract_all(c, F.lit(r"(?s).*?[.!?]\s+(?=\S)|.+\z"), F.lit(0))


def line_endings(c: Column) -> Column:
    return F.regexp_replace(c, r"\r\n?", "\n")


def unwrap(c: Column) -> Column:
    """Single line breaks and runs of spaces as one space."""
    return F.regexp_replace(F.regexp_replace(c, " {2,}", " "), r"(?<!\n)\n(?!\n)", " ")


def _each(c: Column, pairs: list[tuple[str, str]]) -> Column:
    for old, new in pairs:
        c = F.replace(c, F.lit(old), F.lit(new))
    return c


def clean_document(c: Column) -> Column:
    """A report's text without encoding damage, page numbers, running headers, cut sentences and stray short lines."""
    # Damaged characters and what they stand for, in this order.
    c = _each(c, [("â€™", "'"), ("â€œ", '"'), ("â€", '"'), ("ﬁ", "fi"), ("ﬂ", "fl"), ("ﬀ", "ff"), ("ﬃ", "ffi"), ("ﬄ", "ffl")])
    c = _each(c, [("–", "-"), ("—", "-"), ("…", "..."), (" ", " "), (" ", " "), ("​", ""), (" ", " "), (" ", "\n"), (" ", "\n\n")])
    c = F.regexp_replace(c, rf"\n{SPACE}*\d+{SPACE}*\n", "\n")
    c = F.regexp_replace(c, rf"(?i)\n{SPACE}*Page{SPACE}+\d+{SPACE}*\n", "\n")
    c = F.regexp_replace(c, rf"(?i)\n{SPACE}*\d+{SPACE}+of{SPACE}+\d+{SPACE}*\n", "\n")
    c = let(c, lambda x: drop_frequent_lines(x))
    c = F.regexp_replace(c, rf"\n{SPACE}*\d+[a-z]?{SPACE}*\n", "\n")
    c = F.regexp_replace(c, r"([a-z,;])\n([a-z])", "$1 $2")
    c = F.regexp_replace(F.regexp_replace(c, " {2,}", " "), r"\n{3,}", "\n\n")
    stray = lambda x: strip(x).rlike(r"^(?:\p{Nd}{1,9}|\p{L}{1,3})$")
    return strip(F.array_join(F.filter(F.split(c, "\n"), lambda x: ~stray(x)), "\n"))


def drop_frequent_lines(c: Column, times: int = 3) -> Column:
    """Without the lines of 11 to 99 characters that come more than ``times`` times.

    The lines' counts come from one sort of the text's lines, so the work grows with the lines, not with their square.
    """
    lines = F.split(c, "\n")
    bare = F.filter(F.transform(lines, strip), lambda x: F.length(x).between(11, 99))
    often = let(F.array_sort(bare), lambda xs: F.array_distinct(_repeated(xs, times)))
    return let(often, lambda o: F.when(F.size(o) == 0, c).otherwise(F.array_join(F.filter(lines, lambda x: ~F.array_contains(o, strip(x))), "\n")))


def _repeated(ordered: Column, times: int) -> Column:
    """The elements of a sorted array that come more than ``times`` times: equal to the one ``times`` places before."""
    late = F.slice(ordered, F.lit(times + 1), F.greatest(F.size(ordered) - times, F.lit(0)))
    return F.filter(F.zip_with(late, ordered, lambda a, b: F.when(a == b, a)), lambda x: x.isNotNull())


def clean_pdf(c: Column) -> Column:
    """Without print times, addresses and print banners, all white space squeezed."""
    c = F.regexp_replace(c, r"\d{1,2}/\d{1,2}/\d{2,4},?\s+\d{1,2}:\d{2}\s*(?:AM|PM)?\s*", "")
    c = F.regexp_replace(c, r"https?://[^\s]+", "")
    c = F.regexp_replace(c, r"(?i)Government response to the rapid review.*?GOV\.UK[^\n]*", "")
    return squeeze(c)


def has_artifacts(c: Column) -> Column:
    return c.rlike("(?i)" + "|".join(ARTIFACTS))


def fix_encoding(c: Column) -> Column:
    # Damaged characters of extracted texts.
    return _each(c, [("â€™", "'"), ("â€œ", '"'), ("â€", '"'), ("Â ", " "), (" ", " "), ("�", "")])


def clean_strict(c: Column) -> Column:
    """A recommendation's text without addresses, times, page references, stray numbers and site footers, on one line."""
    # What is taken out and what stands for it, in this order.
    steps = [
        (r"https?://[^\s<>\"']+", ""), (r"www\.[^\s<>\"']+", ""), (r"[a-zA-Z0-9.-]+\.gov\.uk[^\s]*", ""), (r"[a-zA-Z0-9.-]+\.org\.uk[^\s]*", ""), (r"[a-zA-Z0-9.-]+\.nhs\.uk[^\s]*", ""),
        (r"(?i)\d{1,2}/\d{1,2}/\d{2,4},?\s*\d{1,2}:\d{2}\s*(?:AM|PM)?[^A-Z]*(?=[A-Z]|$)", " "), (r"\b(\d{1,2})/(\d{1,3})\b", ""), (r"(?i)\bPage\s+\d+\s+(?:of\s+\d+)?", ""),
        (r"\s+\d{1,2}\s*$", ""), (r"^\s*\d{1,2}\s+(?=[A-Z])", ""), (r"\n\s*\d{1,2}\s*\n", "\n"), (r"(?<=[.!?])\s*\d{1,2}\s*(?=[A-Z])", " "), (r"(?<=[a-z])\s+\d{1,2}\s+(?=[a-z])", " "),
        (r"(?i)Rapid review into data on mental health inpatient settings:.*?GOV\.?UK", ""), (r"(?i)final report and recommendations\s*-?\s*GOV\.?UK?", ""), (r"(?i)-\s*GOV\.?\s*UK?\s*", ""),
        (r"(?i)\bRecommendations\s+Recommendation\s+(\d+)\b", "Recommendation $1"), (r"^UK\s+", ""),
    ]
    c = fix_encoding(c)
    for pattern, new in steps:
        c = F.regexp_replace(c, pattern, new)
    return squeeze(c)


def clean_brief(c: Column) -> Column:
    """As ``clean_strict`` with fewer steps: addresses, times, short page references and footnote marks go; null as empty."""
    # What is taken out, in this order.
    steps = [r"https?://\S+", r"www\.\S+", r"(?i)\d{1,2}/\d{1,2}/\d{2,4},?\s*\d{1,2}:\d{2}\s*(?:AM|PM)?", r"\b(\d{1,2})/(\d{1,3})\b(?!\d)", r"\[\d+\]"]
    c = fix_encoding(F.coalesce(c, F.lit("")))
    for pattern in steps:
        c = F.regexp_replace(c, pattern, "")
    return squeeze(c)


def clean_html(c: Column) -> Column:
    """Without tags, the five common entities resolved in order, squeezed; a text left empty says so."""
    c = F.regexp_replace(c, r"<[^>]+>", "")
    c = _each(c, [("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'")])
    c = squeeze(c)
    return F.when(c == "", "No content available").otherwise(c)


def norm_line(c: Column) -> Column:
    """A running header in one form on every page."""
    c = squeeze(c)
    c = F.regexp_replace(c, r"\b\d+/\d+\b", "PAGE_NUM/TOTAL")
    return F.regexp_replace(c, r"\d{1,2}/\d{1,2}/\d{2,4},?\s+\d{1,2}:\d{2}(?::\d{2})?\s*(?:AM|PM)?", "DATE_TIME")


def prefix_sums(numbers: Column, block: int = 128) -> Column:
    """For each number of an array the sum of those before it.

    Sums are made in blocks whose arrays are joined at the end, so that no step copies all that was made before it.
    """
    none = F.array().cast("array<int>")
    fold = lambda xs, start: F.aggregate(xs, F.struct(start.cast("int").alias("sum"), none.alias("out")), lambda acc, x: F.struct((acc["sum"] + x).alias("sum"), F.concat(acc["out"], F.array(acc["sum"])).alias("out")), lambda acc: acc["out"])

    def made(xs: Column) -> Column:
        starts = F.when(F.size(xs) > 0, F.sequence(F.lit(0), F.size(xs) - 1, F.lit(block))).otherwise(none)
        blocks = F.transform(starts, lambda k: F.slice(xs, k + 1, F.lit(block)))
        totals = F.transform(blocks, lambda own: F.aggregate(own, F.lit(0), lambda acc, x: acc + x))
        return F.flatten(F.zip_with(blocks, fold(totals, F.lit(0)), fold))

    return let(numbers, made)


def finditer(text: Column, pattern: str, groups: int = 0) -> Column:
    """All matches in order: an array of structs of ``at``, ``upto`` and ``match``, and ``g1``, ``g2`` ... for the groups.

    The parts between the matches and the matches' own lengths add up to the offsets. The pattern must not match
    nothing and has at most ``groups`` groups.
    """
    names = [f"g{k + 1}" for k in range(groups)]
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    gaps = F.transform(F.split(text, pattern, -1), lambda p: F.length(p))
    captured = [F.regexp_extract_all(text, F.lit(pattern), F.lit(k + 1)).alias(n) for k, n in enumerate(names)]
    rows = F.filter(F.arrays_zip(found.alias("m"), gaps.alias("gap"), *captured), lambda x: x["m"].isNotNull())

    def placed(own: Column) -> Column:
        before = prefix_sums(F.transform(own, lambda x: x["gap"] + F.length(x["m"])))
        return F.zip_with(own, before, lambda x, b: F.struct((b + x["gap"]).alias("at"), (b + x["gap"] + F.length(x["m"])).alias("upto"), x["m"].alias("match"), *(x[n].alias(n) for n in names)))

    return let(rows, placed)


def first_match(text: Column, pattern: str) -> Column:
    """Where ``pattern`` first matches, from 0, or null."""
    return F.nullif(F.regexp_instr(text, F.lit(pattern)), F.lit(0)) - 1


def part(text: Column, start: Column, end: Column) -> Column:
    """The characters from ``start`` to ``end``, counted from 0."""
    return F.substring(text, start + 1, F.greatest(end - start, F.lit(0)))
