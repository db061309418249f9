"""Tables of documents (arrays of rows of cells, the first the header) as text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from docquarry.functions.text import let, squeeze


def _clean(rows: Column) -> Column:
    return F.transform(rows, lambda r: F.transform(r, lambda c: squeeze(F.coalesce(c, F.lit("")))))


def generic(rows: Column) -> Column:
    """``Header: cell`` joined by bars, a line a row; blank cells left out, headers that lack numbered."""
    return let(_clean(rows), lambda x: _generic(x))


def _generic(rows: Column) -> Column:
    head = F.get(rows, F.lit(0))
    name = lambda i: F.coalesce(F.nullif(F.get(head, i), F.lit("")), F.concat(F.lit("Column "), (i + 1).cast("string")))
    cells = lambda r: F.filter(F.transform(r, lambda c, i: F.when(c != "", F.concat(name(i), F.lit(": "), c))), lambda x: x.isNotNull())
    lines = F.transform(F.slice(rows, F.lit(2), F.greatest(F.size(rows) - 1, F.lit(0))), lambda r: F.array_join(cells(r), " | "))
    return F.array_join(F.filter(lines, lambda x: x != ""), "\n")


def recommendations(rows: Column) -> Column:
    """Rows of recommendations with the actions, owners and timescales that follow them, an item a recommendation."""
    return let(_clean(rows), lambda x: _recommendations(x))


def _recommendations(rows: Column) -> Column:
    head = F.transform(F.get(rows, F.lit(0)), lambda h: F.lower(h))
    places = lambda *words: F.filter(F.transform(head, lambda h, i: F.when(_any(h, words), i)), lambda x: x.isNotNull())
    first, last = (lambda xs: F.get(xs, F.lit(0))), (lambda xs: F.when(F.size(xs) > 0, F.element_at(F.when(F.size(xs) > 0, xs).otherwise(F.array(F.lit(0))), -1)))
    rec, act, own, time = first(places("recommendation")), last(places("action", "improvement")), last(places("owner")), last(places("timescale", "time"))
    most = F.greatest(rec, act, own, time)
    body = F.filter(F.slice(rows, F.lit(2), F.greatest(F.size(rows) - 1, F.lit(0))), lambda r: F.size(r) > most)
    cell = lambda r, k: F.coalesce(F.get(r, k), F.lit(""))
    state = F.struct(F.array().cast("array<string>").alias("out"), F.lit("").alias("now"), F.lit(0).alias("n"))

    def step(acc: Column, r: Column) -> Column:
        fresh = cell(r, rec) != ""
        n = F.when(fresh, acc["n"] + 1).otherwise(acc["n"])
        begin = F.when(fresh, F.concat(F.lit("Recommendation "), n.cast("string"), F.lit(": "), cell(r, rec))).otherwise(acc["now"])
        action = F.regexp_replace(cell(r, act), r"^[a-z]\s+", "")
        more = F.concat(
            F.when(action != "", F.concat(F.lit(" Action: "), action)).otherwise(""), F.when(cell(r, own) != "", F.concat(F.lit(" [Owner: "), cell(r, own), F.lit("]"))).otherwise(""),
            F.when(cell(r, time) != "", F.concat(F.lit(" [Timescale: "), cell(r, time), F.lit("]"))).otherwise(""),
        )
        out = F.when(fresh & (acc["now"] != ""), F.concat(acc["out"], F.array(acc["now"]))).otherwise(acc["out"])
        return F.struct(out.alias("out"), F.when(begin != "", F.concat(begin, more)).otherwise("").alias("now"), n.cast("int").alias("n"))

    end = lambda acc: F.array_join(F.when(acc["now"] != "", F.concat(acc["out"], F.array(acc["now"]))).otherwise(acc["out"]), "\n\n")
    return F.when(rec.isNotNull(), F.aggregate(body, state, step, end)).otherwise("")


def _any(c: Column, words: tuple[str, ...]) -> Column:
    found = F.lit(False)
    for w in words:
        found = found | c.contains(w)
    return found


def as_text(rows: Column) -> Column:
    """A table as text: as recommendations if its header names one of their columns, else cell by cell; tables without rows are empty."""
    asked = F.exists(F.get(_clean(rows), F.lit(0)), lambda h: _any(F.lower(h), ("recommendation", "action", "owner", "timescale", "improvement")))
    told = let(recommendations(rows), lambda x: F.nullif(x, F.lit("")))
    return F.when(F.size(rows) < 2, "").otherwise(F.coalesce(F.when(asked, told), generic(rows)))


def substantial(tables: Column) -> Column:
    """Whether one of a page's tables has more than two rows and more than two columns."""
    return F.exists(tables, lambda t: (F.size(t) > 2) & (F.size(F.get(t, F.lit(0))) > 2))


def page_text(text: Column, tables: Column) -> Column:
    """A page's text followed by its tables as text.

    Where a table is substantial, lines that look like rows of it are left out, and of tables whose texts begin alike the
    first stays; else the text is as it is.
    """
    lines = F.array_join(F.filter(F.split(text, "\n", -1), lambda x: ~x.rlike(r"^(\S+\s{3,}){2,}")), "\n")

    def joined(made: Column) -> Column:
        fresh = F.filter(made, lambda t, i: (F.trim(t) != "") & (F.array_position(F.transform(made, lambda x: F.substring(F.trim(x), 1, 100)), F.substring(F.trim(t), 1, 100)) == i + 1))
        return F.array_join(F.concat(F.when(F.trim(lines) != "", F.array(lines)).otherwise(F.array().cast("array<string>")), fresh), "\n\n")

    made = F.transform(F.filter(tables, lambda t: F.size(t) > 1), as_text)
    return F.when(F.coalesce(substantial(tables), F.lit(False)), let(made, joined)).otherwise(text)
