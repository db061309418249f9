"""Problem 4: cutting oversized texts into overlapping pieces at natural boundaries.

A piece ends at the furthest paragraph or sentence end within the limit, else at white space, else at the
limit; the next piece repeats whole sentences of at most the overlap, else words, else characters.
Sentences are those of the rule cascades, in texts that are mostly lists, tables or junk the lines.

A text longer than a range is dealt out as ranges with halos on both sides. Each task finds the sentences and
lines that begin in its range, from the last paragraph break before the range on, or from the halo's begin
where a paragraph is longer than that; it sends tables of offsets, no text. The stitched tables of a text, in
which a sentence that runs out of one range's halo ends where the next range's first begins, give the pieces
by offset. A text of one range needs no stitching and is cut where it is read. Files are read the same way,
each task seeking to its own byte range.

Defined results: null texts and texts within the limit have no pieces; pieces cover every character;
repeated rows of one id and text count once; an empty table gives an empty table.
"""

from __future__ import annotations

import os
import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docquarry.llm.quality import Weighed
from docquarry.llm.sentences import BLANK, decided, function_words, spans
from docquarry.llm.words import CHUNK, SCRIPTS, Words, chunked

LIMIT, OVERLAP = 1_500, 150
RANGE = 8_000  # characters of a range; longer texts go by ranges
FILE_RANGE = 1_000_000  # bytes of a range of a file
HALO = 4_096  # characters read on both sides of a range
BREAK_BYTES = [re.compile(x) for x in (rb"\n[ \t\r]*\n\s*", rb"(?:[.!?]|\xe3\x80\x82)[ \t\r]*\n\s*", rb"\n")]  # blank lines, lines that end as a sentence, lines
GAP = re.compile(r"\s+")
LINE = re.compile(r"[^\n]*\S[^\n]*")
PIECES = "doc_id bigint, piece int, start_at int, end_at int"


def line_spans(text: str) -> list[tuple[int, int]]:
    """The non-blank lines of a text, without the white space around them."""
    return [(m.start() + len(m[0]) - len(m[0].lstrip()), m.end() - (len(m[0]) - len(m[0].rstrip()))) for m in LINE.finditer(text)]


def units(texts: list[str], common: np.ndarray) -> list[list[tuple[int, int]]]:
    """The sentences of each text, or its lines where running sentences make up less than half of it."""
    made = Weighed(texts, common)
    return [found if run * 2 >= solid else line_spans(t) for t, found, run, solid in zip(texts, made.spans, made.run.tolist(), made.solid.tolist(), strict=True)]


def cut(size: int, found: list[tuple[int, int]], blank, word, limit: int = LIMIT, overlap: int = OVERLAP, whole=int) -> list[tuple[int, int]]:
    """The pieces of a text of ``size`` characters.

    ``blank(a, b)`` gives the last place of white space in a range and ``word(a, b)`` the first place behind white space,
    or -1. ``whole`` moves a place that falls inside a character back to its start, where offsets count bytes.
    """
    starts, ends = [a for a, _ in found], [b for _, b in found]
    out, start = [], 0
    done = 0  # characters that pieces cover so far
    while True:
        if size - start <= limit:
            out.append((start, size))
            return out
        k = bisect_right(ends, start + limit) - 1
        end = ends[k] if k >= 0 and ends[k] > max(start, done) else -1
        if end < 0:
            end = blank(max(start + limit // 2, done + 1), start + limit)
        if end <= max(start, done):
            end = whole(start + limit)
        out.append((start, end))
        done = end
        k = bisect_left(starts, end - overlap)
        start = starts[k] if k < len(starts) and starts[k] < end else -1
        if start < 0:
            start = word(end - overlap, end)
            if start < 0:
                start = whole(end - overlap)
        if start <= out[-1][0]:
            start = whole(out[-1][0] + 1)
            start = end if start <= out[-1][0] else start


def last_blank(text: str):
    """A function that finds the last white space of a range of ``text``."""

    def find(a: int, b: int) -> int:
        return next((i for i in range(min(b, len(text)) - 1, a - 1, -1) if text[i].isspace()), -1)

    return find


def first_word(text: str):
    """A function that finds the first place of a range of ``text`` that white space in the range ends at."""

    def find(a: int, b: int) -> int:
        m = GAP.search(text, max(a, 0), b)
        return m.end() if m and m.end() < b else -1

    return find


def gap_finders(gaps: np.ndarray, gap_ends: np.ndarray):
    """The same two functions of a table of runs of white space."""

    def last(a: int, b: int) -> int:
        k = int(np.searchsorted(gaps, b)) - 1
        at = min(int(gap_ends[k]), b) - 1 if k >= 0 else -1
        return at if at >= a else -1

    def first(a: int, b: int) -> int:
        k = int(np.searchsorted(gap_ends, max(a, 0), "right"))
        return int(gap_ends[k]) if k < len(gaps) and gap_ends[k] < b else -1

    return last, first


def long_start(found: list[tuple[int, int]], limit: int = LIMIT) -> int:
    """The start of the first sentence that is longer than the limit, or -1."""
    return next((a for a, b in found if b - a > limit), -1)


def _whole(df: DataFrame, shared, limit: int, overlap: int, pieces: bool) -> DataFrame:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            keys = pdf["doc_id"].tolist()
            for start, texts in chunked(pdf["text"].tolist()):
                for key, text, found in zip(keys[start:], texts, units(texts, shared.value), strict=False):
                    if pieces:
                        rows += [(key, i, a, b) for i, (a, b) in enumerate(cut(len(text), found, last_blank(text), first_word(text), limit, overlap))]
                    else:
                        rows.append((key, long_start(found, limit)))
            yield pd.DataFrame(rows, columns=["doc_id", "piece", "start_at", "end_at"] if pieces else ["doc_id", "long_at"])

    return df.mapInPandas(run, PIECES if pieces else "doc_id bigint, long_at int")


RANGES = "doc_id bigint, own_id bigint, total int, base int, low int, lang string, chunk string"
OFFSETS = ["starts", "ends", "line_starts", "line_ends", "gaps", "gap_ends"]
TABLES = "doc_id bigint, own_id bigint, total int, base int, before int, line_before int, run bigint, solid bigint, " + ", ".join(f"{c} array<int>" for c in OFFSETS)


def _ranges(range_chars: int, halo: int):
    """Texts as ranges with halos: each with its place, that of its halo, and the language of the whole text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for key, own, text in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                scripts, functions = np.zeros((1, len(SCRIPTS) + 1), np.int64), None
                for at in range(0, len(text), CHUNK):  # words that a chunk's end cuts are left out on both sides of it
                    words = Words([text[at : at + CHUNK]])
                    scripts = scripts + words.scripts()
                    functions = function_words(words) if functions is None else functions | function_words(words)
                lang = decided(scripts, functions, np.array([len(text)]))[0]
                for base in range(0, len(text), range_chars):
                    low = max(0, base - halo)
                    yield pa.RecordBatch.from_pylist([{"doc_id": key, "own_id": own, "total": len(text), "base": base, "low": low, "lang": lang, "chunk": text[low : base + range_chars + halo]}], schema=RANGE_SCHEMA)

    return run


RANGE_SCHEMA = pa.schema([("doc_id", pa.int64()), ("own_id", pa.int64()), ("total", pa.int32()), ("base", pa.int32()), ("low", pa.int32()), ("lang", pa.string()), ("chunk", pa.string())])


def _owned(found: list[tuple[int, int]], first: int, last: int, open_at: int) -> tuple[list[int], list[int], int]:
    """Starts and ends of what begins from ``first`` to ``last``, an end at ``open_at`` as -1, and the end of what comes before, or -1."""
    before = max((b for a, b in found if a < first), default=-1)
    own = [(a, b if b < open_at else -1) for a, b in found if first <= a < last]
    return [a for a, _ in own], [b for _, b in own], before


def _scan(range_chars: int, shared):
    """What each range knows: the sentences, lines and white space that begin in it, as offsets in the text."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for key, own, total, base, low, lang, chunk in pdf.itertuples(index=False):
                first, last = base - low, min(base - low + range_chars, len(chunk))
                breaks = [m.end() for m in BLANK.finditer(chunk)]
                begin = max((x for x in breaks if x <= first), default=0)
                upto = min((x for x in breaks if x >= last), default=len(chunk))
                part = chunk[begin:upto]
                open_at = len(part.rstrip()) if low + len(chunk) < total and upto == len(chunk) else len(part) + 1
                made = Weighed([part], shared.value, [lang])
                inside = [k for k, (a, _) in enumerate(made.spans[0]) if first <= a + begin < last]
                sizes = [made.sizes[0][k] for k in inside]
                starts, ends, before = _owned(made.spans[0], first - begin, last - begin, open_at)
                line_starts, line_ends, line_before = _owned(line_spans(part), first - begin, last - begin, open_at)
                gaps = [(m.start(), m.end()) for m in GAP.finditer(chunk, first, last)]
                shift = low + begin
                placed = lambda xs, by: [x + by if x >= 0 else -1 for x in xs]
                rows.append((
                    key, own, total, base, before + shift if before >= 0 else -1, line_before + shift if line_before >= 0 else -1, sum(x for x, k in zip(sizes, inside, strict=True) if made.running[0][k]), sum(sizes),
                    placed(starts, shift), placed(ends, shift), placed(line_starts, shift), placed(line_ends, shift), placed([a for a, _ in gaps], low), placed([b for _, b in gaps], low),
                ))
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in TABLES.split(", ")])

    return run


def _stitched(pdf: pd.DataFrame, starts: str, ends: str, before: str) -> list[tuple[int, int]]:
    """The whole table of a text's sentences or lines; one that ran out of its range's halo ends where the next range saw it end."""
    out: list[tuple[int, int]] = []
    for a, b, prior in zip(pdf[starts], pdf[ends], pdf[before], strict=True):
        if len(a) and out and out[-1][1] < 0:
            out[-1] = (out[-1][0], max(int(prior), out[-1][0] + 1))
        out += [(int(x), int(y)) for x, y in zip(a, b, strict=True)]
    if out and out[-1][1] < 0:
        out[-1] = (out[-1][0], int(pdf["total"].iloc[0]))
    return out


def _ranged(df: DataFrame, shared, limit: int, overlap: int, range_chars: int, halo: int, pieces: bool) -> DataFrame:
    ranges = df.select("doc_id", "own_id", "text").mapInArrow(_ranges(range_chars, halo), RANGES).repartition("doc_id", "base")
    tables = ranges.mapInPandas(_scan(range_chars, shared), TABLES)

    def emit(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.drop_duplicates("base").sort_values("base")
        prose = pdf["run"].sum() * 2 >= pdf["solid"].sum()
        found = _stitched(pdf, *(("starts", "ends", "before") if prose else ("line_starts", "line_ends", "line_before")))
        own = int(pdf["own_id"].iloc[0])
        if not pieces:
            return pd.DataFrame({"doc_id": [own], "long_at": [long_start(found, limit)]})
        gaps, gap_ends = (np.concatenate([np.asarray(x, np.int64) for x in pdf[c]]) for c in ("gaps", "gap_ends"))
        joined = np.append(True, gaps[1:] != gap_ends[:-1]) if len(gaps) else np.zeros(0, bool)  # runs that a range's end cuts
        last = np.append(joined[1:], True) if len(gaps) else joined
        out = cut(int(pdf["total"].iloc[0]), found, *gap_finders(gaps[joined], gap_ends[last]), limit, overlap)
        return pd.DataFrame({"doc_id": own, "piece": range(len(out)), "start_at": [a for a, _ in out], "end_at": [b for _, b in out]})

    return tables.groupBy("doc_id").applyInPandas(emit, PIECES if pieces else "doc_id bigint, long_at int")


def _oversized(df: DataFrame, common: np.ndarray, id_col: str, text_col: str, limit: int, overlap: int, range_chars: int, halo: int, pieces: bool) -> DataFrame:
    own = df.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("text")).filter(F.col("doc_id").isNotNull() & (F.length("text") > limit))
    shared = df.sparkSession.sparkContext.broadcast(common)
    small = _whole(own.filter(F.length("text") <= range_chars), shared, limit, overlap, pieces).distinct()
    giant = own.filter(F.length("text") > range_chars).select(F.xxhash64("doc_id", "text").alias("doc_id"), F.col("doc_id").alias("own_id"), "text")
    return small.unionByName(_ranged(giant, shared, limit, overlap, range_chars, halo, pieces).distinct())


def split(df: DataFrame, common: np.ndarray, id_col: str = "doc_id", text_col: str = "text", limit: int = LIMIT, overlap: int = OVERLAP, range_chars: int = RANGE, halo: int = HALO) -> DataFrame:
    """``doc_id``, ``piece``, ``start_at`` and ``end_at`` of every piece of the texts over the limit."""
    return _oversized(df, common, id_col, text_col, limit, overlap, range_chars, halo, True)


def long_sentences(df: DataFrame, common: np.ndarray, id_col: str = "doc_id", text_col: str = "text", limit: int = LIMIT, range_chars: int = RANGE, halo: int = HALO) -> DataFrame:
    """``doc_id`` and ``long_at``, where the first sentence over the limit begins, of every text over the limit."""
    return _oversized(df, common, id_col, text_col, limit, OVERLAP, range_chars, halo, False)


def split_files(spark: SparkSession, paths: list[str], limit: int = LIMIT, range_bytes: int = FILE_RANGE, halo: int = HALO, overlap: int = 0) -> DataFrame:
    """``path``, ``start_byte`` and ``end_byte`` of pieces of UTF-8 files of at most ``limit`` bytes, each file read in ranges.

    A task seeks to its range and reads ``halo`` bytes on both sides, which complete the blank lines at its ends. The
    stitched blank lines give units of whole paragraphs of about a range, which tasks read to find their sentences; where
    a paragraph is longer than two ranges, a line that ends as a sentence ends the unit, beyond four any line. Pieces come from ``cut`` as for texts, ends in bytes and never inside a
    character.
    """
    ranges = [(p, at) for p in paths for at in range(0, os.path.getsize(p), range_bytes)]

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for path, at in zip(pdf["path"], pdf["at"], strict=True):
                low = max(0, at - halo)
                chunk = _bytes(path, low, at + range_bytes + halo)
                rows.append((path, at, *([m.end() + low for m in kind.finditer(chunk) if at < m.end() + low <= at + range_bytes] for kind in BREAK_BYTES)))
            yield pd.DataFrame(rows, columns=["path", "at", "blanks", "stops", "lines"])

    def stitch(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        size, cuts = os.path.getsize(key[0]), [0]
        for a, far in sorted((int(b), far) for name, far in (("blanks", 1), ("stops", 2), ("lines", 4)) for r in pdf[name] for b in r if b < size):
            if a - cuts[-1] >= far * range_bytes:
                cuts.append(a)
        return pd.DataFrame({"path": key[0], "at": cuts, "upto": [*cuts[1:], size]})

    def sentences(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for path, at, upto in zip(pdf["path"], pdf["at"], pdf["upto"], strict=True):
                part = _bytes(path, at, upto).decode("utf-8", "surrogateescape")
                place = np.concatenate([[0], np.cumsum([len(c.encode("utf-8", "surrogateescape")) for c in part])]).astype(np.int64) + at
                found = sorted({(a, b) for x, y in spans(part) for a, b in _lines_of(part, x, y, place, limit)})
                gaps = [m.end() - 1 for m in re.finditer(r"[ \t\r\n]+", part)]
                rows.append((path, at, *(place[np.array(x, np.int64)].tolist() for x in ([a for a, _ in found], [b for _, b in found], gaps))))
            yield pd.DataFrame(rows, columns=["path", "at", "starts", "ends", "gaps"])

    def emit(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("at")
        found = [(int(a), int(b)) for s, e in zip(pdf["starts"], pdf["ends"], strict=True) for a, b in zip(s, e, strict=True)]
        gaps = np.array([int(g) for r in pdf["gaps"] for g in r], np.int64)

        with open(key[0], "rb") as file:

            def whole(at: int) -> int:
                """``at`` or the start of the character that it is inside of."""
                for back in range(4):
                    file.seek(at - back)
                    if (file.read(1) or b" ")[0] & 0xC0 != 0x80:
                        return at - back
                return at

            out = cut(os.path.getsize(key[0]), found, *gap_finders(gaps, gaps + 1), limit, overlap, whole)
        return pd.DataFrame({"path": key[0], "start_byte": [a for a, _ in out], "end_byte": [b for _, b in out]})

    table = spark.createDataFrame(ranges, "path string, at bigint").repartition(max(1, len(ranges)))
    units_ = table.mapInPandas(scan, "path string, at bigint, blanks array<bigint>, stops array<bigint>, lines array<bigint>").groupBy("path").applyInPandas(stitch, "path string, at bigint, upto bigint")
    found = units_.repartition(max(1, len(ranges))).mapInPandas(sentences, "path string, at bigint, starts array<bigint>, ends array<bigint>, gaps array<bigint>")
    return found.groupBy("path").applyInPandas(emit, "path string, start_byte bigint, end_byte bigint")


def _bytes(path: str, start: int, end: int) -> bytes:
    with open(path, "rb") as file:
        file.seek(start)
        return file.read(end - start)


def _lines_of(part: str, a: int, b: int, place, limit: int) -> list[tuple[int, int]]:
    """A sentence, or its lines where it is longer than the limit, as in lists and tables."""
    return [(a, b)] if place[b] - place[a] <= limit else [(a + x, a + y) for x, y in line_spans(part[a:b])]
