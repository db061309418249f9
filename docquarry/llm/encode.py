"""Problem 6: encoding of a corpus with a public byte-level BPE vocabulary.

Texts are cut into pre-tokens with array operations, the distinct pre-tokens of a batch are merged in
length-bucketed padded matrices, and each text's ids are gathered from the merged pre-tokens.

Defined results: a null and an empty text have an empty list of ids; strings that look like special
tokens are ordinary text; repeated rows come out as often as they came in; an empty table gives an
empty table. Only the id and the text column are read, so extra columns never clash.
"""

from __future__ import annotations

import json
import os
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TOKENIZERS = "/opt/tokenizers"
VOCABULARY = "byte_bpe_50k"
CHUNK_CHARS = 2_000_000  # characters worked on at once; a longer text is a chunk of its own
CACHE_TOKENS = 400_000  # distinct pre-tokens kept by a worker; past it the cache is emptied, results are the same
NO_MERGE = np.int32(2**31 - 1)
LETTER, NUMBER, OTHER, SPACE = 0, 1, 2, 3
# Code points of the Unicode property White_Space.
WHITE_SPACE = [9, 10, 11, 12, 13, 32, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]


def character_classes() -> np.ndarray:
    """The class of every code point: letter, number, white space or other."""
    table = np.full(0x110000, OTHER, np.uint8)
    for cp in [*range(0x32400), *range(0xE0000, 0xE0200)]:
        kind = unicodedata.category(chr(cp))[0]
        if kind == "L":
            table[cp] = LETTER
        elif kind == "N":
            table[cp] = NUMBER
    table[WHITE_SPACE] = SPACE
    return table


class PairTable:
    """Open-addressing hash table from a pair of ids to its merge rank and merged id, probed with arrays."""

    def __init__(self, left: np.ndarray, right: np.ndarray, merged: np.ndarray) -> None:
        self.bits = max(4, int(len(left) * 4 - 1).bit_length())
        size = 1 << self.bits
        self.keys = np.full(size, -1, np.int64)
        self.rank = np.full(size, NO_MERGE, np.int32)
        self.to = np.full(size, -1, np.int32)
        keys = (left.astype(np.int64) << 32) | right.astype(np.int64)
        waiting, slots = np.arange(len(keys)), self.slot(keys)
        self.probes = 0
        while len(waiting):
            self.probes += 1
            free = self.keys[slots] == -1
            first = np.zeros(len(waiting), bool)
            first[np.unique(slots, return_index=True)[1]] = True
            put = free & first
            self.keys[slots[put]] = keys[waiting[put]]
            self.rank[slots[put]] = waiting[put]
            self.to[slots[put]] = merged[waiting[put]]
            waiting, slots = waiting[~put], (slots[~put] + 1) & (size - 1)

    def slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def find(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The slot of each pair, or of an empty slot."""
        keys = (left.astype(np.int64) << 32) | right.astype(np.int64)
        slots = self.slot(keys)
        at = self.keys[slots]
        open_ = np.flatnonzero((at != keys) & (at != -1))
        while len(open_):
            slots[open_] = (slots[open_] + 1) & (len(self.keys) - 1)
            at = self.keys[slots[open_]]
            open_ = open_[(at != keys[open_]) & (at != -1)]
        return slots


class BytePairEncoder:
    """Byte-level BPE over whole batches of texts."""

    def __init__(self, folder: str = TOKENIZERS, name: str = VOCABULARY) -> None:
        with open(os.path.join(folder, f"{name}.json"), encoding="utf-8") as file:
            model = json.load(file)["model"]
        vocabulary = model["vocab"]
        pairs = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        ids = np.array([(vocabulary[a], vocabulary[b], vocabulary[a + b]) for a, b in pairs], np.int64).reshape(-1, 3)
        self.pairs = PairTable(ids[:, 0], ids[:, 1], ids[:, 2].astype(np.int32))
        # The vocabulary writes each byte as a printable character: printable Latin-1 stays, the rest follows from 256.
        printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
        shown = {b: chr(b) for b in printable}
        shown |= {b: chr(256 + k) for k, b in enumerate(b for b in range(256) if b not in shown)}
        self.byte_ids = np.array([vocabulary[shown[b]] for b in range(256)], np.int32)
        self.classes = character_classes()
        self.powers = self.inverse = np.ones(1, np.uint64)
        self.forget()

    def forget(self) -> None:
        self.known: dict[int, int] = {}
        self.chars, self.ids = np.zeros(0, np.uint32), np.zeros(0, np.int32)
        self.char_at, self.id_at = np.zeros(1, np.int64), np.zeros(1, np.int64)

    def starts(self, cps: np.ndarray, doc_at: np.ndarray) -> np.ndarray:
        """Where pre-tokens begin: contractions, then words, numbers and symbols with a space before them, then white space."""
        n = len(cps)
        kind = self.classes[cps]
        first = np.zeros(n + 1, bool)
        first[doc_at] = True
        edge = first[:n].copy()
        edge[1:] |= kind[1:] != kind[:-1]
        joined = np.zeros(n, bool)  # the character before is a space of the same text
        joined[1:] = (cps[:-1] == 32) & ~first[1:n]
        start = edge & ~((kind != SPACE) & joined)
        start[:-1] |= (kind[:-1] == SPACE) & (kind[1:] != SPACE) & ~first[1:n]
        quotes = np.flatnonzero((cps == 39) & start)
        quotes = quotes[quotes + 1 < n]
        quotes = quotes[(kind[quotes + 1] == LETTER) & ~first[quotes + 1]]
        if len(quotes):
            a = cps[quotes + 1]
            two = quotes + 2 < n
            after = np.minimum(quotes + 2, n - 1)
            b = np.where(two & ~first[after], cps[after], 0)
            size = np.where(np.isin(a, [ord(c) for c in "stmd"]), 1, 0)
            size = np.where(((a == ord("r")) | (a == ord("v"))) & (b == ord("e")) | (a == ord("l")) & (b == ord("l")), 2, size)
            quotes, size = quotes[size > 0], size[size > 0]
            start[quotes + 1] = False
            end = quotes + 1 + size
            inside = end < n
            end = end[inside]
            start[end] = True
        return np.flatnonzero(start)

    def merge(self, raw: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of pre-tokens given as bytes in a row: length buckets, and in each round every row's lowest-ranked pair is merged from the left.

        Returns all ids in one array and the number of ids of each pre-token.
        """
        done: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        at = np.cumsum(lengths) - lengths
        bucket = np.where(lengths <= 16, lengths, 1 << np.ceil(np.log2(np.maximum(lengths, 1))).astype(np.int64))
        order = np.argsort(bucket, kind="stable")
        for group in np.split(order, np.flatnonzero(np.diff(bucket[order])) + 1):
            if not len(group):
                continue
            width = int(bucket[group[0]])
            step = max(1, 1_000_000 // width)
            for k in range(0, len(group), step):
                part = group[k : k + step]
                column = np.arange(width)
                rows = self.byte_ids[raw[np.minimum(at[part][:, None] + column, len(raw) - 1)]]
                self._rounds(rows, lengths[part], part, done)
        size = np.zeros(len(lengths), np.int64)
        for names, sizes, _ in done:
            size[names] = sizes
        so_far, ids = np.concatenate([[0], np.cumsum(size)]), np.zeros(int(size.sum()), np.int32)
        for names, sizes, flat in done:
            ids[np.repeat(so_far[names] - (np.cumsum(sizes) - sizes), sizes) + np.arange(len(flat))] = flat
        return ids, size

    def _rounds(self, rows: np.ndarray, size: np.ndarray, names: np.ndarray, done: list) -> None:
        while True:
            width = int(size.max())
            rows = rows[:, :width]
            column = np.arange(width)
            if width < 2:
                break
            at = self.pairs.find(rows[:, :-1].ravel(), rows[:, 1:].ravel()).reshape(len(rows), width - 1)
            rank = np.where(column[1:] < size[:, None], self.pairs.rank[at], NO_MERGE)
            best = rank.min(1)
            end = best == NO_MERGE
            if end.any():
                done.append((names[end], size[end], rows[end][column < size[end][:, None]]))
                rows, size, names, at, rank, best = (x[~end] for x in (rows, size, names, at, rank, best))
                if not len(rows):
                    return
            # A pair made in this round ranks behind the pair it was made by, so all its places in a row can be merged at once.
            hit = rank == best[:, None]
            before = np.zeros_like(hit)
            before[:, 1:] = hit[:, :-1]
            run = np.maximum.accumulate(np.where(hit & ~before, column[:-1], -1), axis=1)
            hit &= (column[:-1] - run) % 2 == 0
            rows = rows.copy()
            i, j = np.nonzero(hit)
            rows[i, j] = self.pairs.to[at[i, j]]
            keep = column < size[:, None]
            keep[i, j + 1] = False
            size = keep.sum(1)
            packed = np.zeros_like(rows)
            packed[column < size[:, None]] = rows[keep]
            rows = packed
        done.append((names, size, rows[np.arange(rows.shape[1]) < size[:, None]]))

    def _powers(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.powers) < n:
            base = 0x5851F42D4C957F2D
            inverse = pow(base, -1, 1 << 64)
            size = max(n, CHUNK_CHARS + 1)
            steps = np.full((2, size + 1), 1, np.uint64)
            steps[0, 1:], steps[1, 1:] = base, inverse
            self.powers, self.inverse = np.cumprod(steps, axis=1, dtype=np.uint64)
        return self.powers, self.inverse

    def _pretokens(self, cps: np.ndarray, doc_at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The start of each pre-token and its place in the cache; unknown ones are merged first."""
        start = self.starts(cps, doc_at)
        ends = np.append(start[1:], len(cps))
        powers, inverse = self._powers(len(cps) + 1)
        total = np.zeros(len(cps) + 1, np.uint64)
        np.cumsum((cps.astype(np.uint64) + np.uint64(1)) * powers[: len(cps)], out=total[1:])
        code = (total[ends] - total[start]) * inverse[start]
        code = (code ^ (code >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
        code, first, which = np.unique(code, return_index=True, return_inverse=True)
        if len(self.known) + len(code) > CACHE_TOKENS:
            self.forget()
        known = self.known
        place = np.array([known.get(c, -1) for c in code.tolist()], np.int64)
        new = np.flatnonzero(place < 0)
        if len(new):
            self._learn(cps, start[first[new]], ends[first[new]], code[new].tolist())
            place = np.array([known[c] for c in code.tolist()], np.int64)
        place = place[which]
        # Equal hash codes are not trusted: each pre-token is compared with the one that the cache holds.
        length = ends - start
        wrong = length != self.char_at[place + 1] - self.char_at[place]
        at = np.repeat(np.where(wrong, 0, self.char_at[place] - start), length) + np.arange(len(cps))
        same = self.chars[np.minimum(at, len(self.chars) - 1)] == cps
        if wrong.any() or not same.all():
            wrong[np.searchsorted(start, np.flatnonzero(~same), "right") - 1] = True
            bad = np.flatnonzero(wrong)
            base = len(self.char_at) - 1
            self._learn(cps, start[bad], ends[bad], None)
            place[bad] = base + np.arange(len(bad))
        return start, place

    def _learn(self, cps: np.ndarray, start: np.ndarray, end: np.ndarray, codes: list[int] | None) -> None:
        length = end - start
        words = cps[np.repeat(start - (np.cumsum(length) - length), length) + np.arange(length.sum())]
        raw = np.frombuffer(words.tobytes().decode("utf-32-le").encode(), np.uint8)
        width = 1 + (words >= 0x80).astype(np.int64) + (words >= 0x800) + (words >= 0x10000)
        ids, size = self.merge(raw, np.add.reduceat(width, np.cumsum(length) - length))
        base = len(self.char_at) - 1
        if codes is not None:
            self.known.update(zip(codes, range(base, base + len(start)), strict=True))
        self.chars, self.ids = np.concatenate([self.chars, words]), np.concatenate([self.ids, ids])
        self.char_at = np.concatenate([self.char_at, self.char_at[-1] + np.cumsum(length)])
        self.id_at = np.concatenate([self.id_at, self.id_at[-1] + np.cumsum(size)])

    def encode(self, texts: list[str | None], ids: bool = True) -> tuple[np.ndarray, np.ndarray]:
        """All ids in one array (empty if ``ids`` is false), and the number of ids of each text."""
        parts, sizes, chunk, chars = [], [], [], 0
        for text in texts:
            text = text or ""
            if chunk and chars + len(text) > CHUNK_CHARS:
                self._encode(chunk, parts, sizes, ids)
                chunk, chars = [], 0
            chunk.append(text)
            chars += len(text)
        if chunk:
            self._encode(chunk, parts, sizes, ids)
        join = lambda xs, kind: np.concatenate(xs) if xs else np.zeros(0, kind)
        return join(parts, np.int32), join(sizes, np.int64)

    def _encode(self, texts: list[str], parts: list, sizes: list, ids: bool) -> None:
        lengths = np.array([len(t) for t in texts], np.int64)
        if not lengths.sum():
            sizes.append(np.zeros(len(texts), np.int64))
            return
        cps = np.frombuffer("".join(texts).encode("utf-32-le"), "<u4")
        doc_end = np.cumsum(lengths)
        start, place = self._pretokens(cps, doc_end - lengths)
        count = self.id_at[place + 1] - self.id_at[place]
        so_far = np.concatenate([[0], np.cumsum(count)])
        doc_tokens = np.concatenate([[0], np.searchsorted(start, doc_end)])
        sizes.append(np.diff(so_far[doc_tokens]))
        if ids:
            parts.append(self.ids[np.repeat(self.id_at[place] - so_far[:-1], count) + np.arange(so_far[-1])])


_ENCODERS: dict[tuple[str, str], BytePairEncoder] = {}


def encoder(folder: str, name: str) -> BytePairEncoder:
    """One encoder per Python worker, kept between tasks."""
    if (folder, name) not in _ENCODERS:
        _ENCODERS[folder, name] = BytePairEncoder(folder, name)
    return _ENCODERS[folder, name]


def token_ids(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", folder: str = TOKENIZERS, name: str = VOCABULARY) -> DataFrame:
    """``id_col`` and ``ids``, the ids of ``text_col``; one pass, no shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(folder, name)
        for batch in batches:
            ids, sizes = own.encode(batch.column(1).to_pylist())
            offsets = pa.array(np.concatenate([[0], np.cumsum(sizes)]), pa.int32())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(offsets, pa.array(ids, pa.int32()))], [id_col, "ids"])

    kind = dict(df.dtypes)[id_col]
    return df.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {kind}, ids array<int>")


def token_counts(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", folder: str = TOKENIZERS, name: str = VOCABULARY) -> DataFrame:
    """``id_col`` and ``tokens``, the number of ids of ``text_col``; the ids themselves are never made."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(folder, name)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(own.encode(batch.column(1).to_pylist(), ids=False)[1], pa.int64())], [id_col, "tokens"])

    kind = dict(df.dtypes)[id_col]
    return df.select(id_col, F.col(text_col)).mapInArrow(run, f"`{id_col}` {kind}, tokens bigint")
