"""Similar sets of words of two tables, every record of one against all of the other, in blocks.

Records are packed into blocks: their words as codes of the block's own vocabulary, which holds hashes of 64 bits.
Each pair of blocks is one row and is compared by counting in an inverted index; nothing but the packed blocks moves.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import ceil

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docquarry.session import cut

LEFT_BLOCK, RIGHT_BLOCK = 5_000, 50_000  # records of a block, about
BLOCK_WORDS = 4_000_000  # words after which a block is passed on
LEFT_OUT = 8  # of a record's most frequent words so many are counted for its candidates only
BLOCK = "keys binary, docs binary, known binary, sizes binary, vocabulary binary, codes binary"


def _code_type(words: int) -> type:
    return np.uint16 if words <= 1 << 16 else np.uint32


def pack(keys: np.ndarray, docs: np.ndarray, known: np.ndarray, sizes: np.ndarray, words: np.ndarray) -> list[bytes]:
    """The columns of a block of records with ``sizes`` hashed words each, ``words`` record by record."""
    vocabulary, codes = np.unique(words, return_inverse=True)
    columns = (keys.astype(np.int64), docs.astype(np.int64), known.astype(bool), sizes.astype(np.int32), vocabulary.astype(np.int64), codes.astype(_code_type(len(vocabulary))))
    return [x.tobytes() for x in columns]


class Block:
    """A packed block: its records, their words' codes and the record of each code."""

    def __init__(self, columns: list[bytes]) -> None:
        kinds = (np.int64, np.int64, bool, np.int32, np.int64)
        self.keys, self.docs, self.known, self.sizes, self.vocabulary = (np.frombuffer(x, kind) for x, kind in zip(columns, kinds, strict=False))
        self.codes = np.frombuffer(columns[5], _code_type(len(self.vocabulary))).astype(np.int64)
        self.record = np.repeat(np.arange(len(self.keys)), self.sizes)


def _blocks(rows: DataFrame, key: str, size: int) -> DataFrame:
    """``rows`` of ``key``, ``doc_id`` and ``words``, distinct hashed ones, as packed blocks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, ...]] = []

        def passed_on() -> pa.RecordBatch:
            block = pack(*(np.concatenate(x) for x in zip(*held, strict=True)))
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array([x], pa.binary()) for x in block], names)

        names = [c.split()[0] for c in BLOCK.split(", ")]
        for batch in batches:
            keys, docs, words = (batch.column(k) for k in range(3))
            own = keys.to_numpy(), docs.fill_null(0).to_numpy(), docs.is_valid().to_numpy(zero_copy_only=False), words.value_lengths().to_numpy(), words.flatten().to_numpy()
            held.append(own)
            if sum(len(x[0]) for x in held) >= 2 * size or sum(len(x[4]) for x in held) >= BLOCK_WORDS:
                yield passed_on()
        if held:
            yield passed_on()

    return cut(rows.select(F.col(key).cast("bigint"), F.col("doc_id").cast("bigint"), "words").mapInArrow(run, BLOCK))


def compare(left: Block, right: Block, least: float, most: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``most`` best right keys of every left record and their Jaccard similarities of ``least`` or more, of other documents only; of equal ones the smaller keys.

    A pair needs ``least`` / (1 + ``least``) of both sizes as shared words. The frequent words of a record, but few of them, are left out at
    first: a pair that does not reach what is needed without them and their number does not reach it at all.
    """
    share = least / (1 + least)
    order = np.argsort(right.codes, kind="stable")
    listed, first = right.record[order], np.searchsorted(right.codes[order], np.arange(len(right.vocabulary) + 1))
    at = np.minimum(np.searchsorted(right.vocabulary, left.vocabulary), max(0, len(right.vocabulary) - 1))
    there = right.vocabulary[at] == left.vocabulary
    common = there[left.codes]
    word, record = at[left.codes][common], left.record[common]
    rarest = np.lexsort((np.diff(first)[word], record))
    word, starts = word[rarest], np.searchsorted(record[rarest], np.arange(len(left.keys) + 1))
    out, size = [], None
    for i in np.argsort(left.sizes, kind="stable"):
        n, own = int(left.sizes[i]), word[starts[i] : starts[i + 1]]
        if len(own) < max(1, ceil(share * (n + least * n) - 1e-9)):
            continue
        if n != size:
            size, need = n, np.maximum(1, np.ceil(share * (n + right.sizes) - 1e-9)).astype(np.int64)
            fewest = int(need.min())
        skipped = min(LEFT_OUT, fewest - 1, len(own) - 1)
        some, rest = own[: len(own) - skipped], own[len(own) - skipped :]
        shared = np.bincount(np.concatenate([listed[first[w] : first[w + 1]] for w in some]), minlength=len(right.keys))
        found = np.flatnonzero(shared >= need - skipped)
        if not len(found):
            continue
        shared = shared[found]
        for w in rest:
            holders = listed[first[w] : first[w + 1]]
            shared += holders[np.minimum(np.searchsorted(holders, found), len(holders) - 1)] == found
        kept = (shared >= need[found]) & ~((right.docs[found] == left.docs[i]) & right.known[found] & left.known[i])
        found, shared = found[kept], shared[kept]
        similarity = shared / (n + right.sizes[found] - shared)
        best = np.lexsort((right.keys[found], -similarity))[:most]
        out.append((np.full(len(best), left.keys[i]), right.keys[found[best]], similarity[best]))
    return tuple(np.concatenate(x) for x in zip(*out, strict=True)) if out else (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))


def best_elsewhere(left: DataFrame, right: DataFrame, words: Column, least: float, most: int) -> DataFrame:
    """``rec_key``, ``resp_key`` and ``plain``: for every record of ``left`` the responses of other documents that are at least so similar, the ``most`` best of each block of ``right``.

    ``words`` makes the distinct words of a row with a ``text``; both sides have a ``doc_id``.
    """
    hashed = F.transform(words, lambda w: F.xxhash64(w))

    def packed(rows: DataFrame, key: str, size: int) -> DataFrame:
        rows = rows.filter(F.col(key).isNotNull())
        parts = max(1, -(-rows.count() // size))
        dealt = rows.select(key, "doc_id", "text").repartition(parts).withColumn("words", hashed)
        return _blocks(dealt.filter(F.size("words") > 0), key, size)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                a, b = (Block([batch.column(side + c)[k].as_py() for c in range(6)]) for side in (0, 6))
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in compare(a, b, least, most)], ["rec_key", "resp_key", "plain"])

    rows, others = packed(left, "rec_key", LEFT_BLOCK), packed(right, "resp_key", RIGHT_BLOCK)
    others = others.toDF(*(f"other_{c}" for c in others.columns))
    # A partition holds a block, and all pairs of partitions are read from the written blocks, neither shuffled nor broadcast.
    return rows.crossJoin(others.hint("shuffle_replicate_nl")).mapInArrow(run, "rec_key bigint, resp_key bigint, plain double")
