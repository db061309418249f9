"""Document frequencies of the whole corpus, of which only a bounded head is ever sent to one place.

At most m / s words can be in a share s of all texts, m being the mean number of distinct words of a text,
however many texts there are. So the head needs no cap.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docquarry.llm.words import Words, chunked
from docquarry.session import cut

FLUSH = 1_000_000  # distinct words of texts that a task holds before it adds them up
MOST_SENT = 200_000  # hashes of repeated rows that all tasks are sent
PASS_ON = 300_000  # distinct words that a task holds before it passes them on


def repeated_rows(df: DataFrame) -> DataFrame | None:
    """``text`` of every repeated delivery of an ``id``'s text, once, with ``weight``, by how many rows it is too often, negative; nothing if there are none.

    Only hashes are shuffled to find them; of the texts themselves just those of repeated rows, unless too many hashes
    are repeated for all tasks to be sent them.
    """
    hashed = df.withColumn("hash", F.xxhash64("text"))
    again = cut(hashed.groupBy("id", "hash").agg(F.count(F.lit(1)).alias("rows")).filter("rows > 1").select(F.col("id").alias("own"), F.col("hash").alias("own_hash")))
    size = again.count()
    if not size:
        return None
    held = F.broadcast(again) if size <= MOST_SENT else again
    rows = hashed.join(held, F.col("id").eqNullSafe(F.col("own")) & (F.col("hash") == F.col("own_hash")), "left_semi")
    return rows.groupBy("id", "hash").agg(F.first("text").alias("text"), (1 - F.count(F.lit(1))).alias("weight")).select("text", "weight")


def document_frequencies(df: DataFrame) -> DataFrame:
    """``word``, the hash of a word, and ``docs``, the number of texts that hold it, of a table of ``id`` and ``text``; word 0 counts the texts.

    Repeated deliveries of an id's text count once. Tasks add up before the shuffle.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: list[np.ndarray] = []
        weights: list[np.ndarray] = []
        words, docs = np.zeros(0, np.uint64), np.zeros(0, np.int64)

        def added() -> None:
            nonlocal words, docs
            words, place = np.unique(np.concatenate([words, *waiting]), return_inverse=True)
            docs = np.bincount(place, np.concatenate([docs, *weights]), len(words)).astype(np.int64)
            waiting.clear()
            weights.clear()

        def made() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(words.view(np.int64)), pa.array(docs)], ["word", "docs"])

        for batch in batches:
            weight = batch.column(1).to_numpy(zero_copy_only=False)
            for at, texts in chunked(batch.column(0).to_pylist()):
                own = Words(texts)
                order = np.lexsort((own.doc, own.hash))
                word, doc = own.hash[order], own.doc[order]
                fresh = np.ones(len(order), bool)
                fresh[1:] = (word[1:] != word[:-1]) | (doc[1:] != doc[:-1])
                waiting += [word[fresh], np.zeros(len(texts), np.uint64)]
                weights += [weight[at + doc[fresh]], weight[at : at + len(texts)]]
                if sum(map(len, waiting)) > FLUSH:
                    added()
                if len(words) > PASS_ON:
                    yield made()
                    words, docs = words[:0], docs[:0]
        added()
        yield made()

    all_rows = df.select("text", F.lit(1).cast("bigint").alias("weight"))
    parts, repeated = all_rows.mapInArrow(run, "word bigint, docs bigint"), repeated_rows(df)
    if repeated is not None:
        parts = parts.unionByName(repeated.select("text", F.col("weight").cast("bigint")).mapInArrow(run, "word bigint, docs bigint"))
    return parts.groupBy("word").agg(F.sum("docs").alias("docs"))


def head(df: DataFrame, share: float, least: int, id_col: str = "doc_id", text_col: str = "text", letters: int = 255) -> np.ndarray:
    """The hashes, sorted, of the words of at most ``letters`` letters that at least ``share`` of all texts and ``least`` texts hold.

    The texts are counted in the same pass.
    """
    counted = document_frequencies(df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")))
    counted = cut(counted.filter((F.col("word") == 0) | (F.col("docs") >= least) & (F.col("word").bitwiseAND(F.lit(255)) <= letters)))
    texts = counted.filter("word = 0").first()
    limit = max(least, int(share * texts.docs)) if texts else least
    rows = counted.filter((F.col("docs") >= limit) & (F.col("word") != 0)).select("word").toArrow()
    return np.sort(rows.column(0).to_numpy().view(np.uint64))
