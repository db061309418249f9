"""Problem 7: filling containers of fixed capacity with documents.

Documents are dealt at random into groups of bounded size; each group is packed by first-fit
decreasing, the first container with room being found in a tournament tree of the containers' free
space. A document larger than a container is cut into full containers and a rest, no other is cut.

Defined results: null and empty texts are left out; a blank text is a document like any other; repeated
rows of one id count once; documents of equal size go by their id; an empty table gives an empty table.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docquarry.llm.encode import TOKENIZERS, VOCABULARY, token_counts

CAPACITY = 2_048
GROUP_DOCUMENTS = 20_000  # documents of a group, about; a group is one task's work
SCHEMA = "doc_id bigint, piece int, start_token bigint, tokens bigint, container_id bigint"


def first_fit(sizes: list[int], capacity: int) -> list[int]:
    """The container of each size, first fit in the given order, by a tournament tree of free space."""
    leaves = 1
    while leaves < max(1, len(sizes)):
        leaves *= 2
    free = [capacity] * (2 * leaves)
    out = []
    for size in sizes:
        at = 1
        while at < leaves:
            at *= 2
            if free[at] < size:
                at += 1
        out.append(at - leaves)
        free[at] -= size
        while at > 1:
            at //= 2
            a, b = free[2 * at], free[2 * at + 1]
            best = a if a > b else b
            if free[at] == best:
                break
            free[at] = best
    return out


def pack_group(ids: np.ndarray, tokens: np.ndarray, capacity: int, group: int) -> pd.DataFrame:
    """The pieces of one group's documents with their containers."""
    pieces = np.maximum(1, -(-tokens // capacity))
    row = np.repeat(np.arange(len(ids)), pieces)
    piece = np.arange(len(row)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
    size = np.minimum(capacity, tokens[row] - piece * capacity)
    order = np.lexsort((piece, ids[row], -size))
    full = int((size == capacity).sum())  # a full piece needs no search
    bins = np.concatenate([np.arange(full), full + np.array(first_fit(size[order][full:].tolist(), capacity), np.int64)]).astype(np.int64)
    return pd.DataFrame({"doc_id": ids[row][order], "piece": piece[order].astype(np.int32), "start_token": (piece * capacity)[order], "tokens": size[order], "container_id": (np.int64(group) << 32) + bins})


def containers(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, folder: str = TOKENIZERS, name: str = VOCABULARY, group_documents: int = GROUP_DOCUMENTS) -> DataFrame:
    """One row per piece of a document: where it begins, its tokens and its container."""
    docs = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    groups = max(1, round(docs.count() / group_documents))
    sized = token_counts(docs.filter(F.col("doc_id").isNotNull() & (F.length("text") > 0)), folder=folder, name=name)
    sized = sized.groupBy("doc_id").agg(F.max("tokens").alias("tokens"))
    sized = sized.withColumn("group", F.pmod(F.xxhash64("doc_id", F.lit(7)), F.lit(groups)))

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        return pack_group(pdf["doc_id"].to_numpy(), pdf["tokens"].to_numpy(), capacity, int(key[0]))

    return sized.groupBy("group").applyInPandas(run, SCHEMA)
