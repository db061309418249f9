"""Problem 3: the best N items of every group, with a hot-cold split.

Exact row counts of the groups come from a partial aggregation. Groups with few rows are ranked by an
ordinary window; groups with many rows are spread over salts, range-partitioned by group and salt,
ranked within each salt and once more over the salts' winners. The two results are united, so no task
ever sorts a whole heavy group and no row is dropped before its rank is known.

Defined results: rows with a null group, a null item or a null or NaN score are never taken; ties of
the score go to the smaller item; rows that repeat an item of a group have to be made one before, as
``last_version`` and ``document_elements`` do; a group with fewer than N items gives all; an empty table
gives an empty table. Only the named columns are read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from docquarry.session import cut

HEAVY_ROWS = 50_000  # rows beyond which a group is heavy, and for which it gets a salt each
MOST_SENT = 100_000  # heavy groups that all tasks are sent; with more of them, items join with them by their groups


def last_version(df: DataFrame, item: str, at: str, *kept: str) -> DataFrame:
    """One row per ``item``: the one last by ``at``, null being oldest; of equal times the greatest values of ``kept``."""
    rows = df.filter(F.col(item).isNotNull()).groupBy(item).agg(F.max(F.struct(F.col(at).alias("__at"), *kept)).alias("__row"))
    return rows.select(item, *(F.col(f"__row.{c}").alias(c) for c in kept))


def top_n(items: DataFrame, group: str, item: str, score: str, n: int, raw: DataFrame | None = None, raw_group: Column | None = None, heavy_rows: int = HEAVY_ROWS) -> DataFrame:
    """``group_id``, ``item_id`` and ``score`` of the ``n`` best items of each group, higher score first, then smaller item.

    ``raw`` and ``raw_group`` give a cheaper table to count the groups' rows in, of which ``items`` has no more rows in any group.
    """
    items = items.select(F.col(group).alias("group_id"), F.col(item).alias("item_id"), F.col(score).alias("score"))
    items = items.filter(F.col("group_id").isNotNull() & F.col("item_id").isNotNull() & F.col("score").isNotNull() & ~F.isnan("score"))
    source = items if raw is None else raw.select(raw_group.alias("group_id")).filter(F.col("group_id").isNotNull())
    counted = source.groupBy("group_id").agg(F.count(F.lit(1)).alias("rows")).filter(F.col("rows") > heavy_rows)
    heavy = cut(counted.select("group_id", F.ceil(F.col("rows") / heavy_rows).cast("int").alias("salts")))
    if heavy.count() <= MOST_SENT:
        heavy = F.broadcast(heavy)
    order = [F.desc("score"), F.asc("item_id")]

    def best(df: DataFrame, *keys: str) -> DataFrame:
        ranked = df.withColumn("__rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
        return ranked.filter(F.col("__rank") <= n).drop("__rank")

    light = best(items.join(heavy, "group_id", "left_anti"), "group_id")
    salted = items.join(heavy, "group_id").withColumn("salt", F.pmod(F.xxhash64("item_id"), F.col("salts"))).drop("salts")
    spread = salted.repartitionByRange("group_id", "salt")
    hot = best(best(spread, "group_id", "salt").drop("salt"), "group_id")
    columns = ["group_id", "item_id", "score"]
    return light.select(columns).unionByName(hot.select(columns))


def document_elements(results: DataFrame) -> DataFrame:
    """The distinct elements of every document's result lists; of differing scores of one element the best counts."""
    number = F.regexp_extract("document_id", r"^D(\d+)$", 1).try_cast("bigint")
    each = results.select(number.alias("document"), F.explode("results").alias("e")).select("document", "e.result_id", "e.relevance_score")
    usable = each.filter(F.col("relevance_score").isNotNull() & ~F.isnan("relevance_score"))
    return usable.groupBy("document", "result_id").agg(F.max("relevance_score").alias("relevance_score"))
