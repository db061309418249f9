"""Recommendations matched with responses: by keywords, by identifiers, by organisations and by vectors."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from docquarry.functions.classify import has_reply_language, is_recommendation_text, normal_id, recommendation_number, reply_body, response_status, self_match
from docquarry.functions.similarity import boosted_jaccard, content_words, cosine, jaccard
from docquarry.functions.text import meaningful_cased, words
from docquarry.operators.pairing import best_elsewhere
from docquarry.session import cut


def _left(recs: DataFrame) -> DataFrame:
    number = F.coalesce(recommendation_number(F.col("text")), F.col("rec_number"))
    return recs.select("doc_id", "rec_key", F.col("text").alias("rec_text"), normal_id(number).alias("rec_norm"))


def _right(resps: DataFrame) -> DataFrame:
    return resps.select("doc_id", "resp_key", reply_body(F.col("text")).alias("resp_text"), normal_id(F.coalesce("rec_number", "rec_id")).alias("resp_norm"))


def _best(pairs: DataFrame, order: list[Column]) -> DataFrame:
    w = Window.partitionBy("rec_key").orderBy(*order)
    return pairs.withColumn("r", F.row_number().over(w)).filter("r = 1").drop("r")


def by_keywords(recs: DataFrame, resps: DataFrame, least: float = 0.25) -> DataFrame:
    """Each recommendation with its best response of the same document, if one reaches ``least``: ``rec_key``, ``resp_key``, ``similarity``, ``status``, ``status_confidence``, ``has_response``.

    The similarity is that of the content words, raised for official terms, equal identifiers and the language of a reply.
    Documents are the join key; a document with very many records is divided by the skew join. Words are taken once per text.
    """
    left = _left(recs).withColumn("a", content_words(F.col("rec_text")))
    right = _right(resps).withColumn("b", content_words(F.col("resp_text"))).withColumn("reply", has_reply_language(F.col("resp_text")))
    score = boosted_jaccard(F.col("a"), F.col("b")) + F.when(F.col("rec_norm") == F.col("resp_norm"), 0.4).otherwise(0.0) + F.when(F.col("reply"), 0.2).otherwise(0.0)
    pairs = left.join(right, "doc_id").withColumn("score", score).filter(F.col("score") >= least).filter(~self_match(F.col("rec_text"), F.col("resp_text")))
    best = _best(pairs, [F.desc("score"), F.asc("resp_key")]).withColumn("s", response_status(F.col("resp_text")))
    best = best.select("rec_key", "resp_key", F.least("score", F.lit(1.0)).alias("similarity"), "s.status", F.col("s.confidence").alias("status_confidence"))
    return recs.select("rec_key").join(best, "rec_key", "left").withColumn("has_response", F.col("resp_key").isNotNull())


def top_three(recs: DataFrame, resps: DataFrame, least: float = 0.3, most: int = 3) -> DataFrame:
    """Each recommendation with its ``most`` best responses of all documents: ``rec_key``, ``rank``, ``resp_key``, ``combined_score``, ``similarity_score``, ``same_document``.

    Meaningful words in their own case are compared; responses of the same document count 1.2 times, later ones there 1.1
    times more. That weighted similarity decides, and the order goes by it with 1 as the most (``combined_score``), of equal
    ones the smaller key first. Only pairs that share a word qualify. Those of one document meet by it; of the others, which
    count once, every block of recommendations is compared with every block of responses.
    """
    recs, resps = recs.filter(F.col("rec_key").isNotNull()), resps.filter(F.col("resp_key").isNotNull())
    own = F.array_distinct(meaningful_cased(F.col("text")))
    left = recs.select("doc_id", "rec_key", "position", own.alias("a")).filter(F.size("a") > 0)
    right = resps.select("doc_id", "resp_key", F.col("position").alias("resp_position"), own.alias("b")).filter(F.size("b") > 0)
    plain = left.join(right, "doc_id").withColumn("plain", jaccard(F.col("a"), F.col("b"))).filter("plain > 0")
    weighted = F.col("plain") * 1.2 * F.when(F.col("resp_position") > F.col("position"), 1.1).otherwise(1.0)
    within = plain.select("rec_key", "resp_key", weighted.alias("similarity_score"), F.lit(True).alias("same_document"))
    elsewhere = best_elsewhere(recs, resps, own, least, most).select("rec_key", "resp_key", F.col("plain").alias("similarity_score"), F.lit(False).alias("same_document"))
    pairs = cut(within.unionByName(elsewhere).filter(F.col("similarity_score") >= least), free=True)
    pairs = pairs.withColumn("combined_score", F.least("similarity_score", F.lit(1.0)))
    w = Window.partitionBy("rec_key").orderBy(F.desc(F.round("combined_score", 12)), "resp_key")
    ranked = pairs.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= most)
    return ranked.select("rec_key", "rank", "resp_key", "combined_score", "similarity_score", "same_document")


def nested(ranked: DataFrame, recs: DataFrame) -> DataFrame:
    """One row per recommendation with its responses in order, its confidence and its status."""
    lists = ranked.groupBy("rec_key").agg(F.array_sort(F.collect_list(F.struct("rank", "resp_key", "combined_score", "similarity_score", "same_document"))).alias("responses"))
    top = F.get("responses", F.lit(0))
    rows = recs.select("rec_key").join(lists, "rec_key", "left")
    status = F.when(top.isNull(), "No response found").when(top["same_document"], "Direct response").when(top["combined_score"] >= 0.5, "Possible response").otherwise("Uncertain")
    return rows.select("rec_key", "responses", F.coalesce(top["combined_score"], F.lit(0.0)).alias("alignment_confidence"), status.alias("alignment_status"))


def by_label(recs: DataFrame, resps: DataFrame) -> DataFrame:
    """Each recommendation with its best response of the document: of an equal label, else of an equal number, else of any; ``rec_key``, ``resp_key``, ``similarity``, ``match_method``."""
    left = recs.select("doc_id", "rec_key", "rec_id", F.col("rec_number").try_cast("int").alias("number"), F.array_distinct(words(F.col("text"))).alias("a"))
    right = resps.select("doc_id", "resp_key", F.col("rec_id").alias("resp_id"), F.col("rec_number").try_cast("int").alias("resp_number"), F.array_distinct(words(F.col("text"))).alias("b"))
    pairs = left.join(right, "doc_id").withColumn("similarity", jaccard(F.col("a"), F.col("b"))).filter("similarity > 0")
    tier = F.when((F.col("rec_id") == F.col("resp_id")) & (F.col("rec_id") != ""), 1).when(F.col("number") == F.col("resp_number"), 2).otherwise(3)
    best = _best(pairs.withColumn("tier", tier), [F.asc("tier"), F.desc("similarity"), F.asc("resp_key")])
    method = F.element_at(F.array(F.lit("label_first"), F.lit("number_first"), F.lit("keyword")), F.col("tier"))
    rows = recs.select("rec_key").join(best.select("rec_key", "resp_key", "similarity", method.alias("match_method")), "rec_key", "left")
    return rows.withColumn("match_method", F.coalesce("match_method", F.lit("none")))


def one_to_one(recs: DataFrame, resps: DataFrame) -> DataFrame:
    """As ``by_label``, no response used twice in a document, recommendations choosing in the order of their keys."""
    left = recs.select("doc_id", F.struct("rec_key", "rec_id", F.col("rec_number").try_cast("int").alias("number"), F.array_distinct(words(F.col("text"))).alias("w")).alias("r"))
    right = resps.filter(F.col("doc_id").isNotNull()).select("doc_id", F.struct("resp_key", "rec_id", F.col("rec_number").try_cast("int").alias("number"), F.array_distinct(words(F.col("text"))).alias("w")).alias("r"))

    def run(key: tuple, a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        free = {r["resp_key"]: (r["rec_id"], r["number"], frozenset(r["w"])) for r in sorted(b["r"], key=lambda r: r["resp_key"])}
        out = []
        for r in sorted(a["r"], key=lambda r: r["rec_key"]):
            own, best = frozenset(r["w"]), None
            for k, (label, number, other) in free.items():
                both = len(own & other)
                if both:
                    tier = 1 if r["rec_id"] and r["rec_id"] == label else 2 if r["number"] is not None and r["number"] == number else 3
                    found = (tier, -both / len(own | other), k)
                    best = found if best is None or found < best else best
            if best:
                free.pop(best[2])
            out.append((r["rec_key"], best and best[2], best and -best[1], ("none", "label_first", "number_first", "keyword")[best[0] if best else 0]))
        return pd.DataFrame(out, columns=["rec_key", "resp_key", "similarity", "match_method"])

    return left.groupBy("doc_id").cogroup(right.groupBy("doc_id")).applyInPandas(run, "rec_key bigint, resp_key bigint, similarity double, match_method string")


def by_tiers(recs: DataFrame, resps: DataFrame) -> DataFrame:
    """Each recommendation with its response by the first tier that gives one: equal identifiers, equal organisations, likeness of vectors.

    Both sides carry ``embedding`` and ``org``; ``rec_key``, ``resp_key``, ``similarity`` and ``match_method`` come out. Only
    responses of the same document are candidates; of those the six most alike enter the third tier.
    """
    left = _left(recs).join(recs.select("rec_key", "org", F.col("embedding").alias("va")), "rec_key")
    right = _right(resps).join(resps.select("resp_key", F.col("org").alias("resp_org"), F.col("embedding").alias("vb")), "resp_key")
    pairs = left.join(right, "doc_id").withColumn("sem", F.round(cosine(F.col("va"), F.col("vb")), 12)).filter(~self_match(F.col("rec_text"), F.col("resp_text")))
    near = Window.partitionBy("rec_key").orderBy(F.desc("sem"), F.desc("resp_key"))
    pairs = pairs.withColumn("r", F.row_number().over(near))
    by_id = (F.col("rec_norm") == F.col("resp_norm")) & (F.col("sem") >= 0.3)
    by_org = (F.col("org") == F.col("resp_org")) & (F.col("sem") >= 0.55)
    third = (F.col("r") <= 6) & (F.col("sem") >= 0.4) & ~is_recommendation_text(F.col("resp_text"))
    tier = F.when(by_id, 1).when(by_org, 2).when(third, 3)
    plain = F.col("sem") * F.when(has_reply_language(F.col("resp_text")), 1.0).otherwise(0.7)
    score = F.when(F.col("tier") == 1, F.least(F.col("sem") + 0.5, F.lit(1.0))).when(F.col("tier") == 2, F.least(F.col("sem") + 0.15, F.lit(0.95))).otherwise(plain)
    found = pairs.withColumn("tier", tier).filter("tier is not null").withColumn("similarity", score)
    best = _best(found, [F.asc("tier"), F.desc(F.round("similarity", 10)), F.asc("resp_key")])
    method = F.element_at(F.array(F.lit("id_match"), F.lit("org_match"), F.lit("semantic")), F.col("tier"))
    return recs.select("rec_key").join(best.select("rec_key", "resp_key", "similarity", method.alias("match_method")), "rec_key", "left")


def sort_order(mode: str) -> list[Column]:
    """The order of a report: original, accepted_first, none_first or confidence."""
    # The statuses in the order of a report.
    ranks = {"Accepted": 0, "Partial": 1, "Noted": 2, "Rejected": 3, "Unclear": 4}
    status = F.coalesce(F.element_at(F.create_map(*(F.lit(x) for kv in ranks.items() for x in kv)), F.col("status")), F.lit(5))
    modes = {"original": [F.col("rec_key")], "accepted_first": [status, F.col("rec_key")], "none_first": [F.col("has_response"), F.col("rec_key")], "confidence": [F.desc(F.coalesce("similarity", F.lit(0.0))), F.col("rec_key")]}
    return modes[mode]


def best_matches(recs: DataFrame, resps: DataFrame, least: float = 0.25) -> DataFrame:
    """Each recommendation with its best response: by identifiers, organisations and vectors where both sides have an ``embedding`` and an ``org``, else by keywords."""
    vectors = all({"embedding", "org"} <= set(df.columns) for df in (recs, resps))
    return by_tiers(recs, resps) if vectors else by_keywords(recs, resps, least)
