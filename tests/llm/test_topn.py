"""The best items of every group against brute force."""

import datetime as dt
import random

from docquarry.llm import topn

AT = [dt.datetime(2024, 1, d) for d in range(1, 20)]
NAN = float("nan")


def test_like_brute_force(spark):
    rng = random.Random(2)
    rows = [(rng.choice([1, 1, 1, 2, 3, None]), i, rng.choice([0.1, 0.5, 0.5, 0.9, None, NAN])) for i in range(400)]
    df = spark.createDataFrame(rows, "g bigint, i bigint, s double").withColumnRenamed("s", "score")
    want = set()
    for g in (1, 2, 3):
        best = sorted((-s, i) for x, i, s in rows if x == g and s is not None and s == s)[:5]
        want |= {(g, i) for _, i in best}
    for heavy in (10, 100_000):  # with and without heavy groups
        got = topn.top_n(df, "g", "i", "score", 5, heavy_rows=heavy).collect()
        assert {(r.group_id, r.item_id) for r in got} == want and len(got) == len(want)


def test_last_version_counts(spark):
    rows = [(1, 7, 0.9, AT[0]), (1, 7, None, AT[5]), (2, 7, 0.2, None), (2, 7, 0.3, AT[1]), (2, 7, 0.3, AT[1]), (None, 7, 1.0, AT[9])]
    df = spark.createDataFrame(rows, "item bigint, g bigint, s double, at timestamp")
    last = topn.last_version(df, "item", "at", "g", "s")
    assert sorted((r.item, r.s) for r in last.collect()) == [(1, None), (2, 0.3)]
    assert [(r.item_id) for r in topn.top_n(last, "g", "item", "s", 3).collect()] == [2]


def test_elements_and_empty(spark):
    schema = "document_id string, results array<struct<result_id bigint, sentence_index int, relevance_score double>>, score int"
    rows = [("D0000000012", [(1, 0, 0.5), (1, 0, 0.5), (2, 0, NAN), (3, 0, None)], 1), ("D0000000012", None, 1), ("bad", [(9, 0, 1.0)], 2), (None, [(8, 0, 1.0)], 2)]
    df = spark.createDataFrame(rows, schema)
    found = topn.top_n(topn.document_elements(df), "document", "result_id", "relevance_score", 3).collect()
    assert [(r.group_id, r.item_id) for r in found] == [(12, 1)]
    assert topn.top_n(topn.document_elements(df.limit(0)), "document", "result_id", "relevance_score", 3).count() == 0
