"""Searches by vectors, marking, choosing, numbering and the smaller operators, against small cases worked out by hand."""

import datetime as dt
from pathlib import Path

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from docquarry.functions import classify
from docquarry.functions.similarity import encoder
from docquarry.functions.text import array_of, clean_brief, finditer, prefix_sums
from docquarry.operators import align, choose, engine, highlight, recommend, search, segment, stats, tables
from docquarry.plans import catalog
from docquarry.sinks import writers
from docquarry.sources import readers

DATA = Path("/root/testdata/sf0.001")


def one(spark, *columns):
    return spark.range(1).select(*(c.alias(f"c{i}") for i, c in enumerate(columns))).first()


@pytest.mark.parametrize("n", [0, 1, 127, 128, 129, 1000])
def test_prefix_sums(spark, n):
    numbers = [k % 7 for k in range(n)]
    df = spark.createDataFrame([(numbers,)], "xs array<int>")
    assert df.select(prefix_sums(F.col("xs"))).first()[0] == [sum(numbers[:k]) for k in range(n)]


def test_finditer_of_many(spark):
    import re

    text = " ".join(f"No {k} of x{k}" for k in range(400))
    (rows,) = spark.createDataFrame([(text,)], "t string").select(finditer(F.col("t"), r"(\d+) of", 1)).first()
    assert [(r["at"], r.upto, r.match, r.g1) for r in rows] == [(m.start(), m.end(), m[0], m[1]) for m in re.finditer(r"(\d+) of", text)]


def test_chunks_by_vectors(spark):
    rows = [(1, 0, "stock list kept", [1.0, 0.0]), (1, 1, "other words", [0.6, 0.8]), (1, 2, "nothing", [-1.0, 0.0]), (2, 0, "list", [0.0, 1.0]), (3, 0, "zero", [0.0, 0.0])]
    chunks = spark.createDataFrame(rows, "doc_id bigint, chunk_idx int, chunk string, embedding array<float>")
    hits = engine.search_chunks(chunks, [[1.0, 0.0], [0.0, 2.0]], "stock list", top_k=1)
    got = {(r.doc_id, r.chunk_idx): (round(r.relevance_score, 6), r.full_context) for r in hits.collect()}
    assert got == {(1, 0): (1.0, "stock list kept ... other words"), (2, 0): (1.0, "list")}
    every = engine.search_chunks(chunks, [[1.0, 0.0]], "stock list", boost=0)
    assert sorted((r.doc_id, r.chunk_idx, round(r.relevance_score, 6)) for r in every.collect()) == [(1, 0, 1.0), (1, 1, 0.6)]
    docs = spark.createDataFrame([(1, 0.5), (9, None)], "doc_id bigint, second double")
    ranked = engine.rank_documents(every, docs, "second").collect()
    assert [(r.doc_id, round(r.overall_score, 6), r.total_matches) for r in ranked] == [(1, round((0.7 + 0.3 * 0.8) * 0.6 + 0.2, 6), 2), (9, 0.0, 0)]
    assert [r.chunk_idx for r in engine.best_results(every, 1).collect()] == [0]


def test_nearest_like_brute_force(spark, monkeypatch):
    monkeypatch.setattr(search, "ROUND_QUERIES", 40)  # three rounds
    rng = np.random.default_rng(3)
    rows = rng.normal(size=(300, 8)).round(1)
    rows[5] = rows[6] = rows[7]  # ties
    rows[9] = 0
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(rows)] + [(None, [1.0] * 8), (999, None)], "vec_id bigint, embedding array<double>")
    queries = df.filter("vec_id < 100").withColumnRenamed("vec_id", "query_id")
    size = np.linalg.norm(rows, axis=1)
    unit = rows / np.where(size == 0, 1, size)[:, None]
    score = np.round(unit[:100] @ unit.T, 12)
    want = {(q, v) for q in range(100) for v in sorted(range(300), key=lambda v: (-score[q, v], v))[:4]}
    assert {(r.query_id, r.vec_id) for r in search.nearest(queries, df, 4).collect()} == want
    assert all(r.similarity >= 0.9 for r in search.nearest(queries, df, 4, least=0.9).collect())


def test_ways_of_searching(spark):
    docs = spark.createDataFrame([(1, "The board should review staffing. Training was short. Staffing review is due."), (2, "Nothing is here to be found."), (3, None), (4, "")], "doc_id bigint, text string")
    smart = engine.execute(docs, "staffing review", "Smart Search", 1).collect()
    assert [(r.doc_id, r.position, r.score, r.rank) for r in smart] == [(1, 0, 100.0, 1)]
    exact = engine.execute(docs, "review", "Exact Match").collect()
    assert [(r.position, r.matched_text, r.rank) for r in exact] == [(17, "review", 1), (63, "review", 2)]
    assert engine.execute(docs, "Review", "Exact", case_sensitive=True).count() == 0
    fuzzy = engine.execute(docs, "stafing", "Fuzzy").collect()
    assert {r.matched_text for r in fuzzy} >= {"staffing", "staffing."}
    assert engine.execute(docs, "review", "AI Semantic").count() > 0 and engine.execute(docs, "review", "Hybrid").count() > 0
    assert engine.execute(docs, "review", "Hybrid (Smart + AI)").first().match_type == "smart"
    words = search.fuzzy(docs, "due.", context=True).filter("word = 'due.'").first()
    assert words.context == "board should review staffing. Training was short. Staffing review is due."
    assert not engine.has_vectors(None) and not engine.has_vectors(docs)


def test_searches_are_kept(spark):
    kept, made = engine.Searches(), []
    make = lambda q: made.append(q) or spark.range(1)
    kept.get(make, "a"), kept.get(make, "a"), kept.get(make, "b")
    assert made == ["a", "b"] and kept.statistics() == {"total_searches": 3, "cache_hits": 1, "cached": 2, "hit_rate": 1 / 3}
    kept.clear()
    assert kept.statistics()["cached"] == 0


def test_marking(spark):
    t = F.lit("Review the reviewed policy, a POLICY of it")
    row = one(spark, highlight.prefixed(t, ["it", "review", "policy"], "caps"), highlight.whole(t, ["review", "policy"], "bold"), highlight.whole(t, ["policy"], "caps"), highlight.smart(t, "review"), highlight.smart(t, "the of"), highlight.smart(F.lit(""), "review"), highlight.official(t))
    assert row.c0 == "**REVIEW** the **REVIEWED** **POLICY**, a **POLICY** of it"
    assert row.c1 == "**review** the reviewed **policy**, a **policy** of it" and row.c2 == "Review the reviewed POLICY, a POLICY of it"
    assert row.c3 == ("<mark>Review</mark> the <mark>reviewed</mark> policy, a POLICY of it", "html") and row.c4.method == row.c5.method == "none"
    assert row.c6.method == "html" and row.c6.text.count("<mark>") == 4


def test_choosing(spark):
    docs = spark.createDataFrame([(2, "a_Response.pdf", 5), (1, "a_Response.pdf", 7), (3, "b.pdf", None), (4, None, 1)], "doc_id bigint, filename string, word_count int")
    assert sorted(r.doc_id for r in choose.suggested_responses(docs).collect()) == [1, 2]
    assert sorted((r.doc_id, r.word_count) for r in choose.first_of_each_name(docs).collect()) == [(1, 7), (3, None)]
    assert choose.of_documents(docs, ["b.pdf"]).count() == choose.of_documents(docs, docs.filter("doc_id = 3")).count() == 1
    assert choose.by_method(docs, [5, 7], "word_count").count() == 2
    assert [r.doc_id for r in choose.by_score(docs, "word_count", "doc_id").collect()] == [1, 2, 4, 3]
    assert stats.upload_summary(docs).first() == (4, 13, 3) and stats.upload_summary(docs.limit(0)).first() == (0, 0, 0)


def test_numbers_go_through_all_partitions(spark):
    rows = spark.range(1000).withColumn("k", F.pmod(F.xxhash64("id"), F.lit(37)))
    got = writers.numbered(rows.repartition(7), "n", F.desc("k"), "id").orderBy("n").collect()
    assert [r.n for r in got] == list(range(1, 1001)) and [(r.k, r.id) for r in got] == sorted(((r.k, r.id) for r in got), key=lambda x: (-x[0], x[1]))
    assert writers.numbered(rows.limit(0), "n", "id").count() == 0


def test_report(spark):
    rows = [(2, "Do this", None, None, False), (1, "Do that", "Done", "Accepted", True)]
    df = spark.createDataFrame(rows, "rec_key bigint, rec_text string, resp_text string, status string, has_response boolean")
    parts = [r.value for r in writers.markdown(df, F.lit(dt.datetime(2024, 1, 2))).orderBy("part").collect()]
    assert len(parts) == 3 and "- Total Recommendations: 2\n- Responses Found: 1\n- Accepted: 1\n- Partial: 0\n- Rejected: 0\n- No Response: 1" in parts[0]
    assert parts[1].startswith("### Recommendation 1\n**Status:** Accepted") and "> No response found" in parts[2]
    assert [r.text for r in writers.samples(df.withColumnRenamed("rec_text", "text"), 1, "rec_key", most=4).collect()] == ["Do t..."]
    assert writers.marker_counts(spark.createDataFrame([(1, "ab AB x"), (2, None)], "doc_id int, text string"), "ab").orderBy("doc_id").collect() == [(1, 2), (2, 0)]


def test_pages_and_tables(spark):
    elements = spark.createDataFrame([(1, None, 0, "Head line of report"), (1, None, 1, "One"), (1, 2, 0, "Head line of report"), (1, 2, 1, " Two "), (1, 2, 2, " ")], "doc_id int, page_number int, elem_idx int, text string")
    assert [(r.page, r.text, r.start_at, r.end_at) for r in segment.element_pages(elements).orderBy("page").collect()] == [(1, "One", 0, 3), (2, "Two", 5, 8)]
    head, row = array_of(["Name", "Cost", "Site"]), array_of(["Ann", "3", "East"])
    table = F.array(head, row, row)
    small = F.array(head, row)
    got = one(spark, tables.page_text(F.lit("Text\nAnn   3   East\nEnd"), F.array(table, table)), tables.page_text(F.lit("Text\nAnn   3   East"), F.array(small)))
    assert got.c0 == "Text\nEnd\n\nName: Ann | Cost: 3 | Site: East\nName: Ann | Cost: 3 | Site: East" and got.c1 == "Text\nAnn   3   East"
    text = "One is. Two is. However three is. Four. Five. Six. Seven. Eight."
    assert one(spark, segment.paragraphs(F.lit(text))).c0 == "> One is. Two is. However three is.\n\n> Four. Five. Six. Seven.\n\n> Eight."


def test_wording(spark):
    block = "Recommendation 2018/006: Preamble here. That the Trust should keep a log. It should be read. Lunch was served. It should end."
    t = F.lit(block)
    row = one(spark, recommend.wording_start(t), recommend.wording_end(t, recommend.wording_start(t)), classify.section_boundary(F.lit("6.3. Safety Observations")), classify.section_boundary(F.lit("Summary Findings")), classify.section_boundary(F.lit("The log was kept in the summary room")), clean_brief(F.lit("See [2] https://x.y 1/2/2020, 10:15 AM end 3/12 R")), clean_brief(F.lit(None)))
    assert block[row.c0 :].startswith("That the Trust") and block[row.c0 : row.c1].strip() == "That the Trust should keep a log. It should be read."
    assert (row.c2, row.c3, row.c4) == (True, True, False) and row.c5 == "See end R" and row.c6 == ""
    docs = spark.createDataFrame([(1, block + " Recommendation 2018/007: We recommend that the board should publish the whole plan by the end of May."), (2, "Nothing. The council should publish the whole plan by the end of the month."), (3, None), (4, " ")], "doc_id bigint, text string")
    got = {(r.doc_id, r.rec_number): (r.method, r.confidence) for r in recommend.extract_by_likeness(docs).collect()}
    assert got[(1, "2018/007")] == ("hsib_recommendation_2018/007", 0.95) and got[(2, None)][0] == "modal_verb"
    verdicts = {r.verdict for r in recommend.inspected(docs).collect()}
    assert "kept" in verdicts


def test_encoder_bands_and_best_matches(spark):
    sizes = encoder(lambda texts: [[len(t), 1] for t in texts], batch=2)
    df = spark.createDataFrame([(1, "ab"), (2, None), (3, "abc")], "id int, t string")
    assert {r.id: list(r.v) for r in df.select("id", sizes(F.col("t")).alias("v")).collect()} == {1: [2, 1], 2: [0, 1], 3: [3, 1]}
    assert tuple(one(spark, *(classify.named_band(F.lit(0.65), n) for n in ("similar", "relevance", "match", "confidence")))) == ("high", "medium", "medium", "low")
    recs = spark.createDataFrame([(1, 10, "The board should review staffing levels and training", None)], "doc_id bigint, rec_key bigint, text string, rec_number string")
    resps = spark.createDataFrame([(1, 20, "The government accepts this. Staffing levels and training are under review", None, None)], "doc_id bigint, resp_key bigint, text string, rec_number string, rec_id string")
    assert align.best_matches(recs, resps).first().resp_key == 20 and not align.best_matches(recs, resps.limit(0)).first().has_response


def test_files_without_a_reader(spark, tmp_path):
    (tmp_path / "a.txt").write_text("two words")
    (tmp_path / "b.pdf").write_bytes(b"%PDF")
    files = spark.read.format("binaryFile").load(str(tmp_path))
    assert {r.filename: r.text for r in readers.placeholders(files).collect()} == {"a.txt": "two words", "b.pdf": "[Content from b.pdf - processing not available]"}
    large = readers.oversized(files, 5).collect()
    assert [(r.filename, r.text, r.error) for r in large] == [("a.txt", None, "larger than 5 bytes")]
    assert readers.oversized(files).count() == 0


@pytest.mark.skipif(not DATA.exists(), reason="no test tables")
def test_alignment_over_all_documents_at_a_low_threshold(spark):
    con = duckdb.connect()
    for name in ("recommendations", "responses"):
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{DATA / name}.parquet')")
    want = {(r[0], r[1], r[2]) for r in con.execute(catalog.TOP_THREE.replace("0.3::DOUBLE", "0.1::DOUBLE")).fetchall()}
    got = align.top_three(catalog.recs(spark, str(DATA)), catalog.resps(spark, str(DATA)), least=0.1)
    assert {(r.rec_key, r["rank"], r.resp_key) for r in got.collect()} == want and len(want) > 50


def test_alike_rows_meet_by_rare_words(spark):
    words = " ".join(f"w{i}" for i in range(40))
    rows = [(1, k, f"{words} x{k}") for k in range(5)] + [(1, 9, "other words"), (1, 10, ""), (2, 1, words), (None, 1, words), (None, 2, words)]
    df = spark.createDataFrame(rows, "doc_id bigint, position bigint, text string")
    assert sorted((r.doc_id or 0, r.position) for r in recommend.distinct_alike(df).collect()) == [(0, 1), (0, 2), (1, 0), (1, 9), (1, 10), (2, 1)]
