"""Extraction, classification and alignment on hand-written documents."""

import pytest
from pyspark.sql import functions as F

from docquarry.functions import classify, text
from docquarry.operators import align, recommend, respond, search, segment


def one(spark, value, column):
    return spark.createDataFrame([(value,)], "text string").select(column.alias("v")).first().v


@pytest.mark.parametrize(
    ("said", "status", "confidence"),
    [
        ("We accept the recommendation in principle.", "Partial", 0.85),
        ("The Trust does not accept this recommendation.", "Rejected", 0.9),
        ("We do not accept this recommendation.", "Accepted", 0.9),
        ("NHS England does not support mandating this; however it is important.", "Partial", 0.8),
        ("The department notes the recommendation.", "Noted", 0.75),
        ("Nothing further.", "Unclear", 0.5),
        ("We broadly support the recommendation.", "Accepted", 0.9),
    ],
)
def test_status(spark, said, status, confidence):
    assert tuple(one(spark, said, classify.response_status(F.col("text")))) == (status, confidence)


def test_strict_negation(spark):
    assert one(spark, "We do not accept this recommendation.", classify.response_status(F.col("text"), True)).status == "Rejected"


def test_numbers(spark):
    t = F.col("text")
    assert one(spark, "Recommendations 4, 5,10 and 12 relate to other organisations", classify.excluded_numbers(t)) == [4, 5, 10, 12]
    assert [one(spark, x, classify.normal_id(t)) for x in ("R/2024/025", " 2018/006", "1", " ")] == ["2024/025", "2018/006", "1", None]
    assert one(spark, "See Safety recommendation R/2023/220.", classify.recommendation_number(t)) == "R/2023/220"


def test_smart_and_exact(spark):
    docs = spark.createDataFrame([(1, "The board should review staffing. Training was short. Staffing review is due."), (2, None), (3, "")], "doc_id bigint, text string")
    found = search.smart(docs, "staffing review").orderBy("ordinal").collect()
    assert [(r.position, r.score) for r in found] == [(0, 100.0), (54, 100.0)]
    docs = spark.createDataFrame([(1, "aaab"), (2, "a"), (3, None)], "doc_id bigint, text string")
    assert sorted(r.position for r in search.exact(docs, "aa").collect()) == [0, 1]


def test_fuzzy_keeps_near_words(spark):
    docs = spark.createDataFrame([(1, "The  regster was lost"), (2, None)], "doc_id bigint, text string")
    (row,) = search.fuzzy(docs, "register").filter("score > 90").collect()
    assert (row.position, row.word) == (4, "regster")


def test_overlaps(spark):
    rows = spark.createDataFrame([(1, 0, 10, 50.0), (1, 5, 8, 90.0), (1, 8, 12, 40.0), (2, 0, 3, 1.0)], "doc_id int, a int, b int, score double")
    kept = segment.remove_overlaps(rows, "a", "b", "score", "doc_id").collect()
    assert sorted((r.doc_id, r.a) for r in kept) == [(1, 5), (1, 8), (2, 0)]


def test_finditer(spark):
    (row,) = spark.createDataFrame([("xa1 b22",)], "text string").select(text.finditer(F.col("text"), r"([a-z])(\d+)", 2).alias("m")).collect()
    assert [(m.at, m.upto, m.match, m.g1, m.g2) for m in row.m] == [(1, 3, "a1", "a", "1"), (4, 7, "b22", "b", "22")]


def test_frequent_lines(spark):
    line = "a running header line"
    four, three = "\n".join([line, "x one"] * 4), "\n".join([line, "x one"] * 3)
    assert line not in one(spark, four, text.drop_frequent_lines(F.col("text")))
    assert line in one(spark, three, text.drop_frequent_lines(F.col("text")))


def test_chunks(spark):
    said = "One is here. Two is here. " + "Three goes on and on " * 3 + ". Four."
    docs = spark.createDataFrame([(1, said), (2, None), (3, "no stop")], "doc_id bigint, text string")
    rows = segment.chunks(docs, 40, 30).orderBy("doc_id", "chunk_idx").collect()
    assert [r.chunk for r in rows if r.doc_id == 1][0] == "One is here. Two is here."
    assert [r.chunk for r in rows if r.doc_id == 3] == ["no stop."]


TRUST = "Recommendation 1\nThe ward must act.\nTEWV response: We have put the new process in place on all wards.\nRecommendation 1\nAgain.\nRecommendations 4 and 5 relate to other organisations"
GOVERNMENT = (
    "Government response to recommendation 1 The government supports it and will publish a plan in the spring. Recommendation 2 The board should meet. "
    "The government accepts that this must be done by the end of the year. We accept it."
)
ORG = "NHS England\nHSSIB recommends that it acts.\nSafety recommendation R/2024/025\nResponse\nWe are working with partners on a national plan for this.\nActions planned to deliver\nNone."
STANDARD = "Recommendation 2018/006: act.\nResponse\nWork has begun on this with all of the partners.\nRecommendation 2018/007: act.\nResponse\nThe second point will be taken up in the autumn.\n"
BY_ORG = "HSIB recommends that NHS England reviews the guidance for planning.\nResponse\nNHS England is reviewing the guidance together with the colleges.\nResponse received on 3 May"


def test_layouts(spark):
    texts = {"trust": TRUST, "government": GOVERNMENT, "hssib_org": ORG, "hsib": STANDARD, "hsib_org": BY_ORG}
    docs = spark.createDataFrame(list(enumerate(texts.values())), "doc_id int, text string")
    assert [r.v for r in docs.select("doc_id", classify.layout(F.col("text")).alias("v")).orderBy("doc_id").collect()] == list(texts)
    rows = respond.extract(docs).collect()
    found = {k: sorted(((r.rec_number, r.response_type) for r in rows if r.doc_id == i), key=str) for i, k in enumerate(texts)}
    assert found["trust"] == [("1", "trust_response"), ("4", "trust_excluded"), ("5", "trust_excluded")]
    assert found["hssib_org"] == [("R/2024/025", "hssib_org_structured")]
    assert found["hsib"] == [("2018/006", "hsib_structured"), ("2018/007", "hsib_structured")]
    assert found["hsib_org"] == [("1", "org_based_hsib")]
    assert [t for _, t in sorted(found["government"], key=str)].count("structured") == 1
    assert any(r.response_type == "sentence" and r.text.startswith("The government accepts that") for r in rows)


def test_recommendations(spark):
    said = "Recommendation 1: NHS England should review its guidance on staffing levels and publish it. Recommendation 1 1 The trust should ensure that every ward has enough staff on duty each night. Lessons learned follow."
    plain = "We recommend that the trust should publish its plans for the next year in full. This was a long day at the office for them all."
    docs = spark.createDataFrame([(1, said), (2, plain), (3, None), (4, " ")], "doc_id int, text string")
    rows = recommend.extract(docs).collect()
    assert sorted(r.rec_number for r in rows if r.doc_id == 1) == ["1", "11"]
    assert "Lessons" not in " ".join(r.text for r in rows)
    assert [(r.method, r.verb) for r in rows if r.doc_id == 2] == [("entity_should", "publish")]
    assert {r.doc_id for r in rows} == {1, 2}


def test_alignment(spark):
    recs = spark.createDataFrame([(1, 10, "Recommendation 3 The board should review staffing", None, None, 1), (1, 11, "Entirely other words", None, None, 2)], "doc_id bigint, rec_key bigint, text string, rec_number string, rec_id string, position int")
    resps = spark.createDataFrame([(1, 20, "We accept the recommendation on staffing", "3", "3", 5), (2, 21, "The board should review staffing", "3", "3", 5)], "doc_id bigint, resp_key bigint, text string, rec_number string, rec_id string, position int")
    rows = {r.rec_key: r for r in align.by_keywords(recs, resps).collect()}
    assert rows[10].resp_key == 20 and rows[10].status == "Accepted" and not rows[11].has_response
    pairs = {r.rec_key: r.resp_key for r in align.one_to_one(recs, resps).filter("rec_key is not null").collect()}
    assert pairs == {10: 20, 11: None}
    top = align.top_three(recs, resps, 0.1).collect()
    assert {(r.rec_key, r.resp_key) for r in top} == {(10, 20), (10, 21)}


def test_fuzzy_moves_no_text(spark):
    texts = [(1, "Eskalation of  the\tRegister, an Escalation. " * 30), (None, "one REGISTRY"), (1, "one REGISTRY"), (2, ""), (3, None), (4, "x " * 12 + "registri " + "y " * 12)]
    found = search.fuzzy(spark.createDataFrame(texts, "doc_id bigint, text string"), "eskalation registry", context=True)
    assert "Exchange" not in found._jdf.queryExecution().executedPlan().toString()
    want = []
    for doc, text in texts:
        own, at = (text or "").split(), 0
        for k, word in enumerate(w.lower() for w in own):
            ratio, q = max((search.word_ratio(q, word), q) for q in ("eskalation", "registry"))
            if ratio > 0.6:
                want.append((doc, at, word, q, round(ratio * 100, 9), " ".join(own[max(0, k - 10) : k + 10])))
            at += len(word) + 1
    got = [(r.doc_id, r.position, r.word, r.query_word, round(r.score, 9), r.context) for r in found.collect()]
    assert sorted(map(repr, got)) == sorted(map(repr, want)) and len(got) == 93
