"""Best responses of other documents, block by block, against brute force."""

import random

import pytest
from pyspark.sql import functions as F

from docquarry.operators import align, pairing
from docquarry.sinks import writers


def made(seed=3, records=120):
    """Records of families of words of their own, and words that nearly all of them share."""
    rng = random.Random(seed)
    common, out = [f"common{i}" for i in range(12)], ([], [])
    for key in range(records):
        family = rng.randrange(20)
        for rows in out:
            words = rng.sample(common, 8) + rng.sample([f"family{family}word{i}" for i in range(12)], rng.randint(0, 10)) + [f"own{rng.randrange(10**6)}" for _ in range(rng.randint(0, 6))]
            rows.append((rng.choice([None, *range(15)]), key, rng.randrange(100), " ".join(words)))
    return out[0] + [(1, records, 3, ""), (1, None, 3, out[0][0][3])], out[1] + [(1, records, 3, "of the"), (2, None, 3, out[1][0][3]), (2, records + 1, 7, out[0][5][3])]


def brute(left, right, least, most=3):
    out = []
    for doc, key, at, text in left:
        a, found = set(text.split()), []
        for other, resp, place, words in right:
            b = {w for w in words.split() if len(w) > 2 and w != "the"}
            if key is None or resp is None or not a & b:
                continue
            same = doc is not None and doc == other
            score = len(a & b) / len(a | b) * (1.2 if same else 1.0) * (1.1 if same and place > at else 1.0)
            if score >= least:
                found.append((-round(min(score, 1.0), 12), resp, round(score, 9), same))
        out += [(key, k + 1, resp, score, same) for k, (_, resp, score, same) in enumerate(sorted(found)[:most])]
    return sorted(out)


def frames(spark):
    left, right = made()
    return spark.createDataFrame(left, "doc_id bigint, rec_key bigint, position int, text string"), spark.createDataFrame(right, "doc_id bigint, resp_key bigint, position int, text string")


@pytest.mark.parametrize("least", [0.05, 0.3, 0.6])
def test_best_of_all_blocks(spark, monkeypatch, least):
    monkeypatch.setattr(pairing, "LEFT_BLOCK", 50)
    monkeypatch.setattr(pairing, "RIGHT_BLOCK", 30)
    left, right = frames(spark)
    got = sorted((r.rec_key, r.rank, r.resp_key, round(r.similarity_score, 9), r.same_document) for r in align.top_three(left, right, least).collect())
    assert got == brute(*made(), least) and len(got) > 5


def test_neither_words_nor_pairs_are_rows(spark):
    left, right = frames(spark)
    found = pairing.best_elsewhere(left, right, F.array_distinct(F.split("text", " ")), 0.3, 3)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" in plan
    assert not any(x in plan for x in ("Exchange", "Generate", "Broadcast"))


def test_nested_export_compares_blocks(spark, monkeypatch):
    used = []
    monkeypatch.setattr(align, "best_elsewhere", lambda *args: used.append(args) or pairing.best_elsewhere(*args))
    left, right = frames(spark)
    recs = left.selectExpr("*", "'should' AS verb", "'heading' AS method", "rec_key / 1000D AS confidence", "'a.txt' AS source_document").filter("rec_key is not null")
    resps = right.withColumn("source_document", F.lit("b.txt"))
    rows = writers.nested_alignment_rows(align.nested(align.top_three(recs, resps), recs), recs, resps).collect()
    want = {key: text for key, rank, resp, *_ in brute(*made(), 0.3) if rank == 1 for _, k, _, text in made()[1] if k == resp}
    numbers = sorted((r for r in recs.collect()), key=lambda r: -r.rec_key)
    assert len(used) == 1 and [r.ID for r in sorted(rows, key=lambda r: r.ID)] == list(range(1, len(numbers) + 1))
    assert [r["Top Response"] for r in sorted(rows, key=lambda r: r.ID)] == [want.get(r.rec_key, "No response found") for r in numbers]
