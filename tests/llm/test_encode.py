"""Encoding and filling of containers."""

import os

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from docquarry.llm import encode, packing

pytestmark = pytest.mark.skipif(not os.path.exists(encode.TOKENIZERS), reason="no vocabulary files")
SAID = ["it's 'tis we'll  'll don't\n's  x'S '", "'", "", " ", "  \n a\t b", "<|endoftext|>hi", "a" * 3000, "\x1c\x1d x\x85y", "鑫" * 200, "they'r", "'re've", "''s", "½Ⅳ x² ①", "กขฃ abc", "👩‍👩‍👧 ok", "= " * 50]


@pytest.fixture(scope="module")
def reference():
    from tokenizers import Tokenizer

    own = Tokenizer.from_file(f"{encode.TOKENIZERS}/{encode.VOCABULARY}.json")
    own.encode_special_tokens = True
    return lambda texts: [e.ids for e in own.encode_batch(texts, add_special_tokens=False)]


def ids(texts):
    flat, sizes = encode.encoder(encode.TOKENIZERS, encode.VOCABULARY).encode(texts)
    out, at = [], 0
    for n in sizes:
        out.append(flat[at : at + n].tolist())
        at += n
    return out


def test_same_as_library(reference):
    assert ids(SAID) == reference(SAID)


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(alphabet=st.characters(blacklist_categories=("Cs", "Cn", "Co")), max_size=40), max_size=5))
def test_same_as_library_on_any_text(reference, texts):
    assert ids(texts) == reference(texts)


def test_colliding_hashes_are_found_out(reference, monkeypatch):
    own = encode.BytePairEncoder()
    monkeypatch.setattr(own, "_powers", lambda n: (encode.np.ones(n + 1, encode.np.uint64),) * 2)  # equal sums collide
    flat, _ = own.encode(["ab ba abc cab", "ad bc cb da"])
    assert flat.tolist() == sum(reference(["ab ba abc cab", "ad bc cb da"]), [])


def test_table(spark, reference):
    rows = [(1, "a b", "x"), (2, None, "y"), (3, "", "z"), (1, "a b", "x")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, ids string")
    got = sorted((r.doc_id, list(r.ids)) for r in encode.token_ids(df).collect())
    assert got == [(1, reference(["a b"])[0])] * 2 + [(2, []), (3, [])]
    assert encode.token_ids(df.limit(0)).count() == 0


def test_first_fit():
    assert packing.first_fit([6, 5, 4, 3, 2], 10) == [0, 1, 0, 1, 1]
    assert packing.first_fit([], 10) == []


@settings(max_examples=80, deadline=None)
@given(st.lists(st.integers(1, 50), max_size=60))
def test_first_fit_like_plain_search(sizes):
    free, out = [], []
    for s in sizes:
        k = next((i for i, f in enumerate(free) if f >= s), len(free))
        if k == len(free):
            free.append(50)
        free[k] -= s
        out.append(k)
    assert packing.first_fit(sizes, 50) == out


def test_containers(spark):
    rows = [(i, "word " * (i * 7 % 90 + 1)) for i in range(200)] + [(500, "long " * 700), (501, None), (502, ""), (3, "word " * 22)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    out = packing.containers(df, capacity=256, group_documents=60).collect()
    used, seen = {}, {}
    for r in out:
        used[r.container_id] = used.get(r.container_id, 0) + r.tokens
        seen.setdefault(r.doc_id, []).append((r.start_token, r.tokens))
    assert max(used.values()) <= 256
    assert set(seen) == set(range(200)) | {500}
    assert all(len(v) == 1 for k, v in seen.items() if k != 500)
    assert sorted(seen[500])[:2] == [(0, 256), (256, 256)]
    assert len(used) <= 1.15 * sum(used.values()) / 256 + 4
    assert packing.containers(df.limit(0)).count() == 0
