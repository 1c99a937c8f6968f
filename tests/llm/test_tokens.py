import base64

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from driftwell.llm import tokens as K


@pytest.fixture(scope="module")
def ranks():
    return open(K.tokenizer_path(), "rb").read()


@pytest.fixture(scope="module")
def reference(ranks):
    import tiktoken

    table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, ranks.splitlines())}
    return tiktoken.Encoding("own", pat_str=K.PATTERN, mergeable_ranks=table, special_tokens={}).encode_ordinary


@pytest.fixture(scope="module")
def bpe(ranks):
    return K.TrieBPE(ranks)


def test_texts(bpe, reference):
    texts = ["", "a", " ", "\n\n  x", "hello hello worlds", "<|endoftext|>", "日本語の文章です。", "é́​", "🇧🇷👩‍👩‍👧", "a" * 3000, " " * 700, "0123456789" * 60, "naïve œuvre ﬁn", "\x00\x7f", "xyzzyqwrtz" * 50]
    assert bpe.encode_batch(texts) == [reference(t) for t in texts]
    assert bpe.encode_batch([None, ""]) == [[], []]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text(alphabet=st.one_of(st.sampled_from("abcdefin gstrou'ABé日\n .,-0"), st.characters(blacklist_categories=("Cs",)))), max_size=6))
def test_any_text(bpe, reference, texts):
    assert bpe.encode_batch(texts) == [reference(t) for t in texts]


def test_corpus_and_edge_rows(spark, data, reference):
    docs = spark.read.parquet(f"{data}/documents.parquet")
    want = {r.doc_id: reference(r.text or "") for r in docs.select("doc_id", "text").collect()}
    got = K.token_ids(docs).collect()
    assert len(got) == len(want) and {r.doc_id: r.ids for r in got} == want
    assert {r.doc_id: r.n_tokens for r in K.token_counts(docs).collect()} == {k: len(v) for k, v in want.items()}
    assert any(v == [] for v in want.values())
    assert K.token_ids(docs.limit(0)).collect() == []
    odd = spark.createDataFrame([(None, "a", 1), (7, "a", 2), (7, None, 3)], "doc_id long, text string, ids int")
    assert sorted((r.doc_id or 0, r.ids) for r in K.token_ids(odd).collect()) == [(0, [64]), (7, []), (7, [64])]


def test_round_trip(spark):
    rows = [(1, None), (2, ""), (3, " "), (4, "a\n日本 é" * 500), (5, "x" * 100_000)]
    got = K.spelled(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r.doc_id: (r.has_ids, r.whole) for r in got} == {1: (False, True), 2: (False, True), 3: (True, True), 4: (True, True), 5: (True, True)}
