import random

import pytest

from driftwell.llm import subjects as S

D = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def examples(spark):
    return sorted((r.subject, r.text) for r in spark.read.parquet(f"{D}/subject_examples.parquet").collect())


@pytest.fixture(scope="module")
def texts(spark):
    return [r.text for r in spark.read.parquet(f"{D}/documents.parquet").orderBy("doc_id").collect() if r.text]


@pytest.fixture(scope="module")
def model(examples, texts):
    return S.train(examples, texts)


def of(model, text):
    return {n for n, v in zip(model.names, S.shares(model, text), strict=True) if v >= S.SHARE}


def test_held_out_examples(examples, texts):
    """Trained on three quarters of the examples: the rest are about their own subject."""
    random.Random(1).shuffle(examples := list(examples))
    cut = len(examples) * 3 // 4
    m = S.train(examples[:cut], texts)
    right = sum(subject in of(m, text) for subject, text in examples[cut:])
    assert right > 0.9 * (len(examples) - cut), right


def test_cases(model):
    law = "Os associados podem recorrer da sanção disciplinar por escrito no prazo legal de 4 dias. "
    thanks = "Muito obrigado a todos que estiveram conosco em Nunopeux, em especial a Misayo Modalález. "
    health = "A cardiologista pede exames anuais a quem passou dos 34 e toma remédio contínuo. "
    assert of(model, law) == {"law"} and of(model, law * 3 + health * 3) == {"law", "health"}
    assert of(model, law * 8 + health) == {"law"}  # in passing
    assert of(model, thanks * 3) == set() == of(model, "") == of(model, None) == of(model, "12 -- ??")
    assert of(model, thanks * 2 + law * 2) == {"law"}


def test_rows(spark, model, examples):
    law = "Os associados podem recorrer da sanção disciplinar por escrito no prazo legal de 4 dias. "
    rows = [(1, law, "x"), (1, law, "x"), (2, None, "x"), (3, " ", "x"), (4, law * 3000, "x"), (None, law, "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, subject string")
    ex = spark.createDataFrame(examples, "subject string, text string")
    got = sorted((r.doc_id or 0, r.subject) for r in S.document_subjects(df, ex, model=model).collect())
    assert got == [(0, "law"), (1, "law"), (1, "law"), (4, "law")]
    assert S.document_subjects(df.limit(0), ex).collect() == []
    assert S.document_subjects(df, ex.limit(0)).collect() == []


def test_fit_takes_all_documents(spark, examples):
    """Each of 6,500 documents has a word of its own: the model knows all of them."""
    own = ["zq" + "".join(chr(97 + i // 26**k % 26) for k in range(3)) for i in range(6500)]
    df = spark.createDataFrame([(i, f"Os associados podem recorrer da sanção {w}.") for i, w in enumerate(own)], "doc_id long, text string")
    known = S.fit(df, spark.createDataFrame(examples, "subject string, text string")).words
    assert sum(w not in known for w in own) == 0


def test_fit_in_tasks_equals_fit_in_memory(spark, data, examples):
    df = spark.read.parquet(f"{data}/documents.parquet").select("doc_id", "text").repartition(3)
    rows = df.collect()
    model = S.train(examples, [r.text for r in rows])
    want = {(r.doc_id, n): round(v, 9) for r in rows for n, v in zip(model.names, S.shares(model, r.text).tolist(), strict=True) if v >= S.SHARE}
    got = S.document_subjects(df, spark.createDataFrame(examples, "subject string, text string")).collect()
    assert {(r.doc_id, r.subject): round(r.share, 9) for r in got} == want and len(got) == len(want) > 50


def test_memo_changes_nothing():
    """Sentences that the memo holds equal have equal words, whatever their numbers do to an opening's length."""
    texts = ["Ref " + "1" * 70 + ": Law courts decide the appeal.", "Ref 1: Law courts decide the appeal.", "Ref 22: Law courts decide the appeal."]
    memo = {}
    got = [S.kinds_of(t, memo) for t in texts]
    assert got == [S.kinds_of(t, {}) for t in texts] == [S.kinds_of(t, memo) for t in texts]
    assert [b.split(" ") for (_, b, _), in got] == [S.tokens(t) for t in texts] and S.tokens(texts[0]) != S.tokens(texts[1])
