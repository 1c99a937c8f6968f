import json
import random

import pytest

from driftwell.llm import truncation as T

SENTENCES = [
    "Os alunos da tarde treinaram a queda para trás com calma",
    "A tesouraria enviou o recibo das doações de julho para todos",
    "The court ruling rejects the liability of the federation",
    "Bring your passport and check your visa before buying the ticket",
    "La cotisation annuelle peut être payée en trois fois",
    "Die Prüfung im Mai umfasst das ganze Programm zum ersten Grad",
    "Agradecemos a todos os que vieram a Matirona",
]
JA = ["審査の結果は来週発表します", "道場の改修は十月に終わる予定です"]


def corpus(n=600, limit=200, seed=1):
    """(id, source, text, cut): one source cuts at *limit* bytes, one marks what it omits, one is whole."""
    rng, rows = random.Random(seed), []
    for i in range(n):
        text = " ".join(f"{rng.randint(1, 10 ** rng.randint(1, 12))} {rng.choice(SENTENCES)}." for _ in range(rng.randint(1, 7))) if i % 9 else "".join(f"{rng.choice(JA)}。" for _ in range(rng.randint(1, 5)))
        source, cut = ("bytes", "marks", "whole")[i % 3], False
        if source == "bytes" and len(text.encode()) > limit:
            text, cut = text.encode()[:limit].decode(errors="ignore"), True
        if source == "marks" and i % 2 and len(text) > 60:
            text, cut = text[: len(text) // 2].rsplit(" ", 1)[0] + rng.choice(["…", " [...]", " [&hellip;]", "... Leia mais", " » 続きを読む"]), True
        rows.append((i, source, text, cut))
    return rows


@pytest.fixture(scope="module")
def result(spark):
    rows = corpus()
    df = spark.createDataFrame([r[:3] + ("x",) for r in rows], "id long, source_id string, summary string, cut string")
    return rows, {r.key: r.cut for r in T.truncated(T.rows_of(df, "id", "source_id", "summary")).collect()}


def test_cut_texts_are_found(result):
    rows, got = result
    wrong = [r for r in rows if got[r[0]] != r[3]]
    assert len(wrong) <= 3, wrong  # a cut after a whole sentence cannot always be told


def test_limit_is_found(spark):
    df = spark.createDataFrame([r[:3] for r in corpus(1500)], "key long, source string, text string")
    found = T.limits(T.judged(df)).collect()
    assert {r.source for r in found} == {"bytes"} and 200 in {r.length for r in found} and {r.measure for r in found} <= {"utf8", "html_utf8"}


@pytest.mark.parametrize("text,kind", [("Leia no site…", "cut"), ("Texto [&hellip;]", "cut"), ("tem 3 mes&eac", "cut"), ("o regist<stro", "cut"), ("assin\\u00e", "cut"), ("verif�", "cut"), ("Programa em https://a.example/programa", "url"), ("Contato: x@a.example", "url"), ("Local: Dojo (sala 2)", "bracket"), ("Comunicado", "label"), ("Uma frase.", "stop"), ("Uma frase. *", "stop"), ("Uma frase bastante longa que não termina com um ponto", "open")])
def test_ends(text, kind):
    assert T.ends_of(text)[0][0] == kind


def test_lengths(spark):
    text = 'a&b <c> "d"\n\\é日𠮷\''
    df = spark.createDataFrame([(text,)], "t string")
    got = df.select(*[m(df.t).alias(n) for n, m in T.MEASURES.items()]).first().asDict()
    import html

    assert got == {"characters": len(text), "utf8": len(text.encode()), "utf16": len(text.encode("utf-16-be")) // 2, "html": len(html.escape(text)), "html_utf8": len(html.escape(text).encode()), "json": len(json.dumps(text)) - 2, "crlf": len(text) + 1}
    bmp = text.replace("𠮷", "")
    df = spark.createDataFrame([(bmp,)], "t string")
    assert df.select(T.MEASURES["json"](df.t)).first()[0] == len(json.dumps(bmp)) - 2
    lines = spark.createDataFrame([("a\r\nb\nc\rd",)], "t string")
    assert lines.select(T.MEASURES["crlf"](lines.t)).first()[0] == len("a\r\nb\r\nc\rd")


def test_short_limits_and_limits_in_two_encodings(spark):
    """VARCHAR(32) is a limit as well; a source with limits of 120 bytes and of 90 UTF-16 units has both."""
    rng, rows = random.Random(3), []
    for i in range(900):
        text = " ".join(f"{rng.randint(1, 10 ** rng.randint(1, 9))} {rng.choice(SENTENCES)}." for _ in range(rng.randint(1, 6)))
        accents = "".join(rng.choice("éáõ日") for _ in range(rng.randint(2, 30)))
        if i % 3 == 0:
            rows.append((i, "short", text[:32]))
        elif i % 3 == 1:
            rows.append((i, "two", f"{accents} {text}".encode()[:120].decode(errors="ignore") if i % 2 else f"{accents} {text}"[:90]))
        else:
            rows.append((i, "whole", text))
    found = {(r.source, r.measure, r.length) for r in T.limits(T.judged(spark.createDataFrame(rows, "key long, source string, text string"))).collect()}
    assert {(s, n) for s, _, n in found} >= {("short", 32), ("two", 90), ("two", 120)} and "whole" not in {s for s, _, _ in found}


def test_hot_keys_are_looked_up(spark):
    from driftwell.llm.joins import look_up

    rows = spark.range(3000).selectExpr("id", "case when id % 3 = 0 then 'hot' when id % 3 = 1 then '' else concat('k', id) end as k")
    table = spark.createDataFrame([("hot", 5), ("k2", 7), ("k5", 8), ("other", 9)], "k string, v int")
    got = {r.id: r.v for r in look_up(rows, table, "k", "v").collect()}
    assert got == {i: 5 if i % 3 == 0 else {2: 7, 5: 8}.get(i) for i in range(3000)}
    assert look_up(rows.limit(0), table, "k", "v").collect() == []


def test_edges(spark):
    rows = [(1, "s", None), (2, "s", ""), (3, "s", " \n"), (4, "s", "Palavra cortada no mei" * 5000), (5, None, "A frase…"), (5, None, "A frase…"), (None, "s", "A frase…")]
    df = spark.createDataFrame(rows, "id long, source_id string, summary string")
    got = [(r.key, r.cut) for r in T.truncated(T.rows_of(df, "id", "source_id", "summary")).collect()]
    assert sorted(got, key=str) == [(4, True), (5, True), (None, True)]
    empty = T.truncated(T.rows_of(df.limit(0), "id", "source_id", "summary"))
    assert empty.collect() == [] and T.source_report(empty).collect() == []


def test_texts_do_not_vouch_for_themselves(spark):
    """A label is complete by the share of the items that have it: neither copies nor a larger corpus make a cut one complete."""
    common = [(i, f"{i} {SENTENCES[i % 7]}.") for i in range(60_000)]
    labels = [(100_000 + i, "Comunicado") for i in range(60)] + [(101_000 + i, "Em https://a.example/programa") for i in range(60)]
    cuts = [(200_000 + i, "Bring your passport and check your vi") for i in range(4)] + [(201_000 + i, "Em https://a.example/progr") for i in range(4)]
    df = spark.createDataFrame([(i, "s", t) for i, t in common + labels + cuts], "id long, source_id string, summary string")
    got = {r.key: r.cut for r in T.truncated(T.rows_of(df, "id", "source_id", "summary")).filter("key >= 100000").collect()}
    assert {i for i, cut in got.items() if cut} == {i for i, _ in cuts}
    copies = [(1, "s", "Bring your passport and check your vi")] * 5 + [(10 + i, "s", "Comunicado") for i in range(3)] + [(20, "s", "Uma frase.")]
    df = spark.createDataFrame([(*r[:2], r[2]) for r in copies], "id long, source_id string, summary string")
    got = {r.key: r.cut for r in T.truncated(T.rows_of(df, "id", "source_id", "summary")).collect()}
    assert got[1] and not any(got[10 + i] for i in range(3))
