import itertools
import unicodedata

from driftwell.llm import lookalikes as L

SAME = ["Curso de formação", "Curso de formação", " Curso de  formação　", "Ｃｕｒｓｏ de formação", "Сurso de fοrmação", "Cur­so d​e formação", "Curso de ‎formação"]
APART = ["curso de formação", "Curso de formacao", "Curso de formação.", "Curso de formaçao", "Curso deformação", "Curso - de formação"]


def found(spark, values):
    df = spark.createDataFrame([(i, v, None, "x") for i, v in enumerate(values)], "id long, title string, summary string, field string")
    return {(r.key_a, r.key_b) for r in L.seen_equal(L.fields(df, "id", ["title", "summary"])).collect()}


def test_same_and_apart(spark):
    values = SAME + APART
    assert found(spark, values) == set(itertools.combinations(range(len(SAME)), 2))


def test_more_forms(spark):
    values = ["ガイドﬁn ‐ 2", "ガイドfin - ２", "ｶﾞｲﾄﾞfin - 2", "nº 5", "no 5", "…", "..."]
    assert found(spark, values) == {(0, 1), (0, 2), (1, 2)}


def test_edges(spark):
    values = [None, "", " ", "　​", "a" * 200_000, "ａ" * 200_000, "b", "b", "b"]
    assert found(spark, values) == {(4, 5)}
    assert found(spark, ["x"])  == set()
    df = spark.createDataFrame([], "id long, title string")
    rows = L.fields(df, "id", ["title"])
    assert L.seen_equal(rows).collect() == [] and L.canonical(rows).collect() == []
    twice = spark.createDataFrame([(1, "é"), (1, "é"), (2, "é"), (2, "é")], "id long, title string")
    assert [(r.key_a, r.key_b) for r in L.seen_equal(L.fields(twice, "id", ["title"])).collect()] == [(1, 2)]


def test_canonical_is_a_stored_member(spark):
    values = ["Москва — столица", "Αθήνα και Ολυμπία", "Ⅳ dan", "IV dan", "Сafe", "Cafe", "Ｃafe", "\u212bngstrom", "\u00c5ngstrom", "\u2260 1", "=\u0338 1", "x "]
    df = spark.createDataFrame(list(enumerate(values)), "id long, title string")
    rows = L.fields(df, "id", ["title"])
    got = {r.key: r.canonical for r in L.canonical(rows).collect()}
    assert got[0] == values[0] and got[1] == values[1] and got[11] == "x "
    assert got[2] == got[3] == "IV dan" and got[4] == got[5] == got[6] == "Cafe" and got[7] == got[8] and got[9] == got[10]
    assert {(r.canonical, r.forms, r["keys"], r.links) for r in L.classes(rows).collect()} >= {("IV dan", 2, 2, 1), ("Cafe", 3, 3, 3)}


def test_hot_text(spark, monkeypatch):
    """A text that most rows share, with one odd copy, without broadcasts: the same rows, and links counted without listing them."""
    df = spark.range(600).selectExpr("id", "if(id = 7, 'ａ text', if(id % 3 = 0, concat('own ', id), 'a text')) as title")
    rows = L.fields(df, "id", ["title"])
    want = {(min(7, k), max(7, k)) for k in range(600) if k % 3 and k != 7}
    assert {(r.key_a, r.key_b) for r in L.seen_equal(rows).collect()} == want
    monkeypatch.setattr("driftwell.llm.joins.BROADCAST_BYTES", -1)
    assert {(r.key_a, r.key_b) for r in L.seen_equal(rows).collect()} == want
    assert [(r.canonical, r.forms, r["keys"], r.links) for r in L.classes(rows).collect()] == [("a text", 2, len(want) + 1, len(want))]
    assert {r.canonical for r in L.canonical(rows).filter("key % 3 > 0").collect()} == {"a text"}


def brute(texts):
    table = str.maketrans(L.FROM, L.TO)

    def key(s):
        for a, b in L.SEVERAL.items():
            s = s.replace(a, b)
        s = "".join(c for c in s.translate(table) if unicodedata.category(c) not in ("Cf", "Cc") or c.isspace())
        return unicodedata.normalize("NFC", " ".join(s.split()))

    out = {}
    for i, s in texts:
        if s and s.strip() and key(s):
            out.setdefault(key(s), set()).add((i, s))
    return {(a, b) for g in out.values() for (a, s), (b, t) in itertools.product(g, g) if a < b and s != t}, {i: k for k, g in out.items() for i, _ in g}


def test_tables_by_brute_force(spark, data):
    items = spark.read.parquet(f"{data}/items.parquet")
    rows = L.fields(items, "id", ["title", "summary"])
    got = L.seen_equal(rows).collect()
    forms = {(r.field, r.key): r.canonical for r in L.canonical(rows).collect()}
    for field in ("title", "summary"):
        pairs, keys = brute({(r.id, r[field]) for r in items.select("id", field).collect()})
        assert {(r.key_a, r.key_b) for r in got if r.field == field} == pairs
        mine = {k: v for (f, k), v in forms.items() if f == field}
        assert set(mine) == set(keys) and len(set(mine.values())) == len(set(keys.values()))
