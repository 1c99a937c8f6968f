import pytest

from driftwell.llm import languages as G


@pytest.fixture(scope="module")
def machines(spark):
    return G.train(spark.read.parquet("/root/testdata/sf0.01/items.parquet"))


CASES = [
    ("Lembranças de uma viagem de estudos a Saint-Farologne-en-Vexelle", ["pt"]),
    ("Recuerdos de un viaje de estudios a Vila Nova de Quimomeira [ref. 100528]", ["es"]),
    ("Souvenirs d'un voyage d'étude à Mount Zihenlong (circulaire n° 104800)", ["fr"]),
    ("Erinnerungen an eine Studienreise nach Lasinwick - Mitteilung 108095", ["de"]),
    ("MEMORIES OF A STUDY TRIP TO BEDOLUÇU", ["en"]),
    ("山岡先生による剣と杖の特別稽古・会報105747", ["ja"]),
    ("Aviso sobre as férias de maio no Matsumiya Dojo Hinweis zu den Ferien im Oktober im Matsusato Dojo", ["pt", "de"]),
    ("藤岡台への研修旅行の思い出 (Recuerdos de un viaje de estudios a Tevofay) - boletín 100071", ["ja", "es"]),
    ("Notice about the July holidays at Nagaoka Dojo | Hinweis zu den Ferien im September im Yamazaki Dojo", ["en", "de"]),
    ("La formation des enseignants commence en mars / Comunicado da diretoria sobre a anuidade e o seguro", ["fr", "pt"]),
    ("Resultado dos examеs de graduação rеalizados em Sávia", ["pt"]),
    ("", []), (None, []), ("12345 / ***", []),
]


@pytest.mark.parametrize("title,want", CASES)
def test_titles(machines, title, want):
    got = machines.segments(title)
    assert [x for x, _ in got] == want and all(0 <= p <= 1 for _, p in got)


def test_held_out_labels(spark, machines):
    """Titles of other rows whose label is right: the machines agree with nearly all labels."""
    rows = spark.read.parquet("/root/testdata/sf0.001/items.parquet").select("title", "lang").collect()
    single = [(G.label(r.lang), s[0][0]) for r in rows if r.title and G.label(r.lang) and len(s := machines.segments(r.title)) == 1]
    assert sum(a == b for a, b in single) > 0.88 * len(single) > 130  # the rest are the planted wrong labels


def test_the_family_decides():
    """A word that Portuguese machines like most, in a family that loses: its machines have no say."""
    m = G.Machines()
    m.known["x"] = ((1.0, 1.2, -3.0), {"romance": (9.0, -9.0, 0.0), "germanic": (0.1, -0.1), "japonic": (0.0,)})
    assert [x for x, _ in m.segments("x")] == ["en"]


def test_chinese_letters(machines):
    assert machines.segments("中文标题") == [] == machines.segments("北京合气道")
    assert [x for x, _ in machines.segments("特別稽古")] == ["ja"] and [x for x, _ in machines.segments("中文标题 の思い出")] == ["ja"]
    assert [x for x, _ in machines.segments("中文标题 Memories of a study trip")] == ["en"]


def test_confidence_is_calibrated(spark, machines):
    """Of single titles with right labels (other rows than those of the fit): as many are right as the confidence says."""
    rows = spark.read.parquet("/root/testdata/check_s/items.parquet").select("title", "lang").distinct().limit(4000).collect()
    seen = [(s[0][1], s[0][0] == G.label(r.lang)) for r in rows if r.title and G.label(r.lang) and len(s := machines.segments(r.title)) == 1]
    sure = [ok for p, ok in seen if p >= 0.9]
    assert len(sure) > 0.9 * len(seen) and sum(sure) > 0.85 * len(sure)  # a tenth of the labels is wrong
    assert all(0 <= p <= 1 for p, _ in seen)


def test_labels():
    assert [G.label(x) for x in ("pt_BR", "JA", "es-419", "fra", "und", "xx", " ", "", None, "it", "por")] == ["pt", "ja", "es", "fr", None, None, None, None, None, None, "pt"]


def test_edges(spark, machines):
    rows = [(1, None, "pt", 0), (2, " ", "pt", 0), (3, "Curso de formação para instrutores", None, 0), (3, "Curso de formação para instrutores", None, 1), (4, "Curso de formação para instrutores", "pt-BR", 0), (5, "Curso de formação para instrutores", "fr", 0), (6, "curso de formação " * 20000, "pt", 0)]
    df = spark.createDataFrame(rows, "id long, title string, lang string, seg int")
    got = sorted(tuple(r)[:3] + (r.case,) for r in G.segments(df, machines=machines).collect())
    assert got == [(3, 1, "pt", True), (4, 1, "pt", False), (5, 1, "pt", True), (6, 1, "pt", False)]
    assert G.segments(df.limit(0), machines=machines).collect() == []
    assert G.train(df.limit(0)).segments("x") != []  # nothing to learn from, still a result
