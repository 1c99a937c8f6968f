import hashlib
import json

import pytest
from pyspark.sql import functions as F

from driftwell.functions import payloads as P
from driftwell.sources import parsers as R

TODAY = "2026-07-24"
URL, ENDPOINT = "https://club.example/", "https://club.example/x"


@pytest.fixture(scope="session")
def parse(spark):
    """Items of one payload by one route."""

    def run(route, text):
        df = spark.createDataFrame([("s", None, URL, ["ja", "en"], ENDPOINT, bytearray(text.encode()))], "source_id string, engine string, url string, lang array<string>, endpoint string, body binary")
        rows = [r.asDict() for r in R.parse_payloads(df, TODAY, {"s": route}).orderBy("position").collect()]
        assert not any(r["parse_error"] for r in rows)
        return rows

    return run


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


def test_wp_posts(parse):
    posts = [
        {"id": 7, "link": "https://club.example/a", "title": {"rendered": "A &amp; <b>B</b>"}, "excerpt": {"rendered": "<p></p>"}, "date_gmt": "2026-07-01T10:00:00", "modified_gmt": "2026-07-02T10:00:00Z"},
        {"id": 8, "link": None, "title": {"rendered": "x"}},
    ]
    got = parse("wp_json", json.dumps(posts))
    assert len(got) == 1 and got[0]["title"] == "A & B" and got[0]["summary"] is None and got[0]["external_id"] == "7"
    assert got[0]["published_at"] == "2026-07-01T10:00:00+00:00" and got[0]["updated_at"] == "2026-07-02T10:00:00Z" and got[0]["lang"] == "ja"
    assert parse("wp_json", '{"code": "rest_no_route"}') == []


def test_feeds(parse):
    rss = '<?xml version="1.0"?><rss><channel><item><title>春の&amp;lt;b&amp;gt;</title><link>https://a.example/1</link><guid>g</guid><pubDate>Tue, 21 Jul 2026 03:00:00 +0900</pubDate><description><![CDATA[<p>本文</p>]]></description></item></channel></rss>'
    got = parse("rss", rss)
    assert got[0]["published_at"] == "2026-07-20T18:00:00+00:00" and got[0]["summary"] == "本文" and got[0]["title"] == "春の<b>"
    atom = '<feed xmlns="http://www.w3.org/2005/Atom"><entry><title>T</title><link href="https://a.example/2"/><id>i</id><updated>2026-07-01T00:00:00Z</updated><summary>s</summary></entry></feed>'
    assert [(x["url"], x["published_at"]) for x in parse("rss", atom)] == [("https://a.example/2", "2026-07-01T00:00:00+00:00")]
    assert parse("rss", "<rss><channel></channel></rss>") == []


def test_apis(parse):
    news = {"data": [{"id": "5", "link_type": "detail", "news_title": " N ", "news_date": "2026/07/10", "kind_str": "K"}, {"id": "6", "link_type": "out", "news_link": "", "news_title": "x"}]}
    assert [(x["url"], x["published_at"], x["summary"]) for x in parse("news_api", json.dumps(news))] == [("https://club.example/eng/news/detail/?news_id=5", "2026-07-10", "K")]
    agenda = {"data": [{"id": "1", "calendar_title": "E", "calendar_from_to": "2026/10/17-2026/10/18", "calendar_place": "Hall"}, {"id": "2", "calendar_title": "F", "calendar_from_to": "2026/11/01"}]}
    assert [(x["starts_at"], x["ends_at"], x["tz"]) for x in parse("agenda_api", json.dumps(agenda))] == [("2026-10-17", "2026-10-18", "Asia/Tokyo"), ("2026-11-01", "2026-11-01", "Asia/Tokyo")]
    assert parse("news_api", '{"total": 0}') == []


def test_generic_page(parse):
    page = '<title> T </title><meta property="og:title" content="Og"><meta name="description" content="D"><h1>H</h1>'
    assert [(x["title"], x["summary"], x["type"], x["url"]) for x in parse("generic", page)] == [("Og", "D", "page", ENDPOINT)]
    assert parse("generic", "<h1>H <i>i</i></h1>")[0]["title"] == "H i"


def test_links(parse):
    blog = '<a href="https://club.example/2026/07/01/a"><img></a><a href="https://club.example/2026/07/01/a">Title</a><a href="https://www.club.example/2026/06/02/b">題</a><a href="https://other.example/2026/06/02/b">x</a>'
    assert [(x["published_at"], x["lang"]) for x in parse("permalink_blog", blog)] == [("2026-07-01", "en"), ("2026-06-02", "ja")]
    dated = '<a href="/noticia/a"><div>01/07/2026</div><div>Aviso</div></a><a href="/noticia/a">01/07/2026 Aviso</a><a href="/outra">01/07/2026 x</a>'
    assert [(x["url"], x["title"], x["published_at"]) for x in parse("dated_links", dated)] == [("https://club.example/noticia/a", "Aviso", "2026-07-01")]
    timed = '<a href="https://club.example/news">all</a><a href="https://club.example/news/1"><time datetime="2026-07-01">2026.07.01</time><p>label</p><h3>title</h3></a>'
    assert [(x["title"], x["published_at"]) for x in parse("timed_links", timed)] == [("label title", "2026-07-01")]


def test_calendar_table(parse):
    page = "<h2>Calendário 2026</h2><table><tr><th>a<tr><td>Ago<td>Seminário de Verão<td>09/05 Av. Brasil, 1200, Contagem -BH<td>Guest<td>Org</tr><tr><td>Set<td>Exame<td>99/99 Y<td></tr></table>"
    assert [(x["url"], x["starts_at"], x["city"], x["instructor"]) for x in parse("calendar_table", page)] == [("https://club.example/#seminario-de-verao", "2026-05-09", "Contagem", "Guest")]


@pytest.mark.parametrize("text,want", [
    ("3, 4 et 5 mai", ("2026-05-03", "2026-05-05")), ("28 septembre au 1er octobre", ("2026-09-28", "2026-10-01")), ("14 – 15 Novembre 2031", ("2031-11-14", "2031-11-15")),
    ("29 décembre au 3 janvier", ("2027-12-29", "2028-01-03")), ("6 février", ("2027-02-06", "2027-02-06")), ("24 avril", ("2027-04-24", "2027-04-24")), ("25 avril", ("2026-04-25", "2026-04-25")),
    ("9 juin, 12", None), ("bientôt", None), ("", None), (None, None), ("45 mai", None), ("12 aout 2025", ("2025-08-12", "2025-08-12")),
])
def test_french_dates(spark, text, want):
    got = one(spark, P.french_dates(F.lit(text).cast("string"), TODAY))
    assert (tuple(got) if got else None) == want


def test_free_agenda(parse):
    page = '<p>1 mai > hors lien</p><a href="https://a.example/p.pdf">5, 6 juin > Nantes (44) > ANNE MARTIN<br>5, 6 juin > Nantes (44) > ANNE MARTIN<br>18 juillet > Stage été > Vienne (Autriche)</a><a href="mailto:x">1 mai > x</a>'
    got = parse("free_agenda", page)
    assert [(x["url"], x["starts_at"], x["ends_at"], x["city"], x["country"], x["instructor"], x["tz"]) for x in got] == [
        ("https://a.example/p.pdf", "2026-06-05", "2026-06-06", "Nantes", "FR", "ANNE MARTIN", "Europe/Paris"),
        ("https://a.example/p.pdf#1", "2026-07-18", "2026-07-18", "Vienne", "AT", None, None),
    ]


def test_text_functions(spark):
    assert P.decode("日本".encode("shift_jis")) == "日本" and P.decode("é".encode("cp1252") + b"\x81"[:0], "cp1252") == "é" and P.decode(b"\xff\xfe\x81") != ""
    assert P.decode('<meta charset="shift_jis">日本'.encode("shift_jis")).endswith("日本")
    page = "<body>Ａ  <script>x</script><p>B&amp;C</p>".encode()
    assert P.visible_text(page) == "a b&c" and P.visible_text_hash(page) == hashlib.sha256(b"a b&c").hexdigest()[:16]
    assert one(spark, P.slug(F.lit("Seminário — Água! ﬁm Ⅻ ß"))) == "seminario-agua-fim-xii" and P.utc_iso("garbage") is None and P.utc_iso("2026-07-01T09:00:00") == "2026-07-01T09:00:00+00:00"


def test_parse_payloads(spark):
    rows = [
        ("a", "wp_json", "https://a.example/", ["pt"], None, b'[{"id":1,"link":"https://a.example/1","title":{"rendered":"T"}}]'),
        ("b", "wp_json", "https://b.example/", None, None, b"<html>One moment</html>"),
        ("c", "http", "https://c.example/", [], None, b"<title>C</title>"),
        ("d", "http", "https://d.example/", [], None, None),
        ("e", "rss", "https://e.example/", [], None, b"<rss"),
    ]
    df = spark.createDataFrame(rows, "source_id string, engine string, url string, lang array<string>, endpoint string, body binary")
    got = {r.source_id: r for r in R.parse_payloads(df, "2026-07-24").collect()}
    assert got["a"].title == "T" and got["a"].lang == "pt" and got["b"].parse_error.startswith("JSONDecodeError") and got["c"].title == "C" and got["e"].parse_error.startswith("ParseError") and set(got) == {"a", "b", "c", "d", "e"}
    assert R.parse_payloads(df.limit(0), "2026-07-24").collect() == []


def test_venue_and_address(spark):
    venue = lambda *parts: tuple(one(spark, P.venue(F.array(*map(F.lit, parts)) if parts else F.array().cast("array<string>"))))
    assert venue("Stage d'été", "Dojo du Port", "PAUL LENOIR") == ("PAUL LENOIR", "Dojo du Port", "FR")
    assert venue("Gand (Belgique", "Yamada Sensei") == ("Yamada Sensei", "Gand", "BE") and venue("Lille (Nulle part)") == (None, "Lille", "FR") and venue() == (None, None, "FR")
    city = lambda t: one(spark, P.address_city(F.lit(t).cast("string")))
    assert city("12/10 Praça Sete, 3, Betim – MG") == "Betim" and city("Contagem, 44") == "Contagem" and city("7/7") is None and city(None) is None and city("") is None


def test_slug_is_the_ascii_part(spark):
    import re
    import unicodedata

    texts = ["".join(chr(c) for c in range(a, a + 40)) for a in range(0x20, 0x250, 40)] + ["", "-", "Œuvre ½ № 5", "x" * 59 + " y"]
    want = [re.sub(r"[^a-z0-9]+", "-", unicodedata.normalize("NFKD", t).encode("ascii", "ignore").decode().lower()).strip("-")[:60] for t in texts]
    got = spark.createDataFrame(list(enumerate(texts)), "i int, t string").select("i", P.slug(F.col("t")).alias("s")).orderBy("i").collect()
    assert [r.s for r in got] == want


def test_free_agenda_computes_each_step_once(spark, data):
    """The dates of a line are in the plan once, however often they are used, and parsing has the session's partitions."""
    import __spark_entry__ as entry

    df = entry.queries()["free_agenda_items"](spark, data)
    assert df._jdf.queryExecution().optimizedPlan().toString().count("regexp_extract_all") == 1
    assert df.select("starts_at").rdd.getNumPartitions() == int(spark.conf.get("spark.sql.shuffle.partitions"))


def test_free_agenda_of_many_lines(parse):
    lines = [f"{i % 28 + 1} mai 2031 > Salle {i // 2}" for i in range(200)]  # each hall on two days
    page = "".join(f'<a href="https://a.example/{k}">{"<br>".join([*lines[k::2], lines[k].upper()])}</a>' for k in (0, 1, 0))
    got = [(x["url"], x["starts_at"], x["city"]) for x in parse("free_agenda", page)]
    assert got == [(f"https://a.example/{k}" + (f"#{n}" if n else ""), f"2031-05-{i % 28 + 1:02d}", f"Salle {i // 2}") for k in (0, 1) for n, i in enumerate(range(k, 200, 2))]
