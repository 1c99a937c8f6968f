"""Parser queries: payloads of each format are made from the tables' own rows and read back by the parsers.

Each row becomes one payload in its format (markup escaped as the format asks), so the SQL can say what must come out.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from driftwell.plans.reference import _STRIP, _WS, I_
from driftwell.sources import parsers
from driftwell.sources.tables import table

CLUB = "https://club.example/"
TODAY = "2026-03-31"


def _items(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "items", "id", "source_id", "url", "title", "summary", "published_at").dropDuplicates(["id"])


def _escaped(text: Column, times: int = 1) -> Column:
    for _ in range(times):
        text = F.replace(F.replace(F.replace(text, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))
    return text


def _text(text: Column | str, times: int = 1) -> Column:
    return F.coalesce(_escaped(F.col(text) if isinstance(text, str) else text, times), F.lit(""))


def _parsed(rows: DataFrame, body: Column, way: str, url: str = CLUB) -> DataFrame:
    """Items of the payloads *body*; rows has key and may have lang."""
    langs = F.col("lang") if "lang" in rows.columns else F.array().cast("array<string>")
    payloads = rows.select(F.lit("made").alias("source_id"), F.lit(None).cast("string").alias("engine"), F.lit(url).alias("url"), langs.alias("lang"), F.lit(None).cast("string").alias("endpoint"), F.encode(body, "UTF-8").alias("body"), "key")
    return parsers.parse_payloads(payloads, TODAY, {"made": way}).filter("parse_error is null").withColumnRenamed("key", "id")


def wp_posts(s: SparkSession, d: str) -> DataFrame:
    """Items as posts of a REST interface."""
    langs = table(s, d, "sources", "id", "lang").withColumnRenamed("id", "source_id")
    rows = _items(s, d).join(langs, "source_id", "left").withColumnRenamed("id", "key")
    rendered = lambda c: F.struct(F.concat(F.lit("<b>"), _text(c), F.lit("</b>")).alias("rendered"))
    post = F.struct(F.col("key").alias("id"), F.col("url").alias("link"), rendered("title").alias("title"), rendered("summary").alias("excerpt"), F.col("published_at").alias("date_gmt"))
    return _parsed(rows, F.to_json(F.array(post)), "wp_json").select("id", "url", "title", "summary", "lang", "published_at", "external_id")


def feed(s: SparkSession, d: str) -> DataFrame:
    """Items as entries of a feed."""
    rows = _items(s, d).withColumnRenamed("id", "key")
    at = F.date_format(F.timestamp_seconds(F.lit(1_600_000_000) + F.col("key") * 37), "EEE, dd MMM yyyy HH:mm:ss")
    tag = lambda n, c: F.concat(F.lit(f"<{n}>"), c, F.lit(f"</{n}>"))
    entry = F.concat(tag("title", _text("title", 3)), tag("link", _text("url")), tag("guid", F.col("key").cast("string")), tag("pubDate", F.concat(at, F.lit(" -0300"))), tag("description", F.concat(F.lit("<![CDATA[<p>"), _text("summary", 2), F.lit("</p>]]>"))))
    return _parsed(rows, F.concat(F.lit('<?xml version="1.0" encoding="UTF-8"?><rss><channel><item>'), entry, F.lit("</item></channel></rss>")), "rss").select("id", "url", "title", "summary", "published_at", "external_id")


def news_api(s: SparkSession, d: str) -> DataFrame:
    """Records of the news interface."""
    n = table(s, d, "news_records", "id", "news_date", "kind_str", "link_type", "news_link", "news_title").distinct().withColumn("key", F.col("id"))
    body = F.to_json(F.struct(F.array(F.struct(*[c for c in n.columns if c != "key"])).alias("data")))
    return _parsed(n, body, "news_api", "https://news.example/").select("id", "url", "title", "published_at", "summary")


def agenda_api(s: SparkSession, d: str) -> DataFrame:
    """News records as records of the agenda interface: two dates, a topic, a place."""
    n = table(s, d, "news_records", "id", "news_date", "news_date_short", "kind", "kind_str", "news_title").distinct().withColumn("key", F.col("id"))
    record = F.struct("id", F.concat_ws("-", "news_date", "news_date_short").alias("calendar_from_to"), F.col("news_title").alias("calendar_title"), F.concat(F.lit("<p>"), F.col("kind_str"), F.lit("</p>")).alias("calendar_topics"), F.col("kind").alias("calendar_place"))
    return _parsed(n, F.to_json(F.struct(F.array(record).alias("data"))), "agenda_api", "https://news.example/x?y").select("id", "url", "title", "summary", "starts_at", "ends_at", "tz", "city", "country")


def _linked(s: SparkSession, d: str, body: Column, way: str) -> DataFrame:
    return _parsed(_items(s, d).withColumnRenamed("id", "key"), body, way).select("id", "url", "title", "lang", "published_at")


def _day() -> Column:
    return F.date_add(F.lit("2020-01-01").cast("date"), F.pmod("key", F.lit(2000)).cast("int"))


def permalinks(s: SparkSession, d: str) -> DataFrame:
    """Items as links of a blog: a picture, the title, the title again, a foreign link."""
    href = F.concat(F.lit('<a href="https://club.example/'), F.date_format(_day(), "yyyy/MM/dd"), F.lit("/p"), F.col("key").cast("string"), F.lit('">'))
    body = F.concat(href, F.lit("<img></a>"), href, _text("title"), F.lit("</a>"), href, F.lit('again</a><a href="https://other.example/2020/01/01/x">no</a>'))
    return _linked(s, d, body, "permalink_blog")


def dated_links(s: SparkSession, d: str) -> DataFrame:
    """Items as dated notices with relative addresses."""
    body = F.concat(F.lit('<a href="noticia/x">no date</a><a href="/noticia/'), F.col("key").cast("string"), F.lit('"><div>'), F.date_format(_day(), "dd/MM/yyyy"), F.lit("</div>x "), _text("title"), F.lit("</a>"))
    return _linked(s, d, body, "dated_links")


def timed_links(s: SparkSession, d: str) -> DataFrame:
    """Items as links that hold a time element."""
    body = F.concat(F.lit('<a href="https://club.example/news">all</a><a href="https://www.club.example/news/'), F.col("key").cast("string"), F.lit('"><time datetime="'), _day().cast("string"), F.lit('">'), F.date_format(_day(), "yyyy.MM.dd"), F.lit("</time><h3>"), _text("title"), F.lit("</h3></a>"))
    return _linked(s, d, body, "timed_links")


def _agenda_rows(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "item_events", "item_id", "city").groupBy("item_id").agg(F.min("city").alias("city")).withColumnRenamed("item_id", "key")


def calendar(s: SparkSession, d: str) -> DataFrame:
    """Events as rows of a calendar with an address that ends in the typed city."""
    key = F.col("key")
    two = lambda c: F.lpad(c.cast("string"), 2, "0")
    address = F.concat(two(F.pmod(key, F.lit(35))), F.lit("/"), two(F.pmod(key, F.lit(13))), F.lit(" Rua Um, 5, "), _text("city"), F.lit(" - MG"))
    body = F.concat(F.lit("<h2>Calendário 2027</h2><table><tr><th>x<tr><td>m<td>Curso É Nº "), key.cast("string"), F.lit("<td>"), address, F.lit("<td>Ana<td>z</table>"))
    return _parsed(_agenda_rows(s, d), body, "calendar_table").select("id", "url", "title", "starts_at", "city", "country", "instructor")


def free_agenda(s: SparkSession, d: str) -> DataFrame:
    """Events as lines of one link: dates, a hall with a bracket, a teacher; then a second event."""
    key = F.col("key")
    day, month = F.pmod(key, F.lit(20)) + 1, F.element_at(F.array(*map(F.lit, ("janvier", "mars", "mai", "juillet", "août", "décembre"))), (F.pmod(key, F.lit(6)) + 1).cast("int"))
    line = F.concat(day.cast("string"), F.lit(", "), (day + 1).cast("string"), F.lit(" "), month, F.lit(" &gt; Salle "), key.cast("string"), F.lit(" (Suisse) &gt; ANNE MARTIN"))
    body = F.concat(F.lit('<p>1 mai &gt; x</p><a href="https://club.example/a.pdf">'), line, F.lit("<br>"), line, F.lit("<br>30 décembre au 2 janvier 2030 &gt; Stage &gt; Dojo Un</a>"))
    # keys are small and their parsing is not: adaptive joining of partitions by bytes would leave one task
    rows = _agenda_rows(s, d).repartition(int(s.conf.get("spark.sql.shuffle.partitions")))
    return _parsed(rows, body, "free_agenda").select("id", "url", "starts_at", "ends_at", "city", "country", "instructor", "tz")


def parsed_pages(s: SparkSession, d: str) -> DataFrame:
    """raw_path, url, title, lang of every captured page by the generic parser."""
    pages = table(s, d, "raw_pages", "raw_path", "source_id", "url", "body")
    src = table(s, d, "sources", "id", "lang").withColumnRenamed("id", "source_id")
    rows = pages.join(src, "source_id", "left").select("source_id", F.lit("http").alias("engine"), "url", "lang", F.lit(None).cast("string").alias("endpoint"), F.encode("body", "UTF-8").alias("body"), "raw_path")
    return parsers.parse_payloads(rows, TODAY).select("raw_path", "source_id", "url", "title", "lang", "parse_error")


def page_title(s: SparkSession, d: str) -> DataFrame:
    """raw_path, title, links of every page, as the HTML reader sees them."""
    rows = table(s, d, "raw_pages", "raw_path", "url", "body").select(F.lit("generic").alias("route"), "url", F.encode("body", "UTF-8").alias("body"), "raw_path")
    return parsers.read(rows).select("raw_path", F.coalesce("page.title", F.lit("")).alias("title"), F.size("page.links").cast("bigint").alias("links"))


QUERIES = {
    "wp_posts_items": wp_posts, "rss_items": feed, "news_records_items": news_api, "agenda_api_items": agenda_api, "permalink_blog_items": permalinks, "dated_links_items": dated_links,
    "timed_links_items": timed_links, "calendar_table_items": calendar, "free_agenda_items": free_agenda, "parsed_pages": parsed_pages, "page_title": page_title,
}

# payloads come out in composed form
_FLAT = lambda c: _STRIP(f"regexp_replace(nfc_normalize({c}), '{_WS}+', ' ', 'g')")
_T, _S = f"nullif({_FLAT('title')}, '')", f"nullif({_FLAT('summary')}, '')"
_D = "(DATE '2020-01-01' + CAST(id % 2000 AS INT))"


def _entities(c: str) -> str:
    """SQL that turns the entities of Latin-1 letters and signs, by name and by number, into these."""
    from html.entities import codepoint2name

    for code in range(160, 256):
        c = f"replace(replace({c}, '&{codepoint2name[code]};', chr({code})), '&#{code};', chr({code}))"
    for name, sign in (("quot", '"'), ("#39", "\'\'"), ("lt", "<"), ("gt", ">"), ("amp", "&")):
        c = f"replace({c}, '&{name};', '{sign}')"
    return c


_SITE_TITLE = rf"regexp_replace({_entities("regexp_extract(body, '(?is)<title[^>]*>(.*?)</title>', 1)")}, '{_WS}+', ' ', 'g')"
_LANG = "CASE WHEN regexp_matches({0}, '^[\\x00-\\x7F]*$') THEN 'en' ELSE 'ja' END"

ORACLES = {
    "wp_posts_items": f"""WITH {I_}, x AS (SELECT i.id, i.url, {_T} AS title, nullif(substr({_S}, 1, 500), '') AS summary, s.lang[1] AS lang,
      CASE WHEN coalesce(published_at, '') = '' THEN NULL WHEN suffix(published_at, 'Z') OR suffix(published_at, '+00:00') THEN published_at ELSE published_at || '+00:00' END AS published_at, CAST(i.id AS VARCHAR) AS external_id FROM i LEFT JOIN sources s ON s.id = i.source_id)
      SELECT * FROM x WHERE title IS NOT NULL AND coalesce(url, '') <> ''""",
    "rss_items": f"""WITH {I_}, x AS (SELECT id, trim(url) AS url, {_T} AS title, nullif(substr({_S}, 1, 500), '') AS summary,
      strftime(make_timestamp((1600000000 + id * 37 + 10800) * 1000000), '%Y-%m-%dT%H:%M:%S+00:00') AS published_at, CAST(id AS VARCHAR) AS external_id FROM i) SELECT * FROM x WHERE title IS NOT NULL AND coalesce(url, '') <> ''""",
    "news_records_items": f"""WITH n AS (SELECT DISTINCT id, news_date, kind_str, link_type, news_link, news_title FROM news_records), x AS (SELECT id, CASE WHEN link_type = 'detail' THEN 'https://news.example/eng/news/detail/?news_id=' || id ELSE nullif(news_link, '') END AS url, {_STRIP('news_title')} AS title, nullif(replace(news_date, '/', '-'), '') AS published_at, nullif(kind_str, '') AS summary FROM n)
      SELECT * FROM x WHERE url IS NOT NULL AND title <> ''""",
    "agenda_api_items": f"""WITH n AS (SELECT DISTINCT id, news_date, news_date_short, kind, kind_str, news_title FROM news_records), x AS (SELECT *, regexp_extract_all(concat_ws('-', news_date, news_date_short), '\\d{{4}}/\\d{{2}}/\\d{{2}}') AS f FROM n)
      SELECT id, 'https://news.example/eng/event/detail/?event_id=' || id AS url, {_STRIP('news_title')} AS title, nullif({_FLAT('kind_str')}, '') AS summary, replace(f[1], '/', '-') AS starts_at, replace(f[-1], '/', '-') AS ends_at, 'Asia/Tokyo' AS tz, nullif(kind, '') AS city, 'JP' AS country FROM x WHERE {_STRIP('news_title')} <> ''""",
    "permalink_blog_items": f"WITH {I_}, x AS (SELECT id, 'https://club.example/' || strftime({_D}, '%Y/%m/%d') || '/p' || id AS url, coalesce({_T}, 'again') AS title, strftime({_D}, '%Y-%m-%d') AS published_at FROM i) SELECT *, {_LANG.format('title')} AS lang FROM x",
    "dated_links_items": f"WITH {I_} SELECT id, 'https://club.example/noticia/' || id AS url, {_STRIP(chr(39) + 'x ' + chr(39) + ' || coalesce(' + _FLAT('title') + ', ' + chr(39) * 2 + ')')} AS title, 'pt' AS lang, strftime({_D}, '%Y-%m-%d') AS published_at FROM i",
    "timed_links_items": f"WITH {I_} SELECT id, 'https://www.club.example/news/' || id AS url, {_T} AS title, 'ja' AS lang, strftime({_D}, '%Y-%m-%d') AS published_at FROM i WHERE {_T} IS NOT NULL",
    "calendar_table_items": f"""WITH e AS (SELECT item_id AS id, min(city) AS city FROM item_events GROUP BY 1), a AS (SELECT id, {_FLAT("'Rua Um, 5, ' || coalesce(city, '') || ' - MG'")} AS rest FROM e),
      p AS (SELECT id, list_filter(list_transform(string_split_regex(regexp_replace(rest, '(?i)[\\-–,]\\s*(MG|BH|SP|RJ|ES)\\s*$', ''), '[,–-]'), lambda t: {_STRIP('t')}), lambda t: t <> '') AS parts FROM a)
      SELECT id, 'https://club.example/#curso-e-no-' || id AS url, 'Curso É Nº ' || id AS title, '2027-' || lpad(CAST(id % 13 AS VARCHAR), 2, '0') || '-' || lpad(CAST(id % 35 AS VARCHAR), 2, '0') AS starts_at,
      CASE WHEN length(parts[-1]) > 2 AND NOT regexp_matches(parts[-1], '[0-9]') THEN parts[-1] ELSE parts[-2] END AS city, 'BR' AS country, 'Ana' AS instructor FROM p WHERE id % 13 BETWEEN 1 AND 12 AND id % 35 BETWEEN 1 AND 31""",
    "free_agenda_items": """WITH e AS (SELECT DISTINCT item_id AS id FROM item_events), x AS (SELECT id, id % 20 + 1 AS d, ['01', '03', '05', '07', '08', '12'][id % 6 + 1] AS m FROM e),
      y AS (SELECT *, CASE WHEN date_diff('day', CAST('2026-' || m || '-' || lpad(CAST(d + 1 AS VARCHAR), 2, '0') AS DATE), DATE '2026-03-31') > 90 THEN '2027-' ELSE '2026-' END || m || '-' AS ym FROM x)
      SELECT id, 'https://club.example/a.pdf' AS url, ym || lpad(CAST(d AS VARCHAR), 2, '0') AS starts_at, ym || lpad(CAST(d + 1 AS VARCHAR), 2, '0') AS ends_at, 'Salle ' || id AS city, 'CH' AS country, 'ANNE MARTIN' AS instructor, CAST(NULL AS VARCHAR) AS tz FROM y
      UNION ALL SELECT id, 'https://club.example/a.pdf#1', '2030-12-30', '2031-01-02', 'Dojo Un', 'FR', NULL, 'Europe/Paris' FROM e""",
    "parsed_pages": f"SELECT raw_path, p.source_id, p.url, CASE WHEN regexp_matches(body, '(?i)<title') THEN {_STRIP(_SITE_TITLE)} END AS title, s.lang[1] AS lang, CAST(NULL AS VARCHAR) AS parse_error FROM raw_pages p LEFT JOIN sources s ON s.id = p.source_id",
    "page_title": f"SELECT raw_path, {_STRIP(_SITE_TITLE)} AS title, len(regexp_extract_all(body, '<a [^>]*href=')) AS links FROM raw_pages",
}
