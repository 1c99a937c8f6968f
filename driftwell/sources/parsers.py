"""Payloads to items: one format a route; routed by source, then engine, then the generic page.

Python reads what Spark cannot: charsets, XML feeds, and the links, tables and metas of HTML. It does so once
a payload, and only what the payload's route needs. Everything after that is columns: JSON by from_json, links
and cells by higher-order functions, dates by expressions. A payload that cannot be read yields one row with
an error, never a failed task.
"""

from __future__ import annotations

import xml.etree.ElementTree as ET
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from driftwell.functions import dates
from driftwell.functions import payloads as P
from driftwell.functions import text as X
from driftwell.schemas import AGENDA_API, ITEM, NEWS_API, WP_POSTS
from driftwell.sources.html import Page

JSON_ROUTES = ("wp_json", "news_api", "agenda_api")
HTML_ROUTES = ("generic", "permalink_blog", "dated_links", "timed_links", "calendar_table", "free_agenda")
ENGINES = {"wp_json": "wp_json", "rss": "rss"}
#: Longest error text that is kept.
ERROR_LENGTH = 200

_ENTRY = pa.struct([(n, pa.string()) for n in ("url", "title", "external_id", "published_at", "updated_at", "summary")])
_LINK = pa.struct([("href", pa.string()), ("text", pa.string()), ("lines", pa.list_(pa.string())), ("time", pa.string()), ("absolute", pa.string())])
_META = pa.struct([("name", pa.string()), ("content", pa.string())])
_PAGE = pa.struct([("title", pa.string()), ("h1", pa.string()), ("metas", pa.list_(_META)), ("links", pa.list_(_LINK)), ("rows", pa.list_(pa.list_(pa.string()))), ("text", pa.string())])
READ = (
    "text string, entries array<struct<url:string,title:string,external_id:string,published_at:string,updated_at:string,summary:string>>, "
    "page struct<title:string,h1:string,metas:array<struct<name:string,content:string>>,links:array<struct<href:string,text:string,lines:array<string>,time:string,absolute:string>>,rows:array<array<string>>,text:string>, error string"
)


def route(source_id: Column, engine: Column, dedicated: dict[str, str]) -> Column:
    """Route of a payload: the source's own, else its engine's, else generic."""
    by_engine = X.lookup(ENGINES, engine, F.lit("generic"))
    return F.coalesce(X.lookup(dedicated, source_id), by_engine) if dedicated else by_engine


def read_feed(text: str) -> list[dict]:
    """Entries of an RSS document, else of an Atom one (S16, D1, T1). Those without title or link are left out."""
    root = ET.fromstring(text.strip().encode("utf-8"))
    atom = "{http://www.w3.org/2005/Atom}"
    found = []
    for e in root.iter("item"):
        found.append({"url": (e.findtext("link") or "").strip(), "title": e.findtext("title"), "external_id": e.findtext("guid"), "published_at": e.findtext("pubDate"), "updated_at": None, "summary": e.findtext("description")})
    good = [x for x in found if x["url"] and P.clean(x["title"], 2)]
    if not good:
        for e in root.iter(f"{atom}entry"):
            hrefs = {x.get("rel", "alternate"): x.get("href") for x in e.findall(f"{atom}link")}
            part = {n: e.findtext(atom + n) for n in ("title", "id", "published", "updated", "summary")}
            found.append({"url": hrefs.get("alternate", next(iter(hrefs.values()), None)), "title": part["title"], "external_id": part["id"], "published_at": part["published"] or part["updated"], "updated_at": part["updated"], "summary": part["summary"]})
        good = [x for x in found if x["url"] and P.clean(x["title"], 2)]
    for x in good:
        x |= {"title": P.clean(x["title"], 2), "summary": P.clean(x["summary"], 2), "published_at": P.utc_iso(x["published_at"]), "updated_at": P.utc_iso(x["updated_at"])}
    return good


def read_page(text: str, base: str | None) -> dict:
    p = Page(text)
    links = [{"href": a["href"], "text": a["text"], "lines": a["lines"], "time": a["time"], "absolute": P.absolute(base or "", a["href"])} for a in p.links]
    return {"title": p.title, "h1": p.h1, "metas": [{"name": k, "content": v} for k, v in p.metas.items()], "links": links, "rows": p.rows, "text": p.text}


def read(payloads: DataFrame) -> DataFrame:
    """*payloads* (route, url, body first) with text, entries, page, error: what the route needs of each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 64):  # bounds the memory of long payloads
                batch = whole.slice(at, 64)
                texts, entries, pages, errors = [], [], [], []
                for way, url, body in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                    text = entry = page = error = None
                    try:
                        text = P.decode(bytes(body or b""))
                        if way == "rss":
                            text, entry = None, read_feed(text)
                        elif way in HTML_ROUTES:
                            text, page = None, read_page(text, url)
                    except Exception as e:  # a bad payload is data, not a failure of the task
                        error = f"{type(e).__name__}: {e}"[:ERROR_LENGTH]
                    texts.append(text), entries.append(entry), pages.append(page), errors.append(error)
                made = [pa.array(texts, pa.string()), pa.array(entries, pa.list_(_ENTRY)), pa.array(pages, _PAGE), pa.array(errors, pa.string())]
                yield pa.RecordBatch.from_arrays([*batch.columns[3:], batch.column(0), batch.column(1), *made], names=[*batch.schema.names[3:], "route", "url", "text", "entries", "page", "error"])

    kept = [c for c in payloads.columns if c not in ("route", "url", "body")]
    types = dict(payloads.dtypes)
    schema = "".join(f"`{c}` {types[c]}, " for c in kept) + f"route string, url string, {READ}"
    return payloads.select("route", "url", "body", *kept).mapInArrow(run, schema)


def item(**fields: Column | str | None) -> Column:
    """An item's struct; what is not named is null, online is 0."""
    given = {"type": "page", "online": F.lit(0), **fields}
    made = [(F.lit(v) if v is None or isinstance(v, str) else v).cast(f.dataType).alias(f.name) for f in ITEM.fields for v in (given.get(f.name),)]
    return F.struct(*made)


def _first_of_url(items: Column) -> Column:
    """The first item of each url, in order."""
    urls = F.transform(items, lambda x: x["url"])
    return F.filter(items, lambda x, i: F.array_position(urls, x["url"]) == i + 1)


def _some(value: Column) -> Column:
    return F.nullif(value, F.lit(""))


def _site() -> Column:
    return F.concat(F.regexp_extract("url", r"\A[A-Za-z][A-Za-z0-9+.\-]*://[^/?#]*", 0), F.lit("/"))


def wp_posts() -> Column:
    """Posts of a blog's REST interface (S13, N1, D2); an error object has none (E9). Titles and summaries are still markup."""
    posts = F.when(F.ltrim("text").startswith("["), F.from_json("text", WP_POSTS))
    return F.transform(
        posts,
        lambda p: item(url=p["link"], type="news", title=p["title"]["rendered"], external_id=p["id"].cast("string"), lang=X.first_lang(F.col("lang")),
                       published_at=dates.gmt_suffix(p["date_gmt"]), updated_at=dates.gmt_suffix(p["modified_gmt"]), summary=p["excerpt"]["rendered"]),
    )


def news_api() -> Column:
    """Records of a news interface."""
    records = F.from_json("text", NEWS_API)["data"]

    def one(n: Column) -> Column:
        url = F.when(n["link_type"] == "detail", F.concat(_site(), F.lit("eng/news/detail/?news_id="), n["id"])).otherwise(_some(n["news_link"]))
        return item(url=url, type="news", title=_some(X.strip(n["news_title"])), external_id=n["id"], lang="en", published_at=dates.slash_date(n["news_date"]), summary=_some(n["kind_str"]))

    return F.transform(records, one)


def agenda_api() -> Column:
    """Records of an agenda interface."""
    records = F.from_json("text", AGENDA_API)["data"]

    def one(n: Column) -> Column:
        days = dates.range_ends(F.coalesce(n["calendar_from_to"], F.lit("")))
        url = F.concat(_site(), F.lit("eng/event/detail/?event_id="), n["id"])
        return item(url=url, type="event", title=_some(X.strip(n["calendar_title"])), external_id=n["id"], lang="en", summary=X.strip_tags(n["calendar_topics"]), starts_at=days["starts"], ends_at=days["ends"], tz="Asia/Tokyo", city=_some(n["calendar_place"]), country="JP")

    return F.transform(records, one)


def entries() -> Column:
    """Entries of a feed."""
    return F.transform("entries", lambda e: item(**{c: e[c] for c in ("url", "title", "external_id", "published_at", "updated_at")}, type="news", lang=X.first_lang(F.col("lang")), summary=X.cut500(e["summary"])))


def _meta(*names: str) -> Column:
    """Content of the first of the named metas that there is."""

    def content(name: str) -> Column:
        return F.get(F.filter("page.metas", lambda m: m["name"] == name), F.lit(0))["content"]

    return F.coalesce(*map(content, names))


def generic_page() -> Column:
    """One item of a page's metas."""
    title = F.coalesce(_meta("og:title", "twitter:title"), F.col("page.title"), F.col("page.h1"))
    return F.array(item(url=F.coalesce(_some(F.col("endpoint")), F.col("url")), type="page", title=title, lang=X.first_lang(F.col("lang")), published_at=_meta("article:published_time"), summary=X.cut500(_meta("og:description", "description"))))


def permalink_blog() -> Column:
    """Links whose path is a date (S18, D6, T11); the first link of a url that has text."""
    own = F.concat(F.lit(r"\Ahttps?://(?:www\.)?\Q"), X.host(F.col("url")), F.lit(r"\E(?::\d+)?/(\d{4})/(\d{2})/(\d{2})/[^\s\"?#]+"))
    links = F.filter("page.links", lambda a: (a["text"] != "") & F.regexp_like(a["href"], own))
    day = lambda a: F.array_join(F.slice(F.split(F.regexp_replace(a["href"], r"\A[a-z]+://[^/]+/", ""), "/"), 1, 3), "-")
    return _first_of_url(F.transform(links, lambda a: item(url=a["href"], type="news", title=a["text"], lang=X.ascii_lang(a["text"]), published_at=day(a))))


def dated_links() -> Column:
    """Links to notices whose text begins with dd/mm/yyyy."""
    shape = r"(?s)\A(\d{2})/(\d{2})/(\d{4})\s*(.+)"
    links = F.filter("page.links", lambda a: a["href"].contains("/noticia/") & a["text"].rlike(shape))
    return _first_of_url(F.transform(links, lambda a: item(url=a["absolute"], type="news", title=X.strip(F.regexp_extract(a["text"], shape, 4)), lang="pt", published_at=F.regexp_replace(F.substring(a["text"], 1, 10), r"(..)/(..)/(....)", "$3-$2-$1"))))


def timed_links() -> Column:
    """Links to news, with the time element that they hold."""
    own = F.concat(F.lit(r"\Ahttps?://(?:www\.)?\Q"), X.host(F.col("url")), F.lit(r"\E(?::\d+)?/news/.+"))
    made = F.transform(F.filter("page.links", lambda a: F.regexp_like(a["href"], own)), lambda a: item(url=a["href"], type="news", title=X.strip(F.regexp_replace(a["text"], r"\A\d{4}\.\d{2}\.\d{2}", "")), lang="ja", published_at=a["time"]))
    return _first_of_url(F.filter(made, lambda x: x["title"] != ""))


def calendar_table() -> Column:
    """Rows of a year's calendar: month, event, dd/mm and address, guest, ...."""
    year = F.regexp_extract("page.text", r"Calend[áa]rio\s+(20\d{2})", 1)
    day = r"(?<!\d)(\d{1,2})/(\d{1,2})(?!\d)"

    def one(cells: Column) -> Column:
        at = F.format_string("%s-%02d-%02d", year, F.regexp_extract(cells[2], day, 2).try_cast("int"), F.regexp_extract(cells[2], day, 1).try_cast("int"))
        url = F.concat(F.regexp_replace("url", r"/+\z", ""), F.lit("/#"), P.slug(cells[1]))
        return item(url=url, type="seminar", title=cells[1], lang="pt", starts_at=at, ends_at=at, tz="America/Sao_Paulo", city=P.address_city(cells[2]), country="BR", instructor=_some(F.get(cells, F.lit(3))))

    def good(cells: Column) -> Column:
        d, m = (F.regexp_extract(F.get(cells, F.lit(2)), day, k).try_cast("int") for k in (1, 2))
        return (year != "") & (F.size(cells) >= 3) & (F.get(cells, F.lit(1)) != "") & F.coalesce(d.between(1, 31) & m.between(1, 12), F.lit(False))

    return _first_of_url(F.transform(F.filter("page.rows", good), one))


def free_agenda(today: str) -> Column:
    """Lines of links that announce dates, '>' and a place or teacher.

    A link may announce several events: from the second on they get the link with a number, which only lines that
    could be read use up. A line that comes again in the page counts once.
    """
    months = "|".join(P.MONTHS_FR)
    shape = rf"\d[^>]*?(?<!\p{{L}})(?:{months})(?!\p{{L}})[^>]*>"
    linked = F.filter("page.links", lambda a: a["href"].startswith("http"))
    lines = F.flatten(F.transform(linked, lambda a: F.transform(F.filter(a["lines"], lambda x: F.lower(x).rlike(shape)), lambda x: F.struct(a["href"].alias("href"), x.alias("line"), F.lower(x).alias("low")))))

    def once(lines: Column) -> Column:
        return X.let(F.transform(lines, lambda x: x["low"]), lambda lows: F.filter(lines, lambda x, i: F.array_position(lows, x["low"]) == i + 1))

    def parse(x: Column) -> Column:
        def read(parts: Column) -> Column:
            return F.struct(x["href"].alias("href"), x["line"].alias("line"), F.when(F.size(parts) > 1, P.french_dates(parts[0], today)).alias("days"), P.venue(F.slice(parts, 2, F.greatest(F.size(parts) - 1, F.lit(0)))).alias("at"))

        return X.let(F.filter(F.transform(F.split(x["line"], ">"), X.strip), lambda p: p != ""), read)

    known = F.filter(F.transform(X.let(lines, once), parse), lambda x: x["days"].isNotNull())

    def numbered(known: Column) -> Column:
        def one(x: Column, i: Column) -> Column:
            before = F.size(F.filter(F.slice(known, 1, i), lambda y: y["href"] == x["href"]))
            url = X.let(before, lambda n: F.when(n == 0, x["href"]).otherwise(F.concat(x["href"], F.lit("#"), n.cast("string"))))
            at = x["at"]
            return item(url=url, type="seminar", title=x["line"], lang="fr", starts_at=x["days"]["starts"], ends_at=x["days"]["ends"], tz=F.when(at["country"] == "FR", "Europe/Paris"), city=at["city"], country=at["country"], instructor=at["instructor"])

        return F.transform(known, one)

    return X.let(known, numbered)


def parse_payloads(payloads: DataFrame, today: str, dedicated: dict[str, str] | None = None) -> DataFrame:
    """source_id, position, parse_error and the item's fields of all items in *payloads*.

    payloads: source_id, engine, url, lang, endpoint, body (binary), and any columns besides, which stay. Filter on the outcome
    before, so that only changed payloads are read. dedicated: source -> route. A payload without items gives
    no row; a broken one a row with parse_error and no item. Items without title or url are left out (F15),
    but for the generic page, which always gives its one item. position counts the payload's records from 0.
    """
    routed = payloads.withColumn("route", route(F.col("source_id"), F.col("engine"), dict(dedicated or {}))).drop("engine")
    found = read(routed)
    broken = F.col("route").isin(*JSON_ROUTES) & F.try_parse_json("text").isNull()
    error = F.coalesce("error", F.when(broken, F.concat(F.lit("JSONDecodeError: no JSON: "), F.substring("text", 1, 80))))
    made = {"wp_json": wp_posts(), "news_api": news_api(), "agenda_api": agenda_api(), "rss": entries(), "permalink_blog": permalink_blog(), "dated_links": dated_links(), "timed_links": timed_links(), "calendar_table": calendar_table(), "free_agenda": free_agenda(today)}
    used = {"wp_json", "rss", *(dedicated or {}).values()}  # routes that no payload can take are not planned
    items = F.when(F.col("error").isNotNull(), F.array(F.lit(None).cast(ITEM)))
    for name, column in made.items():
        if name in used:
            items = items.when(F.col("route") == name, column)
    items = items.otherwise(generic_page())
    rows = found.withColumn("error", error).select("*", F.posexplode(items).alias("position", "item"))
    markup = F.col("route") == "wp_json"  # the one format whose texts are markup inside JSON
    title = F.when(markup, P.cleaned(F.when(markup, F.col("item.title")))).otherwise(F.col("item.title"))
    summary = F.when(markup, X.cut500(P.cleaned(F.when(markup, F.col("item.summary"))))).otherwise(F.col("item.summary"))
    named = {"title": title, "summary": summary}
    kept = [c for c in payloads.columns if c not in ("engine", "url", "lang", "endpoint", "body", "source_id") and c not in ITEM.fieldNames()]
    out = rows.select("source_id", *kept, "position", F.col("error").alias("parse_error"), "route", *[named.get(f.name, F.col(f"item.{f.name}")).alias(f.name) for f in ITEM.fields])
    valid = F.col("parse_error").isNotNull() | (F.col("route") == "generic") | ((F.coalesce("title", F.lit("")) != "") & (F.coalesce("url", F.lit("")) != ""))
    return out.filter(valid).withColumn("position", F.when(F.col("parse_error").isNull(), F.col("position"))).drop("route")


OUT = T.StructType([T.StructField("source_id", T.StringType()), T.StructField("position", T.IntegerType()), T.StructField("parse_error", T.StringType()), *ITEM.fields])
