"""Read-only views over items, events, sources and organisations; the clock is always a parameter."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from driftwell.functions import dates, text

# Display names.
COUNTRIES = {"BR": "Brasil", "JP": "Japão", "FR": "França", "DE": "Alemanha", "IT": "Itália", "BE": "Bélgica", "CZ": "Tchéquia", "AR": "Argentina", "CL": "Chile", "ES": "Espanha", "CH": "Suíça", "PT": "Portugal", "GB": "Reino Unido"}
COUNTRIES_NEWSLETTER = {k: COUNTRIES[k] for k in ("BR", "JP", "FR", "DE", "IT", "BE", "CZ", "AR", "CL")}
LANGUAGES = {"en": "traduzido do inglês", "es": "traduzido do espanhol", "fr": "traduzido do francês", "ja": "traduzido do japonês"}
BADGES = {"news": "Notícia", "event": "Evento", "seminar": "Seminário"}
ORG_KINDS = {"hombu": "Hombu", "federation": "Federação", "confederation": "Confederação", "institute": "Instituto", "dojo": "Dojo", "dojo_hq": "Dojo sede", "media": "Mídia", "instructor": "Instrutor"}


def display_title() -> Column:
    return F.coalesce("title_pt", "title")


def future_events(events: DataFrame, items: DataFrame, sources: DataFrame, lineages: DataFrame, as_of: str) -> DataFrame:
    """Events that end (or start) on or after *as_of*, by text comparison; both null drops."""
    e = events.filter(F.coalesce("ends_at", "starts_at") >= as_of)
    i = items.select(F.col("id").alias("item_id"), "source_id", display_title().alias("title"), "url")
    s = sources.select(F.col("id").alias("source_id"), F.col("name").alias("source_name"))
    lin = lineages.select(F.col("id").alias("lineage"), F.col("name").alias("lineage_name"))
    df = e.join(i, "item_id").join(s, "source_id", "left").join(lin, "lineage", "left")
    return df.select("item_id", "starts_at", "ends_at", "city", "country", "region", "online", "instructor", "lineage", "title", "url", "source_name", "lineage_name")


def agenda_ordered(agenda: DataFrame) -> DataFrame:
    """The agenda by start, nulls first, ties by id (O1): a range partitioning, so a sort of any size."""
    return agenda.orderBy(F.asc_nulls_first("starts_at"), "item_id")


def news_ordered(news: DataFrame) -> DataFrame:
    """News, the newest first, ties by id."""
    return news.orderBy(F.desc_nulls_last("published_at"), F.desc("id"))


def home_top(agenda: DataFrame, news: DataFrame, events: int = 3, articles: int = 5) -> DataFrame:
    """section, id, title, url of the next events and the newest news (O3): two top-k, no full sort."""
    e = agenda_ordered(agenda).limit(events).select(F.lit("events").alias("section"), F.col("item_id").alias("id"), "title", "url")
    return e.unionByName(news_ordered(news).limit(articles).select(F.lit("news").alias("section"), "id", "title", "url"))


def orgs_ordered(orgs: DataFrame) -> DataFrame:
    """Organisations by country, kind and name."""
    return orgs.orderBy("country", "kind", "name", "id")


def sources_ordered(sources: DataFrame) -> DataFrame:
    """Active sources by priority and id."""
    return sources.filter("active = 1").orderBy("priority", "id")


def facets(agenda: DataFrame, country: str = "", lineage: str = "", region: str = "", online: bool = False) -> DataFrame:
    """Facet filter; an empty facet is any."""
    for name, value in (("country", country), ("lineage", lineage), ("region", region)):
        if value:
            agenda = agenda.filter(F.coalesce(F.col(name), F.lit("")) == value)
    return agenda.filter("coalesce(online, 0) = 1") if online else agenda


def agenda_lines(agenda: DataFrame) -> DataFrame:
    """item_id, badge, place, when_text of agenda rows."""
    seminar = F.lower("title").contains("stage") | (F.coalesce("instructor", F.lit("")) != "")
    place = text.join_parts(" · ", F.col("city"), text.lookup(COUNTRIES, F.col("country"), F.col("country")))
    return agenda.select("item_id", F.when(seminar, "seminar").otherwise("event").alias("badge"), place.alias("place"), dates.fmt_range(F.col("starts_at"), F.col("ends_at")).alias("when_text"))


def facet_values(agenda: DataFrame) -> DataFrame:
    """facet, value, label: countries, lineages (the last name seen by start), whether any event is online."""
    c = agenda.filter("country is not null").select(F.lit("country").alias("facet"), F.col("country").alias("value"), F.col("country").alias("label")).distinct()
    order = F.struct("starts_at", "item_id")
    lin = agenda.filter("lineage is not null").groupBy("lineage").agg(F.coalesce(F.max_by("lineage_name", order), F.col("lineage")).alias("label")).select(F.lit("lineage").alias("facet"), F.col("lineage").alias("value"), "label")
    on = agenda.agg(F.coalesce(F.bool_or(F.coalesce("online", F.lit(0)) > 0), F.lit(False)).alias("any")).select(F.lit("online").alias("facet"), F.lit("online").alias("value"), F.when(F.col("any"), "true").otherwise("false").alias("label"))
    return c.unionByName(lin).unionByName(on)


def feed(items: DataFrame, sources: DataFrame, limit: int = 120) -> DataFrame:
    """Newest *limit* rows of the feed, by the date as text, ties by id (F3, J4, P2, O2): a top-k, no full sort."""
    s = sources.select(F.col("id").alias("source_id"), F.col("name").alias("source_name"), F.col("country").alias("source_country"))
    df = items.filter(F.col("type").isin("news", "event", "seminar") & F.col("title").isNotNull()).join(s, "source_id")
    df = df.select("id", "type", display_title().alias("title"), "summary_pt", "url", "lang", F.coalesce("published_at", "discovered_at").alias("published_at"), "source_name", "source_country")
    return df.orderBy(F.desc_nulls_last("published_at"), F.desc("id")).limit(limit)


def feed_labels(items: DataFrame) -> DataFrame:
    """id, badge, lang_label, teaser."""
    return items.select("id", text.lookup(BADGES, F.col("type"), F.lit("Notícia")).alias("badge"), text.lookup(LANGUAGES, F.col("lang"), F.lit("original em português")).alias("lang_label"), text.ellipsis200(F.col("summary")).alias("teaser"))


def recent_news(items: DataFrame, sources: DataFrame, as_of: str) -> DataFrame:
    """News of the month before *as_of*."""
    s = sources.select(F.col("id").alias("source_id"), F.col("name").alias("source_name"))
    df = items.filter((F.col("type") == "news") & (F.col("published_at") >= dates.month_before(as_of))).join(s, "source_id")
    return df.select("id", display_title().alias("title"), "url", "published_at", "source_name")


def newsletter_lines(agenda: DataFrame, news: DataFrame) -> DataFrame:
    """section, at, id, line (P14, D11): the lines of the newsletter, to be written in this order."""
    when = F.concat(dates.slashes(F.col("starts_at")), F.when(F.col("ends_at").isNotNull() & (F.col("ends_at") != F.col("starts_at")), F.concat(F.lit(" – "), dates.slashes(F.col("ends_at")))).otherwise(""))
    place = text.join_parts(" · ", F.col("city"), text.lookup(COUNTRIES_NEWSLETTER, F.col("country"), F.col("country")))
    who = F.when(F.coalesce("instructor", F.lit("")) != "", F.concat(F.lit(" — "), F.col("instructor"))).otherwise("")
    e = agenda.select(F.lit("events").alias("section"), F.col("starts_at").alias("at"), F.col("item_id").alias("id"), F.concat(F.lit("- **"), when, F.lit("** · "), place, F.lit(" — ["), F.coalesce("title", F.lit("None")), F.lit("]("), F.col("url"), F.lit(")"), who).alias("line"))
    n = news.select(F.lit("news").alias("section"), F.col("published_at").alias("at"), "id", F.concat(F.lit("- "), dates.slashes(F.col("published_at")), F.lit(" · ["), F.coalesce("title", F.lit("None")), F.lit("]("), F.col("url"), F.lit(") — "), F.col("source_name")).alias("line"))
    return e.unionByName(n)


def stats(sources: DataFrame, items: DataFrame, events: DataFrame, orgs: DataFrame, log: DataFrame, as_of: str) -> DataFrame:
    """One row of counts (A6-A8, F3 without the title test). Each count is one aggregate; the row joins six of them."""
    act = sources.filter("active = 1")
    parts = [
        act.agg(F.count("*").alias("sources"), F.count_distinct("country").alias("countries")),
        items.filter(F.col("type").isin("news", "event", "seminar")).agg(F.count("*").alias("items")),
        events.filter(F.coalesce("ends_at", "starts_at") >= as_of).agg(F.count("*").alias("events")),
        orgs.agg(F.count("*").alias("orgs")),
        log.agg(F.max("fetched_at").alias("last_update")),
    ]
    out = parts[0].withColumn("__one", F.lit(1))
    for p in parts[1:]:  # one row each
        out = out.join(p.withColumn("__one", F.lit(1)), "__one")
    return out.select("sources", "items", "events", "countries", "orgs", "last_update")


def coverage(items: DataFrame, events: DataFrame) -> DataFrame:
    """One row: totals, covered, percentages (0 for a total of 0), passed (A4, A5)."""
    t = items.agg(F.count("*").alias("titles"), F.coalesce(F.sum(F.col("title_pt").isNotNull().cast("int")), F.lit(0)).cast("bigint").alias("titles_pt")).withColumn("__one", F.lit(1))
    good = F.col("country").isNotNull() & F.col("lineage").isNotNull()
    e = events.agg(F.count("*").alias("events"), F.coalesce(F.sum(good.cast("int")), F.lit(0)).cast("bigint").alias("events_ok")).withColumn("__one", F.lit(1))
    df = t.join(e, "__one").drop("__one")
    share = lambda a, b: F.when(F.col(b) > 0, F.lit(100.0) * F.col(a) / F.col(b)).otherwise(F.lit(0.0))
    df = df.withColumns({"pct_titles": share("titles_pt", "titles"), "pct_events": share("events_ok", "events")})
    return df.withColumn("passed", F.when((F.col("pct_titles") == 100) & (F.col("pct_events") >= 90), 1).otherwise(0))


def orgs_by_lineage(orgs: DataFrame, lineages: DataFrame, root: str) -> DataFrame:
    """id, name, kind, kind_label, country, node: unknown and null lineages hang under *root*; none if it is missing."""
    known = lineages.select(F.col("id").alias("node"))
    matched = orgs.join(known, orgs["lineage"] == known["node"], "left").withColumn("node", F.coalesce("node", F.lit(root)))
    kept = matched.join(known, "node", "left_semi")
    return kept.select("id", "name", "kind", text.lookup(ORG_KINDS, F.col("kind"), F.lit("Dojo")).alias("kind_label"), "country", "node")


def org_links(orgs: DataFrame) -> DataFrame:
    """id, place, has_links, instagram_url (P5, P10)."""
    e = F.lit("")
    has = (F.coalesce("url", e) != "") | (F.coalesce("instagram", e) != "")
    place = text.join_parts(" · ", F.col("city"), F.col("state"), F.col("country"))
    return orgs.select("id", place.alias("place"), has.cast("int").alias("has_links"), F.when(F.coalesce("instagram", e) != "", F.concat(F.lit("https://instagram.com/"), F.col("instagram"))).alias("instagram_url"))


def lineage_tree(lineages: DataFrame, orgs: DataFrame, root: str) -> DataFrame:
    """id, name, depth, orgs, path: pre-order of the tree.

    The root comes first, then other roots by id; siblings by number of organisations, falling, ties
    by id. path sorts the rows. A parent that does not exist makes a root. The recursion joins the
    level above with the children, so it takes as many steps as the tree is deep.
    """
    n = orgs_by_lineage(orgs, lineages, root).groupBy("node").agg(F.count("*").alias("orgs"))
    ids = lineages.select(F.col("id").alias("__parent"))
    nodes = lineages.join(n, lineages["id"] == n["node"], "left").join(ids, lineages["parent_id"] == ids["__parent"], "left")
    nodes = nodes.select("id", "name", F.col("__parent").alias("parent"), F.coalesce("orgs", F.lit(0)).cast("bigint").alias("orgs"))
    key = "concat(lpad(cast(1000000000 - {t}.orgs as string), 10, '0'), ':', {t}.id)"
    query = f"""
        WITH RECURSIVE tree(id, name, depth, orgs, path) AS (
          SELECT id, name, 0, orgs, CASE WHEN id = :root THEN '0' ELSE concat('1', id) END FROM {{nodes}} WHERE parent IS NULL
          UNION ALL
          SELECT c.id, c.name, t.depth + 1, c.orgs, concat(t.path, '/', {key.format(t="c")}) FROM tree t JOIN {{nodes}} c ON c.parent = t.id
        ) SELECT id, name, depth, orgs, path FROM tree"""
    return lineages.sparkSession.sql(query, args={"root": root}, nodes=nodes)
