"""The engine's own queries on the tables, each with the SQL it is checked against.

The clock is a constant, so a query gives the same rows every day. Copies of rows count once.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from driftwell.functions import dates, text
from driftwell.operators import items as it
from driftwell.operators import logs, views
from driftwell.sources import catalog
from driftwell.sources.tables import table

AS_OF = "2026-03-31"
ROOT = "moto"


def _log(spark: SparkSession, d: str, *cols: str) -> DataFrame:
    return logs.unique_log(table(spark, d, "fetches", *cols) if cols else table(spark, d, "fetches"))


def _items(spark: SparkSession, d: str, *cols: str) -> DataFrame:
    return table(spark, d, "items", *cols).dropDuplicates(["id"])


def _events(spark: SparkSession, d: str) -> DataFrame:
    return it.first_per_key(table(spark, d, "item_events"), ["item_id"], ["instructor"])


def _agenda(s: SparkSession, d: str) -> DataFrame:
    return views.future_events(_events(s, d), _items(s, d, "id", "source_id", "title", "title_pt", "url"), table(s, d, "sources"), table(s, d, "lineages"), AS_OF)


def _changes(s: SparkSession, d: str) -> DataFrame:
    log = _log(s, d, "id", "source_id", "endpoint", "fetched_at", "http_status", "content_hash", "error")
    return logs.outcome(logs.change_detection(log, ["source_id", "endpoint"], ["fetched_at", "id"]))


F_ = "f AS (SELECT DISTINCT * FROM fetches)"
I_ = "i AS (SELECT DISTINCT * FROM items)"
E_ = "e AS (SELECT * FROM item_events QUALIFY row_number() OVER (PARTITION BY item_id ORDER BY instructor NULLS FIRST) = 1)"
BAD = "(coalesce(error, '') <> '' OR coalesce(http_status, 0) >= 400)"
OK = "(coalesce(error, '') = '' AND coalesce(http_status, 0) > 0 AND coalesce(http_status, 0) < 400)"
STREAK = f"""r AS (SELECT *, row_number() OVER (PARTITION BY source_id ORDER BY fetched_at DESC, id DESC) rn, {BAD} bad FROM f)"""
AGENDA = f"""a AS (SELECT e.item_id, e.starts_at, e.ends_at, e.city, e.country, e.region, e.online, e.instructor, e.lineage,
 coalesce(i.title_pt, i.title) AS title, i.url, s.name AS source_name, l.name AS lineage_name
 FROM e JOIN i ON i.id = e.item_id LEFT JOIN sources s ON s.id = i.source_id LEFT JOIN lineages l ON l.id = e.lineage
 WHERE coalesce(e.ends_at, e.starts_at) >= '{AS_OF}')"""
MONTH = f"strftime(date_trunc('month', DATE '{AS_OF}') - INTERVAL 1 MONTH + INTERVAL (day(DATE '{AS_OF}') - 1) DAY, '%Y-%m-%d')"
HASH16 = "substr(sha256({}), 1, 16)"


def _case(table_: dict[str, str], col: str, default: str) -> str:
    return f"CASE {col} " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in table_.items()) + f" ELSE {default} END"


def _fmt(c: str) -> str:
    months = "['" + "','".join(dates.MONTHS_SHORT) + "']"
    part = lambda a, n: f"TRY_CAST(substr({c}, {a}, {n}) AS INT)"
    good = f"regexp_matches({c}, '^\\d{{4}}-\\d{{2}}-\\d{{2}}') AND {part(1, 4)} > 0 AND {part(6, 2)} BETWEEN 1 AND 12 AND {part(9, 2)} > 0"
    return f"CASE WHEN {good} THEN concat({part(9, 2)}, ' ', {months}[{part(6, 2)}], ' ', {part(1, 4)}) ELSE {c} END"


def _fmt_range(a: str, b: str) -> str:
    months = "['" + "','".join(dates.MONTHS_SHORT) + "']"
    p = lambda c, at, n: f"TRY_CAST(substr({c}, {at}, {n}) AS INT)"
    d = lambda c: p(c, 9, 2)
    m = lambda c: f"{months}[{p(c, 6, 2)}]"
    shaped = " AND ".join(f"regexp_matches({c}, '^\\d{{4}}-\\d{{2}}-\\d{{2}}')" for c in (a, b))
    y, mo = f"{shaped} AND {p(a, 1, 4)} = {p(b, 1, 4)}", f"{p(a, 6, 2)} = {p(b, 6, 2)}"
    # parts that are null make the whole null, as in a concatenation
    one = f"{d(a)}::VARCHAR || '–' || {d(b)}::VARCHAR || ' ' || {m(a)} || ' ' || substr({a}, 1, 4)"
    two = f"{d(a)}::VARCHAR || ' ' || {m(a)} || ' – ' || {d(b)}::VARCHAR || ' ' || {m(b)} || ' ' || substr({a}, 1, 4)"
    return f"CASE WHEN {a} IS NULL THEN NULL WHEN {b} IS NULL OR {b} = {a} THEN {_fmt(a)} WHEN {y} AND {mo} THEN {one} WHEN {y} THEN {two} ELSE {_fmt(a)} || ' – ' || {_fmt(b)} END"


def _dates(s: SparkSession, d: str) -> DataFrame:
    return _events(s, d).select("item_id", dates.fmt_date(F.col("starts_at")).alias("one"), dates.fmt_range(F.col("starts_at"), F.col("ends_at")).alias("both"))


def _stats(s: SparkSession, d: str) -> DataFrame:
    return views.stats(table(s, d, "sources"), _items(s, d, "id", "type"), _events(s, d), table(s, d, "orgs"), table(s, d, "fetches", "fetched_at"), AS_OF)


def _upsert(s: SparkSession, d: str) -> DataFrame:
    i = _items(s, d)
    old = i.filter("id % 3 <> 0")  # two versions of the table: what was there, and what came in
    new = i.filter("id % 3 <> 1").withColumn("title", F.when(F.col("id") % 6 == 2, F.concat(F.col("title"), F.lit(" (2)"))).otherwise(F.col("title")))
    hashed = text.item_hash(F.col("title"), F.col("summary"), F.lit(None).cast("string"), F.lit(None).cast("string"))
    out = it.upsert_items(old.withColumn("content_hash", hashed), new)
    return out.select("url", "title", "title_pt", "content_hash", "merge_state")


def _event_upsert(s: SparkSession, d: str) -> DataFrame:
    e = _events(s, d)  # every event is on one side at least
    new = e.filter("item_id % 2 = 0 or item_id % 5 = 0").withColumns({"city": F.upper("city"), "lineage": F.lit("x"), "region": F.lit("y"), "org_id": F.lit("z")})
    out = it.upsert_events(e.filter("item_id % 5 <> 0"), new)
    return out.select("item_id", "city", "lineage", "region", "org_id", "merge_state")


def _news(s: SparkSession, d: str) -> DataFrame:
    return views.recent_news(_items(s, d, "id", "type", "title", "title_pt", "url", "published_at", "source_id"), table(s, d, "sources"), AS_OF)


def _queue(s: SparkSession, d: str, cache: DataFrame | None = None) -> DataFrame:
    return it.translation_queue(_items(s, d, "id", "title", "title_pt", "summary", "summary_pt", "lang"), cache)


def _cached(s: SparkSession, d: str) -> DataFrame:
    """The queue when half of its strings are in the cache."""
    return _queue(s, d, _queue(s, d).filter("hash < '8'").select(F.col("hash").alias("content_hash"))).select("hash")


QUERIES = {
    "change_detection": lambda s, d: _changes(s, d).select("id", "previous_hash", "changed_now"),
    "fetch_outcome": lambda s, d: _changes(s, d).select("id", "outcome"),
    "run_failure_gate": lambda s, d: logs.run_gate(_changes(s, d).withColumn("day", F.substring("fetched_at", 1, 10)), "day"),
    "fail_streak_capped10": lambda s, d: logs.fail_streaks(_log(s, d, "id", "source_id", "fetched_at", "http_status", "error"), table(s, d, "sources")),
    "fail_streak_full": lambda s, d: logs.fail_streaks(_log(s, d, "id", "source_id", "fetched_at", "http_status", "error"), table(s, d, "sources"), None),
    "alert_lines": lambda s, d: logs.alert_lines(logs.fail_streaks(_log(s, d, "id", "source_id", "fetched_at", "http_status", "error"), table(s, d, "sources"))),
    "source_status": lambda s, d: logs.source_status(_log(s, d, "id", "source_id", "fetched_at", "http_status", "error", "changed"), table(s, d, "sources")),
    "latest_per_endpoint": lambda s, d: logs.latest_per_key(_log(s, d, "id", "source_id", "endpoint", "fetched_at", "http_status"), ["source_id", "endpoint"], ["fetched_at", "id"]),
    "newest_ten_per_source": lambda s, d: logs.newest_n(_log(s, d, "id", "source_id", "fetched_at"), "source_id", ["fetched_at", "id"], 10),
    "probe_cadence_report": lambda s, d: logs.cadence(_log(s, d, "id", "source_id", "fetched_at", "changed", "error"), "source_id", "fetched_at", "changed", "error").join(table(s, d, "sources").select(F.col("id").alias("source_id"), "name", "country"), "source_id", "left").select("source_id", F.coalesce("name", "source_id").alias("name"), F.coalesce("country", F.lit("?")).alias("country"), "probes", "changes", "errors", "last_change", "days_obs", "interval_days", "cadence"),
    "future_events": _agenda,
    "agenda_facets": lambda s, d: views.facets(_agenda(s, d), country="BR").select("item_id", "city"),
    "agenda_lines": lambda s, d: views.agenda_lines(_agenda(s, d)),
    "agenda_ordered": lambda s, d: views.agenda_ordered(_agenda(s, d)).select("item_id", "starts_at"),
    "agenda_online": lambda s, d: views.facets(_agenda(s, d), online=True).select("item_id"),
    "agenda_near_me": lambda s, d: views.facets(_agenda(s, d), region="europa", lineage="").select("item_id", "region"),
    "home_top": lambda s, d: views.home_top(_agenda(s, d), _news(s, d)),
    "orgs_ordered": lambda s, d: views.orgs_ordered(table(s, d, "orgs")).select("id", "country", "kind", "name"),
    "sources_ordered": lambda s, d: views.sources_ordered(table(s, d, "sources")).select("id", "priority"),
    "facet_values": lambda s, d: views.facet_values(_agenda(s, d)),
    "date_range_fmt": _dates,
    "news_feed_top120": lambda s, d: views.feed(_items(s, d, "id", "type", "title", "title_pt", "summary_pt", "url", "lang", "published_at", "discovered_at", "source_id"), table(s, d, "sources")),
    "feed_labels": lambda s, d: views.feed_labels(_items(s, d, "id", "type", "lang", "summary")),
    "recent_news_month": lambda s, d: views.recent_news(_items(s, d, "id", "type", "title", "title_pt", "url", "published_at", "source_id"), table(s, d, "sources"), AS_OF),
    "newsletter_lines": lambda s, d: views.newsletter_lines(_agenda(s, d), views.recent_news(_items(s, d, "id", "type", "title", "title_pt", "url", "published_at", "source_id"), table(s, d, "sources"), AS_OF)).select("section", "id", "line"),
    "stats_scalars": _stats,
    "coverage_gate": lambda s, d: views.coverage(_items(s, d, "id", "title_pt"), _events(s, d)),
    "org_fallback_root": lambda s, d: views.orgs_by_lineage(table(s, d, "orgs"), table(s, d, "lineages"), ROOT),
    "org_links": lambda s, d: views.org_links(table(s, d, "orgs")),
    "lineage_tree": lambda s, d: views.lineage_tree(table(s, d, "lineages"), table(s, d, "orgs"), ROOT),
    "classify_type": lambda s, d: it.classify_pending(_items(s, d, "id", "type", "title")).select("id", "type", "reclassified"),
    "region_for": lambda s, d: it.geocode_pending(_events(s, d), _items(s, d, "id", "source_id"), table(s, d, "sources")).select("item_id", "country", "region", "lineage"),
    "item_content_hash": lambda s, d: _items(s, d, "id", "title", "summary").select("id", text.item_hash(F.col("title"), F.col("summary"), F.lit(None).cast("string"), F.lit(None).cast("string")).alias("item_hash")),
    "summary_500": lambda s, d: _items(s, d, "id", "summary").select("id", text.cut500(F.col("summary")).alias("short")),
    "dedupe_first": lambda s, d: it.first_per_key(_items(s, d, "id", "summary").filter("summary is not null").withColumn("hash", text.hash16(F.col("summary"))).select("hash", "id"), ["hash"], ["id"]),
    "translation_pending_unique": lambda s, d: it.translation_queue(_items(s, d, "id", "title", "title_pt", "summary", "summary_pt", "lang")).select("hash"),
    "translation_pending_cached": _cached,
    "endpoint_override": lambda s, d: table(s, d, "sources").select("id", catalog.endpoint(F.col("engine"), F.col("url"), F.when(F.col("priority") == 1, F.create_map(F.lit("rss"), F.lit("own.xml")))).alias("endpoint")),
    "translation_batches": lambda s, d: it.batches(it.translation_queue(_items(s, d, "id", "title", "title_pt", "summary", "summary_pt", "lang"))).select("hash", "batch"),
    "blocklist_anti": lambda s, d: catalog.allowed(table(s, d, "sources").select("id", "url"), table(s, d, "sources").filter("priority = 3").select(F.regexp_extract("url", "//([^/]+)", 1).alias("domain"))).select("id"),
    "endpoint_resolution": lambda s, d: table(s, d, "sources").select("id", catalog.endpoint(F.col("engine"), F.col("url")).alias("endpoint")),
    "payload_sniff": lambda s, d: table(s, d, "raw_pages", "raw_path", "body").select("raw_path", text.payload_kind(F.col("body")).alias("kind")),
    "upsert_items": _upsert,
    "event_upsert_preserve": _event_upsert,
    "seed_insert_ignore": lambda s, d: it.fill(it.insert_ignore(table(s, d, "orgs").filter("kind <> 'dojo'"), table(s, d, "orgs"), "id"), "instagram", {"org026_gelidino": "seeded"}).select("id", "instagram"),
}


def _outcome_sql() -> str:
    return f"""WITH {F_}, h AS (SELECT *, CASE WHEN http_status = 200 THEN content_hash END hh FROM f),
      p AS (SELECT *, last_value(hh IGNORE NULLS) OVER (PARTITION BY source_id, endpoint ORDER BY fetched_at, id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS previous_hash FROM h),
      c AS (SELECT *, CASE WHEN hh IS NOT NULL AND previous_hash IS NOT NULL THEN CAST(hh <> previous_hash AS INT) END AS changed_now FROM p),
      o AS (SELECT *, CASE WHEN regexp_matches(lower(coalesce(error, '')), 'blocklist') THEN 'blocked' WHEN regexp_matches(lower(coalesce(error, '')), 'robots') THEN 'robots' WHEN coalesce(error, '') <> '' THEN 'error'
        WHEN http_status = 304 THEN 'not_modified' WHEN http_status IS NULL OR http_status <> 200 THEN 'http_error' WHEN content_hash IS NULL THEN 'parse_error' WHEN previous_hash IS NULL THEN 'baseline' WHEN changed_now = 0 THEN 'same' ELSE 'changed' END AS outcome FROM c)"""


_streak = lambda cap: f"""WITH {F_}, {STREAK}, q AS (SELECT source_id, coalesce(min(CASE WHEN NOT bad THEN rn END) - 1, count(*)) AS streak,
   max(CASE WHEN rn = 1 AND bad THEN coalesce(nullif(error, ''), 'http_' || http_status) END) AS last_error FROM r {cap} GROUP BY 1),
   z AS (SELECT s.id AS source_id, CAST(coalesce(streak, 0) AS BIGINT) AS streak, last_error FROM sources s LEFT JOIN q ON q.source_id = s.id WHERE active = 1)"""  # noqa: E731

_SLASH = lambda c: f"CASE WHEN coalesce({c}, '') = '' THEN '' ELSE substr({c}, 9, 2) || '/' || substr({c}, 6, 2) || '/' || substr({c}, 1, 4) END"
_ITEM_HASH = HASH16.format("concat(coalesce(title, 'None'), '|', coalesce(summary, ''), '||')")
_WS = r"[\s\x{0B}\x{1C}-\x{1F}\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"
_STRIP = lambda c: f"regexp_replace({c}, '^{_WS}+|{_WS}+$', '', 'g')"
_PENDING = f"""w AS (SELECT * FROM i WHERE (title_pt IS NULL OR (summary IS NOT NULL AND summary_pt IS NULL)) AND coalesce(lang, '') <> 'pt'),
   t AS (SELECT title AS x FROM w WHERE title_pt IS NULL UNION ALL SELECT summary FROM w WHERE summary_pt IS NULL),
   u AS (SELECT DISTINCT {HASH16.format(_STRIP('x'))} AS hash FROM t WHERE coalesce({_STRIP('x')}, '') <> '')"""
_SEM = text.SEMINAR.replace("'", "''")
_EVE = text.EVENT.replace("'", "''")
_REGION = _case(it.REGIONS, "upper(c.country)", "'outro'")
_TREE = f"""WITH RECURSIVE k AS (SELECT id AS node FROM lineages), m AS (SELECT o.id, coalesce(k.node, '{ROOT}') AS node FROM orgs o LEFT JOIN k ON k.node = o.lineage),
   n AS (SELECT node, count(*) AS orgs FROM m WHERE node IN (SELECT node FROM k) GROUP BY 1),
   x AS (SELECT l.id, l.name, p.id AS parent, coalesce(n.orgs, 0) AS orgs FROM lineages l LEFT JOIN n ON n.node = l.id LEFT JOIN lineages p ON p.id = l.parent_id),
   tree(id, name, depth, orgs, path) AS (SELECT id, name, 0, orgs, CASE WHEN id = '{ROOT}' THEN '0' ELSE concat('1', id) END FROM x WHERE parent IS NULL
     UNION ALL SELECT c.id, c.name, t.depth + 1, c.orgs, concat(t.path, '/', lpad(CAST(1000000000 - c.orgs AS VARCHAR), 10, '0'), ':', c.id) FROM tree t JOIN x c ON c.parent = t.id)
   SELECT id, name, depth, orgs, path FROM tree"""

ORACLES = {
    "change_detection": _outcome_sql() + " SELECT id, previous_hash, changed_now FROM o",
    "fetch_outcome": _outcome_sql() + " SELECT id, outcome FROM o",
    "run_failure_gate": _outcome_sql() + " SELECT substr(fetched_at, 1, 10) AS day, count(*) AS n, CAST(sum(CAST(outcome IN ('error', 'parse_error') AS INT)) AS BIGINT) AS failed, CASE WHEN count(*) = sum(CAST(outcome IN ('error', 'parse_error') AS INT)) THEN 1 ELSE 0 END AS exit_code FROM o GROUP BY 1",
    "fail_streak_capped10": _streak("WHERE rn <= 10") + " SELECT * FROM z",
    "fail_streak_full": _streak("") + " SELECT * FROM z",
    "alert_lines": _streak("WHERE rn <= 10") + " SELECT source_id, CASE WHEN streak >= 3 THEN concat_ws('|', 'ALERT', source_id, CAST(streak AS VARCHAR), coalesce(last_error, 'desconhecido')) ELSE 'OK|' || source_id END AS line FROM z",
    "source_status": _streak("") + f""", g AS (SELECT source_id, max(fetched_at) AS last_fetch, max(CASE WHEN {OK} THEN fetched_at END) AS last_ok, max(CASE WHEN changed = 1 THEN fetched_at END) AS last_change, count(*) AS fetches FROM f GROUP BY 1)
      SELECT s.id AS source_id, s.name, s.priority, last_fetch, last_ok, last_change, CAST(coalesce(fetches, 0) AS BIGINT) AS fetches, z.streak AS fail_streak, z.last_error,
      CASE WHEN z.streak >= 3 THEN 'erro' WHEN z.streak > 0 THEN 'instável' WHEN last_fetch IS NULL THEN 'aguardando' ELSE 'ok' END AS health,
      coalesce(substr(replace(last_fetch, 'T', ' '), 1, 16) || ' UTC', '—') AS last_text FROM sources s JOIN z ON z.source_id = s.id LEFT JOIN g ON g.source_id = s.id WHERE s.active = 1""",
    "latest_per_endpoint": f"WITH {F_} SELECT source_id, endpoint, id, fetched_at, http_status FROM f QUALIFY row_number() OVER (PARTITION BY source_id, endpoint ORDER BY fetched_at DESC, id DESC) = 1",
    "newest_ten_per_source": f"WITH {F_} SELECT id, source_id, fetched_at, CAST(row_number() OVER (PARTITION BY source_id ORDER BY fetched_at DESC, id DESC) AS INT) AS rn FROM f QUALIFY rn <= 10",
    "probe_cadence_report": f"""WITH {F_}, g AS (SELECT source_id, count(*) AS probes, CAST(sum(coalesce(changed, 0)) AS BIGINT) AS changes, min(fetched_at) a, max(fetched_at) b, CAST(sum(CASE WHEN error IS NOT NULL THEN 1 ELSE 0 END) AS BIGINT) AS errors, max(CASE WHEN changed = 1 THEN fetched_at END) AS last_change FROM f GROUP BY 1),
      h AS (SELECT *, coalesce(greatest((epoch_us(TRY_CAST(b AS TIMESTAMPTZ)) - epoch_us(TRY_CAST(a AS TIMESTAMPTZ))) / CAST(86400e6 AS DOUBLE), CAST(0.01 AS DOUBLE)), CAST(0.01 AS DOUBLE)) AS days_obs FROM g),
      j AS (SELECT *, CASE WHEN changes > 0 THEN days_obs / changes END AS interval_days FROM h)
      SELECT source_id, coalesce(s.name, source_id) AS name, coalesce(s.country, '?') AS country, probes, changes, errors, last_change, days_obs, interval_days,
      CASE WHEN days_obs < 7 THEN 'aguardando dados (≥7 dias)' WHEN changes = 0 THEN 'monthly (nenhuma mudança ainda — revisar aos 60d)' WHEN interval_days <= 2 THEN 'daily' WHEN interval_days <= 9 THEN 'weekly' WHEN interval_days <= 20 THEN 'biweekly' ELSE 'monthly' END AS cadence FROM j LEFT JOIN sources s ON s.id = j.source_id""",
    "future_events": f"WITH {I_}, {E_}, {AGENDA} SELECT * FROM a",
    "agenda_facets": f"WITH {I_}, {E_}, {AGENDA} SELECT item_id, city FROM a WHERE coalesce(country, '') = 'BR'",
    "agenda_lines": f"""WITH {I_}, {E_}, {AGENDA} SELECT item_id, CASE WHEN contains(lower(coalesce(title, '')), 'stage') OR coalesce(instructor, '') <> '' THEN 'seminar' ELSE 'event' END AS badge,
      concat_ws(' · ', nullif(city, ''), nullif({_case(views.COUNTRIES, 'country', 'country')}, '')) AS place, {_fmt_range('starts_at', 'ends_at')} AS when_text FROM a""",
    "agenda_ordered": f"WITH {I_}, {E_}, {AGENDA} SELECT item_id, starts_at FROM a",
    "agenda_online": f"WITH {I_}, {E_}, {AGENDA} SELECT item_id FROM a WHERE online = 1",
    "agenda_near_me": f"WITH {I_}, {E_}, {AGENDA} SELECT item_id, region FROM a WHERE region = 'europa'",
    "home_top": f"""WITH {I_}, {E_}, {AGENDA}, n AS (SELECT i.id, coalesce(title_pt, title) AS title, i.url, published_at FROM i JOIN sources s ON s.id = i.source_id WHERE type = 'news' AND published_at >= {MONTH}),
      t AS (SELECT 'events' AS section, item_id AS id, title, url FROM a ORDER BY starts_at ASC NULLS FIRST, item_id LIMIT 3), u AS (SELECT 'news' AS section, id, title, url FROM n ORDER BY published_at DESC NULLS LAST, id DESC LIMIT 5) SELECT * FROM t UNION ALL SELECT * FROM u""",
    "orgs_ordered": "SELECT id, country, kind, name FROM orgs",
    "sources_ordered": "SELECT id, priority FROM sources WHERE active = 1",
    "newsletter_lines": f"""WITH {I_}, {E_}, {AGENDA}, n AS (SELECT i.id, coalesce(title_pt, title) AS title, i.url, published_at, s.name AS source_name FROM i JOIN sources s ON s.id = i.source_id WHERE type = 'news' AND published_at >= {MONTH})
      SELECT 'events' AS section, item_id AS id, '- **' || {_SLASH('starts_at')} || CASE WHEN ends_at IS NOT NULL AND coalesce(ends_at <> starts_at, false) THEN ' – ' || {_SLASH('ends_at')} ELSE '' END || '** · ' || concat_ws(' · ', nullif(city, ''), nullif({_case(views.COUNTRIES_NEWSLETTER, 'country', 'country')}, ''))
        || ' — [' || coalesce(title, 'None') || '](' || url || ')' || CASE WHEN coalesce(instructor, '') <> '' THEN ' — ' || instructor ELSE '' END AS line FROM a
      UNION ALL SELECT 'news', id, '- ' || {_SLASH('published_at')} || ' · [' || coalesce(title, 'None') || '](' || url || ') — ' || source_name FROM n""",
    "translation_pending_cached": f"WITH {I_}, {_PENDING} SELECT hash FROM u WHERE hash >= '8'",
    "endpoint_override": "SELECT id, CASE WHEN engine = 'rss' AND priority = 1 THEN 'own.xml' ELSE CASE engine WHEN 'wp_json' THEN regexp_extract(url, '^[a-z]+://[^/?#]+') || '/wp-json/wp/v2/posts?per_page=20&_fields=id,link,title,excerpt,date_gmt,modified_gmt' WHEN 'rss' THEN rtrim(url, '/') || '/feed/' ELSE url END END AS endpoint FROM sources",
    "facet_values": f"""WITH {I_}, {E_}, {AGENDA} SELECT DISTINCT 'country' AS facet, country AS value, country AS label FROM a WHERE country IS NOT NULL
      UNION ALL SELECT 'lineage', lineage, coalesce(arg_max(lineage_name, (starts_at, item_id)), lineage) FROM a WHERE lineage IS NOT NULL GROUP BY lineage
      UNION ALL SELECT 'online', 'online', CASE WHEN coalesce(bool_or(coalesce(online, 0) > 0), false) THEN 'true' ELSE 'false' END FROM a""",
    "date_range_fmt": f"WITH {E_} SELECT item_id, {_fmt('starts_at')} AS one, {_fmt_range('starts_at', 'ends_at')} AS both FROM e",
    "news_feed_top120": f"""WITH {I_} SELECT i.id, i.type, coalesce(title_pt, title) AS title, summary_pt, i.url, i.lang, coalesce(published_at, discovered_at) AS published_at, s.name AS source_name, s.country AS source_country
      FROM i JOIN sources s ON s.id = i.source_id WHERE i.type IN ('news', 'event', 'seminar') AND title IS NOT NULL ORDER BY coalesce(i.published_at, i.discovered_at) DESC NULLS LAST, i.id DESC LIMIT 120""",
    "feed_labels": f"""WITH {I_} SELECT id, {_case(views.BADGES, 'type', "'Notícia'")} AS badge, {_case(views.LANGUAGES, 'lang', "'original em português'")} AS lang_label,
      CASE WHEN length(summary) > 200 THEN concat(regexp_replace(substr(summary, 1, 200), '[ \\t\\r\\n]+[^ \\t\\r\\n]*$', ''), '…') ELSE summary END AS teaser FROM i""",
    "recent_news_month": f"WITH {I_} SELECT i.id, coalesce(title_pt, title) AS title, i.url, published_at, s.name AS source_name FROM i JOIN sources s ON s.id = i.source_id WHERE type = 'news' AND published_at >= {MONTH}",
    "stats_scalars": f"""WITH {I_}, {E_} SELECT (SELECT count(*) FROM sources WHERE active = 1) AS sources, (SELECT count(*) FROM i WHERE type IN ('news', 'event', 'seminar')) AS items, (SELECT count(*) FROM e WHERE coalesce(ends_at, starts_at) >= '{AS_OF}') AS events,
      (SELECT count(DISTINCT country) FROM sources WHERE active = 1) AS countries, (SELECT count(*) FROM orgs) AS orgs, (SELECT max(fetched_at) FROM fetches) AS last_update""",
    "coverage_gate": f"""WITH {I_}, {E_}, t AS (SELECT count(*) AS titles, CAST(coalesce(sum(CAST(title_pt IS NOT NULL AS INT)), 0) AS BIGINT) AS titles_pt FROM i), v AS (SELECT count(*) AS events, CAST(coalesce(sum(CAST(country IS NOT NULL AND lineage IS NOT NULL AS INT)), 0) AS BIGINT) AS events_ok FROM e),
      p AS (SELECT *, CASE WHEN titles > 0 THEN CAST(100.0 AS DOUBLE) * titles_pt / titles ELSE CAST(0 AS DOUBLE) END AS pct_titles, CASE WHEN events > 0 THEN CAST(100.0 AS DOUBLE) * events_ok / events ELSE CAST(0 AS DOUBLE) END AS pct_events FROM t, v)
      SELECT *, CASE WHEN pct_titles = 100 AND pct_events >= 90 THEN 1 ELSE 0 END AS passed FROM p""",
    "org_fallback_root": f"WITH k AS (SELECT id FROM lineages) SELECT o.id, o.name, o.kind, {_case(views.ORG_KINDS, 'o.kind', chr(39) + 'Dojo' + chr(39))} AS kind_label, o.country, coalesce(k.id, '{ROOT}') AS node FROM orgs o LEFT JOIN k ON k.id = o.lineage WHERE coalesce(k.id, '{ROOT}') IN (SELECT id FROM lineages)",
    "org_links": "SELECT id, concat_ws(' · ', nullif(city, ''), nullif(state, ''), nullif(country, '')) AS place, CAST(coalesce(url, '') <> '' OR coalesce(instagram, '') <> '' AS INT) AS has_links, CASE WHEN coalesce(instagram, '') <> '' THEN 'https://instagram.com/' || instagram END AS instagram_url FROM orgs",
    "lineage_tree": _TREE,
    "classify_type": f"""WITH {I_}, c AS (SELECT id, type, CASE WHEN type IN ('news', 'page') THEN CASE WHEN regexp_matches(lower(title), '{_SEM}') THEN 'seminar' WHEN regexp_matches(lower(title), '{_EVE}') THEN 'event' END END AS found FROM i)
      SELECT id, coalesce(found, type) AS type, CAST(found IS NOT NULL AS INT) AS reclassified FROM c""",
    "region_for": f"""WITH {I_}, {E_}, b AS (SELECT e.item_id, e.city, coalesce(e.country, {_case(it.CITY_COUNTRY, "lower(" + _STRIP('e.city') + ")", 'NULL')}) AS country, e.region, coalesce(e.lineage, s.lineage) AS lineage FROM e JOIN i ON i.id = e.item_id LEFT JOIN sources s ON s.id = i.source_id)
      SELECT c.item_id, c.country, coalesce(c.region, CASE WHEN lower({_STRIP('c.city')}) IN ({', '.join(repr(x) for x in it.SOUTH)}) THEN 'sul_br' WHEN coalesce(c.country, '') <> '' THEN {_REGION} END) AS region, c.lineage FROM b c""",
    "item_content_hash": f"WITH {I_} SELECT id, {_ITEM_HASH} AS item_hash FROM i",
    "summary_500": f"WITH {I_} SELECT id, nullif(substr(summary, 1, 500), '') AS short FROM i",
    "dedupe_first": f"WITH {I_} SELECT {HASH16.format('summary')} AS hash, min(id) AS id FROM i WHERE summary IS NOT NULL GROUP BY 1",
    "translation_pending_unique": f"WITH {I_}, {_PENDING} SELECT hash FROM u",
    "translation_batches": f"WITH {I_}, {_PENDING} SELECT hash, CAST(floor((row_number() OVER (ORDER BY hash) - 1) / 25) AS BIGINT) AS batch FROM u",
    "blocklist_anti": "WITH b AS (SELECT regexp_extract(url, '//([^/]+)', 1) AS d FROM sources WHERE priority = 3), h AS (SELECT id, regexp_replace(lower(regexp_extract(url, '//([^/:]+)', 1)), '^www\\.', '') AS host FROM sources) SELECT id FROM h WHERE NOT EXISTS (SELECT 1 FROM b WHERE host = d OR suffix(host, '.' || d))",
    "endpoint_resolution": "SELECT id, CASE engine WHEN 'wp_json' THEN regexp_extract(url, '^[a-z]+://[^/?#]+') || '/wp-json/wp/v2/posts?per_page=20&_fields=id,link,title,excerpt,date_gmt,modified_gmt' WHEN 'rss' THEN rtrim(url, '/') || '/feed/' ELSE url END AS endpoint FROM sources",
    "payload_sniff": "WITH h AS (SELECT raw_path, regexp_replace(body, '^\\s+', '') AS h FROM raw_pages) SELECT raw_path, CASE WHEN h[1] IN ('[', '{') THEN 'json' WHEN substr(h, 1, 5) IN ('<?xml', '<rss ', '<feed') THEN 'xml' ELSE 'html' END AS kind FROM h",
    "upsert_items": f"""WITH {I_}, o AS (SELECT *, {_ITEM_HASH} AS h FROM i WHERE id % 3 <> 0), m AS (SELECT * REPLACE (CASE WHEN id % 6 = 2 THEN title || ' (2)' ELSE title END AS title) FROM i WHERE id % 3 <> 1), n AS (SELECT *, {_ITEM_HASH} AS h FROM m),
      j AS (SELECT coalesce(o.url, n.url) AS url, CASE WHEN o.url IS NULL THEN 'new' WHEN n.url IS NULL THEN 'kept' WHEN o.h <> n.h THEN 'updated' ELSE 'unchanged' END AS merge_state, o.title ot, n.title nt, o.title_pt op, n.title_pt np, o.h oh, n.h nh FROM o FULL JOIN n ON o.url = n.url)
      SELECT url, CASE WHEN merge_state IN ('new', 'updated') THEN nt ELSE ot END AS title, CASE merge_state WHEN 'new' THEN np WHEN 'updated' THEN NULL ELSE op END AS title_pt, CASE WHEN merge_state IN ('new', 'updated') THEN nh ELSE oh END AS content_hash, merge_state FROM j""",
    "event_upsert_preserve": f"""WITH {E_}, o AS (SELECT * FROM e WHERE item_id % 5 <> 0), n AS (SELECT * FROM e WHERE item_id % 2 = 0 OR item_id % 5 = 0)
      SELECT coalesce(o.item_id, n.item_id) AS item_id, CASE WHEN n.item_id IS NULL THEN o.city ELSE upper(n.city) END AS city, CASE WHEN o.item_id IS NULL THEN 'x' ELSE o.lineage END AS lineage, CASE WHEN o.item_id IS NULL THEN 'y' ELSE o.region END AS region, CASE WHEN o.item_id IS NULL THEN 'z' ELSE o.org_id END AS org_id,
      CASE WHEN o.item_id IS NULL THEN 'new' WHEN n.item_id IS NULL THEN 'kept' ELSE 'updated' END AS merge_state FROM o FULL JOIN n ON o.item_id = n.item_id""",
    "seed_insert_ignore": "SELECT id, coalesce(instagram, CASE WHEN id = 'org026_gelidino' THEN 'seeded' END) AS instagram FROM orgs",
}
