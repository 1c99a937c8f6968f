"""Whole runs: ingest, probe and enrich, each one call over versioned tables in one folder.

The folder holds items, events and translations (versioned, store.commit) and fetches and probes (append only). The clock
is a parameter, fetching and translating are injected. A run that is repeated on the same captures changes nothing but the
logs; a run that dies is repeated from the start: tables are committed before the log row that would skip the work.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from driftwell.functions import payloads, text
from driftwell.operators import items as it
from driftwell.operators import logs
from driftwell.schemas import EVENT, FETCH, ITEMS
from driftwell.session import cut_lineage
from driftwell.sources import catalog, connectors, parsers, raw, store

CACHE = "content_hash string, lang string, text_pt string"


def _table(spark: SparkSession, at: str, schema) -> DataFrame:
    """Current version of a table; empty where there is none (S4). Columns that an older version lacks are null."""
    df = store.read(spark, at)
    empty = spark.createDataFrame([], schema)
    if df is None:
        return empty
    return df.select(*[(F.col(f.name) if f.name in df.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in empty.schema])


def _log(spark: SparkSession, at: str) -> DataFrame:
    fs = store._fs(spark, at)
    return spark.read.schema(FETCH).parquet(at) if fs.exists(store._path(spark, at)) else spark.createDataFrame([], FETCH)


def _previous(log: DataFrame) -> DataFrame:
    """source_id, endpoint, previous_hash, etag, last_modified of the newest answer with content."""
    good = log.filter("http_status = 200 and content_hash is not null").select("source_id", "endpoint", "fetched_at", "id", F.col("content_hash").alias("previous_hash"), "etag", "last_modified")
    return logs.latest_per_key(good, ["source_id", "endpoint"], ["fetched_at", "id"]).drop("fetched_at", "id")


def _next_id(df: DataFrame) -> int:
    return df.agg(F.max("id")).first()[0] or 0


def ingest(sources: DataFrame, fetch: connectors.Fetcher, root: str, now: str, blocklist: DataFrame | None = None, dedicated: dict[str, str] | None = None, sleep: Callable[[float], None] | None = None) -> DataFrame:
    """Fetch, gate, parse, merge and log all *sources* once: source_id, outcome, status_line, items, new, updated of each.

    Only payloads whose content changed are stored, parsed and merged; an event takes its source's lineage when it
    is first seen (E-5). run_gate() over the result says whether the run failed.
    """
    spark = sources.sparkSession
    old_log = _log(spark, f"{root}/fetches")
    want = sources.select(F.col("id").alias("source_id"), "url", "engine", "lang", "lineage", catalog.endpoint(F.col("engine"), F.col("url")).alias("endpoint"))
    want = want.join(_previous(old_log), ["source_id", "endpoint"], "left")
    asked = catalog.allowed(want, blocklist) if blocklist is not None else want
    got = connectors.fetch_all(asked.select("source_id", "endpoint", "etag", "last_modified"), fetch, **({"sleep": sleep} if sleep else {}))
    blocked = want.join(asked.select("source_id"), "source_id", "left_anti").select("source_id", "endpoint", *[F.lit(None).cast(t).alias(c) for c, t in got.dtypes if c not in ("source_id", "endpoint", "error")], F.lit("blocked: blocklist").alias("error"))
    rows = got.unionByName(blocked).join(want.select("source_id", "url", "engine", "lang", "lineage", "previous_hash"), "source_id")
    rows = rows.withColumn("content_hash", F.when(F.col("http_status") == 200, text.hash16(F.col("body"))))
    rows = rows.withColumn("changed_now", F.when(F.col("content_hash").isNotNull() & F.col("previous_hash").isNotNull(), (F.col("content_hash") != F.col("previous_hash")).cast("int")))
    rows = cut_lineage(logs.outcome(rows))  # the network is asked once
    fresh = rows.filter(F.col("outcome").isin("baseline", "changed"))
    stored = fresh.withColumns({"fetched_at": F.lit(now), "kind": text.payload_kind(F.decode("body", "UTF-8"))})
    if not stored.isEmpty():
        raw.write(stored.select("source_id", "endpoint", "fetched_at", "http_status", "latency_ms", "content_hash", "etag", "last_modified", "error", "body"), f"{root}/raw")
    parsed = cut_lineage(parsers.parse_payloads(fresh.select("source_id", "engine", "url", "lang", "endpoint", "body"), now[:10], dedicated))
    merged = merge(spark, root, parsed.filter("parse_error is null"), sources, now)

    paths = stored.select("source_id", raw.raw_path().alias("raw_path"))
    log = rows.join(paths, "source_id", "left").select("source_id", F.lit(now).alias("fetched_at"), "endpoint", "http_status", "latency_ms", "content_hash", "etag", "last_modified", "raw_path",
                      F.when(F.col("outcome").isin("not_modified", "same"), 0).when(F.col("outcome") == "changed", 1).alias("changed"), F.coalesce("error", F.when(F.col("outcome") == "http_error", F.concat(F.lit("http_"), F.col("http_status")))).alias("error"))
    record_fetches(log, f"{root}/fetches", _next_id(old_log))

    bad = parsed.filter("parse_error is not null").groupBy("source_id").agg(F.min("parse_error").alias("parse_error"))
    out = rows.select("source_id", "outcome", "http_status", "error").join(bad, "source_id", "left").join(merged, "source_id", "left")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("bigint").alias(c)
    out = out.withColumn("outcome", F.when(F.col("parse_error").isNotNull(), "parse_error").otherwise(F.col("outcome")))
    line = F.concat_ws(" ", F.concat(F.lit("["), F.col("source_id"), F.lit("]")), F.upper("outcome"), F.coalesce("parse_error", "error"))
    return cut_lineage(out.select("source_id", "outcome", line.alias("status_line"), zero("items"), zero("new"), zero("updated")))


def record_fetches(rows: DataFrame, at: str, last_id: int) -> None:
    """Append one log row for each attempt (S24, S25). rows: FETCH without id."""
    out = it.numbered(rows, "source_id", last_id)
    store.append(out.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in FETCH]), at)


def merge(spark: SparkSession, root: str, parsed: DataFrame, sources: DataFrame, now: str) -> DataFrame:
    """Merge parsed items into items and events: source_id, items, new, updated. Of a url's copies the last one counts."""
    last_id = _next_id(_table(spark, f"{root}/items", ITEMS))
    counted = parsed.groupBy("source_id").agg(F.count("*").alias("items"))
    last = cut_lineage(it.latest(parsed.filter("url is not null"), ["url"], ["position", "source_id"]))
    new = last.withColumns({f.name: F.lit(None).cast(f.dataType) for f in ITEMS if f.name not in last.columns}).withColumn("discovered_at", F.lit(now))

    def with_ids(old: DataFrame, new: DataFrame) -> DataFrame:
        both = cut_lineage(it.upsert_items(old, new))
        return both.filter("merge_state <> 'new'").unionByName(it.numbered(both.filter("merge_state = 'new'").drop("id"), "url", last_id))

    every = store.merge(new, f"{root}/items", "url", ITEMS, with_ids)  # only the buckets of these urls
    changes = every.filter(F.col("merge_state").isin("new", "updated")).select("url", "merge_state", F.col("id").alias("item_id"))
    lineage = sources.select(F.col("id").alias("source_id"), "lineage")
    events = last.filter(F.col("type").isin("event", "seminar")).join(changes.select("url", "item_id"), "url").join(lineage, "source_id", "left")
    events = cut_lineage(events.withColumns({"org_id": F.lit(None).cast("string"), "region": F.lit(None).cast("string")}).select(*EVENT.fieldNames()))
    if not events.isEmpty():
        store.merge(events, f"{root}/events", "item_id", EVENT, it.upsert_events)
    owner = last.select("url", "source_id").join(changes.select("url", "merge_state"), "url").groupBy("source_id").agg(*[F.sum((F.col("merge_state") == s).cast("int")).alias(c) for s, c in (("new", "new"), ("updated", "updated"))])
    return cut_lineage(counted.join(owner, "source_id", "left"))


def probe(sources: DataFrame, fetch: connectors.Fetcher, root: str, now: str, sleep: Callable[[float], None] | None = None) -> DataFrame:
    """Hash the visible text of every source's home page and log whether it changed: source_id, changed, error."""
    spark = sources.sparkSession
    old = _log(spark, f"{root}/probes")
    want = sources.select(F.col("id").alias("source_id"), F.col("url").alias("endpoint"), F.lit(None).cast("string").alias("etag"), F.lit(None).cast("string").alias("last_modified"))
    got = connectors.fetch_all(want, fetch, **({"sleep": sleep} if sleep else {}))
    got = got.withColumn("content_hash", payloads.batched(lambda b: payloads.visible_text_hash(bytes(b)))("body"))
    before = logs.latest_per_key(old.filter("content_hash is not null").select("source_id", "fetched_at", "id", F.col("content_hash").alias("previous_hash")), ["source_id"], ["fetched_at", "id"]).select("source_id", "previous_hash")
    rows = got.join(before, "source_id", "left").withColumn("changed", F.when(F.col("content_hash").isNotNull() & F.col("previous_hash").isNotNull(), (F.col("content_hash") != F.col("previous_hash")).cast("int")))
    rows = cut_lineage(rows.select("source_id", F.lit(now).alias("fetched_at"), "endpoint", "http_status", "latency_ms", "content_hash", "etag", "last_modified", F.lit(None).cast("string").alias("raw_path"), "changed", "error"))
    record_fetches(rows, f"{root}/probes", _next_id(old))
    return rows.select("source_id", "changed", "error")


def enrich(sources: DataFrame, root: str, send: Callable[[str], str] | None = None) -> dict[str, int | bool]:
    """Classify, geocode, then translate what is pending (E-6); counters of all three.

    Classes, places, copies of Portuguese texts and cached translations are committed before the service is asked, so a
    service that fails leaves them in place; requests that failed stay pending. Without *send* nothing is asked.
    """
    spark = sources.sparkSession
    items, events, cache = (_table(spark, f"{root}/{n}", s) for n, s in (("items", ITEMS), ("events", EVENT), ("translations", CACHE)))
    n: dict[str, int | bool] = {}

    def count(df: DataFrame, **conditions) -> None:
        row = df.agg(*[F.coalesce(F.sum(F.expr(c).cast("int")), F.lit(0)).cast("bigint").alias(k) for k, c in conditions.items()]).first()
        n.update(row.asDict())

    classified = it.classify_pending(items)
    count(classified.join(items.select("id", F.col("type").alias("was")), "id"), checked="was in ('news', 'page')", reclassified="reclassified = 1")
    items = cut_lineage(classified.drop("reclassified"))

    placed = cut_lineage(it.geocode_pending(events, items, sources))
    was = events.select("item_id", *[F.col(c).alias(f"was_{c}") for c in ("country", "region", "lineage")])
    count(placed.join(was, "item_id"), events="true", **{f"{c}_filled": f"was_{c} is null and {c} is not null" for c in ("country", "region", "lineage")})
    if n["country_filled"] or n["region_filled"] or n["lineage_filled"]:
        store.commit(placed, f"{root}/events")

    filled = cut_lineage(it.backfill(items, cache))
    before = items.select("id", *[F.col(c).alias(f"was_{c}") for c in ("title_pt", "summary_pt")])
    made = "cast({a} is null and {b} is not null as int) + cast({c} is null and {d} is not null as int)".format(a="was_title_pt", b="title_pt", c="was_summary_pt", d="summary_pt")
    pending = "was_title_pt is null or (summary is not null and was_summary_pt is null)"
    row = filled.join(before, "id").agg(F.sum(F.expr(f"cast({pending} as int)")).alias("items"), F.sum(F.expr(f"if(lang = 'pt', {made}, 0)")).alias("copied"), F.sum(F.expr(f"if(coalesce(lang, '') <> 'pt', {made}, 0)")).alias("cache_hits")).first()
    n.update({k: v or 0 for k, v in row.asDict().items()})
    if n["reclassified"] or n["copied"] or n["cache_hits"]:
        store.commit(filled, f"{root}/items")

    queue = cut_lineage(it.translation_queue(filled, cache))
    waiting = queue.count()
    n |= {"api": 0, "skipped_api": waiting if send is None else 0, "failed_requests": 0}
    if send is not None and waiting:
        sent = cut_lineage(it.ask(it.requests(queue), send))  # the service is asked once
        n["api"], n["failed_requests"] = waiting, sent.filter("error is not null").count()
        told = it.answers(sent).join(queue.select("hash", "lang"), "hash").select(F.col("hash").alias("content_hash"), "lang", "text_pt")
        told = cut_lineage(told)
        if not told.isEmpty():
            cache = cut_lineage(it.insert_ignore(cache, told, "content_hash"))
            store.commit(cache, f"{root}/translations")
            filled = cut_lineage(it.backfill(filled, cache))
            store.commit(filled, f"{root}/items")
    n["complete"] = n["failed_requests"] == 0
    return n
