import datetime as dt

from pyspark.sql import functions as F

from driftwell import reports
from driftwell.functions import dates, payloads, text
from driftwell.operators import items as it
from driftwell.operators import logs, views
from driftwell.plans import reference
from driftwell.schemas import FETCH, PAYLOAD
from driftwell.sources import catalog, connectors, raw, store
from driftwell.streaming import logs as stream


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


def test_columns(spark):
    L = F.lit
    assert one(spark, dates.fmt_range(L("2026-10-17"), L("2026-10-18"))) == "17–18 out 2026"
    assert one(spark, dates.fmt_range(L("2026-10-30"), L("2026-11-02"))) == "30 out – 2 nov 2026"
    assert one(spark, dates.fmt_range(L("2026-12-30"), L("2027-01-02"))) == "30 dez 2026 – 2 jan 2027"
    assert one(spark, dates.fmt_date(L("soon"))) == "soon" and one(spark, dates.month_before("2026-03-31")) == "2026-03-03"
    assert one(spark, dates.slashes(L("2026-07-10T1"))) == "10/07/2026" and one(spark, dates.gmt_suffix(L("2026-07-10T10:00:00"))) == "2026-07-10T10:00:00+00:00"
    assert tuple(one(spark, dates.range_ends(L("2026/10/17-2026/10/18")))) == ("2026-10-17", "2026-10-18")
    assert tuple(one(spark, dates.range_ends(L("-")))) == (None, None)
    for title, want in [("Stage de verão", "seminar"), ("SEMINÁRIO nacional", "seminar"), ("Embukai 2026", "event"), ("Encontro", "event"), ("News", None), ("演武大会", "event"), ("Backstage", None)]:
        assert one(spark, text.classify_type(L(title))) == want, title
    long = "palavra " * 40
    cut = one(spark, text.ellipsis200(L(long)))
    assert cut.endswith("…") and len(cut) <= 201 and one(spark, text.ellipsis200(L("curto"))) == "curto"
    assert one(spark, text.strip_tags(L("<p>a </p><br> b"))) == "a b" and one(spark, text.strip_tags(L("<p></p>"))) is None
    assert one(spark, text.host(L("https://WWW.Club.example:8080/x"))) == "club.example" and one(spark, text.ascii_lang(L("題"))) == "ja"
    assert one(spark, payloads.slug(L("É isso"))) == "e-isso"
    for country, city, want in [("BR", " Curitiba ", "sul_br"), ("BR", "São Paulo", "brasil"), ("jp", None, "japao"), ("XX", None, "outro"), (None, None, None)]:
        assert one(spark, it.region_for(L(country), L(city))) == want


def log_rows(spark):
    rows, n = [], 0
    for source, seq in {"a": "1 1 2 e e e", "b": "1 n 4 1", "c": "e e 1", "d": " ".join("e" * 12)}.items():
        for k, x in enumerate(seq.split()):
            n += 1
            status, h, err = {"e": (500, None, None), "n": (304, None, None), "4": (404, None, None)}.get(x, (200, x, None))
            rows.append((n, source, f"2026-01-{k + 1:02d}T00:00:00+00:00", "u", status, 1, h, None, None, None, None, err))
    return spark.createDataFrame(rows, FETCH)


def test_logs(spark):
    log = log_rows(spark)
    got = {r.id: r.changed_now for r in logs.change_detection(log, ["source_id", "endpoint"], ["fetched_at", "id"]).collect()}
    assert [got[i] for i in range(1, 14)] == [None, 0, 1, None, None, None, None, None, None, 0, None, None, None]
    sources = spark.createDataFrame([(x, x, 1, 1) for x in "abcdz"] + [("y", "y", 1, 0)], "id string, name string, priority int, active int")
    assert {r.source_id: (r.streak, r.last_error) for r in logs.fail_streaks(log, sources).collect()} == {"a": (3, "http_500"), "b": (0, None), "c": (0, None), "d": (10, "http_500"), "z": (0, None)}
    assert {r.source_id: r.streak for r in logs.fail_streaks(log, sources, None).collect()}["d"] == 12
    assert {r.source_id: r.health for r in logs.source_status(log, sources).collect()} == {"a": "erro", "b": "ok", "c": "ok", "d": "erro", "z": "aguardando"}
    assert logs.cadence(log.limit(0), "source_id", "fetched_at", "changed", "error").collect() == []


def test_streaming_equals_batch(spark, tmp_path):
    log = log_rows(spark)
    for k in (1, 2):  # two micro-batches, in order of time
        log.filter((F.col("fetched_at") < "2026-01-03") if k == 1 else (F.col("fetched_at") >= "2026-01-03")).coalesce(1).write.mode("append").parquet(str(tmp_path / "log"))
    source = lambda: spark.readStream.schema(FETCH).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "log"))

    def run(df, name, mode):
        q = df.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start()
        q.awaitTermination(120)
        return spark.table(name).collect()

    want = {r.id: (r.previous_hash, r.changed_now) for r in logs.change_detection(log, ["source_id", "endpoint"], ["fetched_at", "id"]).collect()}
    got = run(stream.change_detection(source()), "changes", "append")
    assert {r.id: (r.previous_hash, r.changed_now) for r in got} == want and not any(r.late for r in got)
    last = {}
    for r in run(stream.fail_streaks(source()), "streaks", "update"):
        last[r.source_id] = max(last.get(r.source_id, ("", 0)), (r.fetched_at, r.streak))
    assert {k: v[1] for k, v in last.items()} == {"a": 3, "b": 0, "c": 0, "d": 12}
    windows = run(stream.counts_per_window(source()), "windows", "complete")
    assert sum(r.probes for r in windows) == log.count()


def test_merge_is_idempotent_and_versioned(spark, data, tmp_path):
    items = spark.read.parquet(f"{data}/items.parquet").dropDuplicates(["id"])
    first = it.upsert_items(items.limit(0), items)
    assert first.filter("merge_state <> 'new'").count() == 0
    table = str(tmp_path / "items")
    assert store.read(spark, table) is None
    store.commit(first.drop("merge_state"), table)
    again = it.upsert_items(store.read(spark, table), items)
    assert {r.merge_state for r in again.select("merge_state").distinct().collect()} == {"unchanged"}
    store.commit(again.drop("merge_state"), table)
    assert store.current(spark, table).endswith("v2") and store.read(spark, table).count() == items.count()


def test_catalog(spark, tmp_path):
    (tmp_path / "s.yml").write_text("sources:\n- {id: a, name: A, url: 'https://a.example/x', country: BR, lang: [pt], engine: wp_json, cadence: weekly, priority: 1}\n- {id: b, name: B, url: 'https://sub.bad.example/', engine: http}\n", encoding="utf-8")
    new = catalog.load_yaml(spark, str(tmp_path / "s.yml"))
    old = spark.createDataFrame([("a", "old", None, None, None, "http", None, None, "allowed", 0), ("gone", "G", None, None, None, None, None, None, "allowed", 1)], "id string, name string, url string, country string, lineage string, engine string, cadence string, priority int, robots string, active int")
    got = {r.id: r for r in catalog.sync(old, new).collect()}
    assert (got["a"].name, got["a"].robots, got["a"].active) == ("A", "allowed", 0) and got["gone"].name == "G" and got["b"].robots == "pending"
    block = spark.createDataFrame([("bad.example",)], "domain string")
    assert [r.id for r in catalog.allowed(new, block).collect()] == ["a"]
    assert catalog.robots_allows(503, "", "https://a/", "x") is False and catalog.robots_allows(404, "", "https://a/", "x") and catalog.robots_allows(200, "User-agent: *\nDisallow: /p", "https://a/p", "x") is False
    assert [r.id for r in catalog.select(new, cadence="weekly").collect()] == ["a"]
    moved = catalog.transitions(catalog.sync(old, new), spark.createDataFrame([("a", "ok"), ("b", "blocked")], "source_id string, outcome string"))
    assert {r.id: (r.active, r.robots) for r in moved.collect()} == {"a": (0, "allowed"), "b": (0, "pending"), "gone": (1, "allowed")}


def test_connector_and_raw_store(spark, tmp_path):
    caps = {"https://a.example/feed/": (200, {"etag": "e"}, b"<rss></rss>"), "https://b.example/": (500, {}, b"no")}
    req = spark.createDataFrame([("a", "https://a.example/feed/", None, None), ("a2", "https://a.example/feed/", "e", None), ("b", "https://b.example/", None, None), ("c", "https://c.example/", None, None)], "source_id string, endpoint string, etag string, last_modified string")
    got = {r.source_id: r for r in connectors.fetch_all(req, connectors.Replay(caps), sleep=lambda s: None).collect()}
    assert [got[k].http_status for k in ("a", "a2", "b", "c")] == [200, 304, 500, None] and got["c"].error and got["a2"].body is None
    rows = spark.createDataFrame([("a", "u", "2026-01-01T00:00:00+00:00", 200, 1, "h1", None, None, None, bytearray(b"  <?xml?>")), ("a", "u", "2026-01-02T00:00:00+00:00", 200, 1, "h2", None, None, None, bytearray(b"[1]"))], PAYLOAD)
    raw.write(rows, str(tmp_path / "raw"))
    back = raw.replay(spark, str(tmp_path / "raw")).withColumn("path", raw.raw_path())
    assert {r.path for r in back.collect()} == {"raw/a/2026-01-01/h1.xml", "raw/a/2026-01-02/h2.json"}
    sources = spark.createDataFrame([("a", "https://a.example/")], "id string, url string")
    probed = connectors.candidates(sources).withColumns({"http_status": F.lit(200), "content_type": F.when(F.col("kind") == "rss", "application/xml").otherwise("text/html")})
    assert {r.kind: r.works for r in connectors.works(probed).collect()} == {"rss": 1, "wp_json": 0}


def test_translation(spark):
    items = spark.createDataFrame([(1, "pt", "Olá", None, None, None), (2, "fr", "Bonjour", None, "Ça va", None), (3, "fr", "Bonjour", None, None, None), (4, None, None, None, None, None)], "id long, lang string, title string, title_pt string, summary string, summary_pt string")
    queue = it.translation_queue(items)
    assert {r.text for r in queue.collect()} == {"Bonjour", "Ça va"}
    done = it.translate(queue, lambda pairs: {k: t.upper() for k, t in pairs})
    cache = done.select(F.col("hash").alias("content_hash"), "text_pt")
    assert it.translation_queue(items, cache).count() == 0  # the second run sends nothing
    got = {r.id: (r.title_pt, r.summary_pt) for r in it.backfill(items, cache).collect()}
    assert got == {1: ("Olá", None), 2: ("BONJOUR", "ÇA VA"), 3: ("BONJOUR", None), 4: (None, None)}


def test_reports(spark, data):
    q = reference.QUERIES
    assert reports.cadence_report(q["probe_cadence_report"](spark, data), "now").count("\n|") > 50
    out = reports.newsletter(q["newsletter_lines"](spark, data).withColumn("at", F.lit(None).cast("string")), "2026-03-31")
    assert "março de 2026" in out
    empty = views.newsletter_lines(q["future_events"](spark, data).limit(0), q["recent_news_month"](spark, data).limit(0))
    assert "_Nenhum evento" in reports.newsletter(empty, "2026-03-31")
    assert dt.date.fromisoformat(reference.AS_OF)


def test_hot_source(spark):
    """One source with a third of the log, without AQE: no task holds more than a few per cent, and results equal one plain window's."""
    from pyspark.sql import Window

    log = spark.range(12_000).selectExpr(
        "id", "if(id % 3 = 0, 'hot', concat('s', id % 40)) as source_id", "'u' as endpoint", "date_format(date_add(date '2026-01-01', cast(id % 300 as int)), 'yyyy-MM-dd') || 'T00:00:00' as fetched_at",
        "if(id % 7 = 0, 500, 200) as http_status", "if(id % 11 = 0, null, cast(id % 5 as string)) as content_hash", "cast(null as string) as error",
    )
    w = Window.partitionBy("source_id", "endpoint").orderBy("fetched_at", "id").rowsBetween(Window.unboundedPreceding, -1)
    want = log.withColumn("p", F.last(F.when(F.col("http_status") == 200, F.col("content_hash")), ignorenulls=True).over(w))
    old = {k: spark.conf.get(k) for k in ("spark.sql.adaptive.enabled", "spark.sql.shuffle.partitions")}
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", "32")
    try:
        got = logs.change_detection(log, ["source_id", "endpoint"], ["fetched_at", "id"])
        sizes = [r.n for r in got.groupBy(F.spark_partition_id()).agg(F.count("*").alias("n"), F.max("changed_now"), F.max("previous_hash")).collect()]
        assert max(sizes) < 0.06 * 12_000 and len(sizes) == 32
        assert {(r.id, r.previous_hash) for r in got.collect()} == {(r.id, r.p) for r in want.collect()}
        sources = spark.createDataFrame([("hot", 1), ("s1", 1)], "id string, active int")
        assert {r.source_id for r in logs.fail_streaks(log, sources).collect()} == {"hot", "s1"}
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)
