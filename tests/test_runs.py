"""Whole runs over replayed captures: run twice, the second run changes nothing."""

import json

import pytest
from pyspark.sql import functions as F

from driftwell import pipeline
from driftwell.operators import items as it
from driftwell.operators import logs
from driftwell.sources import connectors, store

POSTS = [{"id": 1, "link": "https://a.example/1", "title": {"rendered": "Seminário"}, "excerpt": {"rendered": "x"}}, {"id": 2, "link": "https://a.example/2", "title": {"rendered": "Bonjour"}, "excerpt": {"rendered": ""}}]
AGENDA = {"data": [{"id": "9", "calendar_title": "Stage", "calendar_from_to": "2026/10/17", "calendar_place": "Iwama"}]}


def replay(posts=POSTS):
    return connectors.Replay({
        "https://a.example/wp-json/wp/v2/posts?per_page=20&_fields=id,link,title,excerpt,date_gmt,modified_gmt": (200, {}, json.dumps(posts).encode()),
        "https://b.example/": (200, {}, json.dumps(AGENDA).encode()), "https://c.example/": (200, {}, b"<html>"), "https://d.example/": (500, {}, b""),
        "https://a.example/": (200, {}, b"<p>home</p>"),
    })


@pytest.fixture()
def sources(spark):
    rows = [("a", "https://a.example/", "wp_json", ["fr"], None, 1), ("b", "https://b.example/", "http", ["ja"], "iwama", 1), ("c", "https://c.example/", "http", None, None, 1), ("d", "https://d.example/", "http", None, None, 1), ("e", "https://e.example/", "http", None, None, 1), ("f", "https://x.bad.example/", "http", None, None, 1)]
    return spark.createDataFrame(rows, "id string, url string, engine string, lang array<string>, lineage string, active int")


def run(spark, sources, root, now, posts=POSTS):
    block = spark.createDataFrame([("bad.example",)], "domain string")
    got = pipeline.ingest(sources, replay(posts), root, now, block, {"b": "agenda_api", "c": "news_api"}, sleep=lambda s: None)
    return {r.source_id: (r.outcome, r["items"], r.new, r.updated) for r in got.collect()}, got


def test_ingest_twice(spark, sources, tmp_path):
    root = str(tmp_path / "t")
    first, report = run(spark, sources, root, "2026-07-24T10:00:00+00:00")
    assert first == {"a": ("baseline", 2, 2, 0), "b": ("baseline", 1, 1, 0), "c": ("parse_error", 0, 0, 0), "d": ("http_error", 0, 0, 0), "e": ("error", 0, 0, 0), "f": ("blocked", 0, 0, 0)}
    assert logs.run_gate(report.withColumn("run", report.outcome.isNull()), "run").first().exit_code == 0
    event = store.read(spark, f"{root}/events").first()
    assert (event.starts_at, event.city, event.lineage) == ("2026-10-17", "Iwama", "iwama")
    second, _ = run(spark, sources, root, "2026-07-25T10:00:00+00:00")
    assert {k: v[0] for k, v in second.items()} == {"a": "same", "b": "same", "c": "same", "d": "http_error", "e": "error", "f": "blocked"}
    assert store.current(spark, f"{root}/items").endswith("v1") and store.read(spark, f"{root}/items").count() == 3
    log = spark.read.parquet(f"{root}/fetches")
    assert log.count() == 12 == log.select("id").distinct().count()
    changed = [POSTS[0] | {"title": {"rendered": "Seminário novo"}}, POSTS[1], POSTS[0] | {"id": 3, "link": "https://a.example/3"}]
    third, _ = run(spark, sources, root, "2026-07-26T10:00:00+00:00", changed)
    assert third["a"] == ("changed", 3, 1, 1) and store.current(spark, f"{root}/items").endswith("v2")
    items = store.read(spark, f"{root}/items").collect()
    assert len({r.id for r in items}) == 4 == len(items)


def test_probe_twice(spark, sources, tmp_path):
    root = str(tmp_path / "p")
    for now, want in (("2026-07-24T10:00:00", None), ("2026-07-25T10:00:00", 0)):
        got = {r.source_id: (r.changed, r.error) for r in pipeline.probe(sources, replay(), root, now, sleep=lambda s: None).collect()}
        assert got["a"] == (want, None) and got["e"][1]
    assert spark.read.parquet(f"{root}/probes").count() == 12


def test_enrich(spark, sources, tmp_path):
    root = str(tmp_path / "e")
    run(spark, sources, root, "2026-07-24T10:00:00+00:00")

    def fails(request):
        raise OSError("no service")

    got = pipeline.enrich(sources, root, fails)
    assert (got["reclassified"], got["country_filled"], got["region_filled"], got["lineage_filled"]) == (1, 0, 1, 0) and not got["complete"] and got["failed_requests"] == 1
    assert {r.type for r in store.read(spark, f"{root}/items").collect()} == {"seminar", "news", "event"}

    def upper(request):
        asked = json.loads(request)
        assert [x["id"] for x in asked] == list(range(len(asked)))
        return json.dumps({"translations": [{"id": x["id"], "pt": x["text"].upper()} for x in asked] + [{"id": 99, "pt": "z"}, {"id": 0}]})

    got = pipeline.enrich(sources, root, upper)
    assert got["complete"] and got["api"] == 4 and got["cache_hits"] == 0
    assert "SEMINÁRIO" in {r.title_pt for r in store.read(spark, f"{root}/items").collect()}
    again = pipeline.enrich(sources, root, fails)
    assert again["complete"] and again["api"] == 0 and again["items"] == 0 == again["reclassified"]


def test_answers_that_break_the_contract(spark):
    sent = spark.createDataFrame([(0, ["h0", "h1"], "[]", x, None) for x in ('{"translations": [{"id": 1, "pt": "ok"}]}', "no json", "[]", '{"translations": [{"id": "x", "pt": 3}, {"pt": "y"}]}', None)], "batch bigint, hashes array<string>, request string, answer string, error string")
    assert [(r.hash, r.text_pt) for r in it.answers(sent).collect()] == [("h1", "ok")]


def test_a_merge_writes_the_buckets_it_touches(spark, tmp_path):
    """Against a plain merge: the same rows; parts whose keys did not come stay where they are; a reader of the old version sees it whole."""
    table, schema = str(tmp_path / "m"), "id long, v string"
    how = lambda old, new: it.upsert(old, new, "id", ~F.col("old.v").eqNullSafe(F.col("new.v")), {"v": F.col("new.v")})
    store.commit(spark.range(500).selectExpr("id", "'a' as v"), table)  # without buckets
    before = store.read(spark, table)
    store.merge(spark.createDataFrame([(3, "b"), (900, "n")], schema), table, "id", schema, how)
    want = {**dict.fromkeys(range(500), "a"), 3: "b", 900: "n"}
    assert {r.id: r.v for r in store.read(spark, table).collect()} == want and before.count() == 500
    got = store.merge(spark.createDataFrame([(7, "c")], schema), table, "id", schema, how)
    assert {r.id: r.v for r in store.read(spark, table).collect()} == {**want, 7: "c"} and got.count() < 100
    assert sum(v == 3 for v in store._layout(spark, table).values()) == 1
    store.merge(spark.createDataFrame([(7, "c")], schema), table, "id", schema, how)
    assert store.current(spark, table).endswith("v3")
    empty = store.merge(spark.createDataFrame([], schema), table, "id", schema, how)
    assert empty.count() == 0 and store.read(spark, table).count() == 501
