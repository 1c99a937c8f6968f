"""The queries over all events against brute force in Python."""

import re

import __spark_entry__ as entry
from driftwell.functions import dates

SHAPE = re.compile(r"\d{4}-\d{2}-\d{2}", re.A)


def parts(t):
    return (int(t[:4]), int(t[5:7]), int(t[8:10])) if SHAPE.match(t) else None


def one(t):
    p = parts(t) if t is not None else None
    return t if not p or not p[0] or not 1 <= p[1] <= 12 or not p[2] else f"{p[2]} {dates.MONTHS_SHORT[p[1] - 1]} {p[0]}"


def both(a, b):
    if a is None:
        return None
    if b is None or a == b:
        return one(a)
    p, q = parts(a), parts(b)
    month = lambda x: dates.MONTHS_SHORT[x[1] - 1]
    if p and q and p[0] == q[0]:
        return f"{p[2]}–{q[2]} {month(p)} {p[0]}" if p[1] == q[1] else f"{p[2]} {month(p)} – {q[2]} {month(q)} {p[0]}"
    return f"{one(a)} – {one(b)}"


def events(spark, data):
    rows = spark.read.parquet(f"{data}/item_events.parquet").collect()
    return {r.item_id: r for r in rows}  # copies differ in the instructor only


def test_ranges(spark):
    texts = [None, "", "2026-05-01", "2026-05-09T10:00", "2026-07-02", "2027-01-01", "2026-05", "2026", "20260512", "20260514", "12/05/2026", "a definir"]
    rows = [(a, b) for a in texts for b in texts]
    df = spark.createDataFrame(rows, "a string, b string")
    got = df.select("a", "b", dates.fmt_date(df.a).alias("one"), dates.fmt_range(df.a, df.b).alias("both")).collect()
    assert [(r.one, r.both) for r in got] == [(one(a), both(a, b)) for a, b in rows]


def test_every_event_has_its_dates(spark, data):
    e = events(spark, data)
    got = entry.queries()["date_range_fmt"](spark, data).collect()
    assert sorted((r.item_id, r.one or "", r.both or "") for r in got) == sorted((k, one(r.starts_at) or "", both(r.starts_at, r.ends_at) or "") for k, r in e.items())


def test_every_agenda_event_has_its_line(spark, data):
    agenda = {r.item_id: both(r.starts_at, r.ends_at) for r in entry.queries()["future_events"](spark, data).collect()}
    got = entry.queries()["agenda_lines"](spark, data).collect()
    assert {r.item_id: r.when_text for r in got} == agenda and len(got) == len(agenda)


def test_every_event_is_merged(spark, data):
    e = events(spark, data)
    got = entry.queries()["event_upsert_preserve"](spark, data).collect()
    want = {}
    for k, r in e.items():
        old, new = k % 5 != 0, k % 2 == 0 or k % 5 == 0
        want[k] = (r.city and r.city.upper() if new else r.city, *((r.lineage, r.region, r.org_id) if old else "xyz"), "kept" if not new else "updated" if old else "new")
    assert {r.item_id: tuple(r[1:]) for r in got} == want and len(got) == len(want)


def test_orders(spark, data):
    from driftwell.operators import views

    q = entry.queries()
    low = lambda t: (t is not None, t or "")
    got = [(low(r.starts_at), r.item_id) for r in q["agenda_ordered"](spark, data).collect()]
    assert got == sorted(got) and len(got) > 5
    orgs = [tuple(map(low, (r.country, r.kind, r.name))) for r in q["orgs_ordered"](spark, data).collect()]
    assert orgs == sorted(orgs)
    sources = [(r.priority, r.id) for r in q["sources_ordered"](spark, data).collect()]
    assert sources == sorted(sources)
    news = [r.published_at for r in views.news_ordered(q["recent_news_month"](spark, data)).collect()]
    assert news == sorted(news, reverse=True)
    assert [r.section for r in q["home_top"](spark, data).collect()] == ["events"] * 3 + ["news"] * 5
