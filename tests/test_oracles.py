"""Every query with SQL against DuckDB on the same files, as the driver does it."""

import duckdb
import pytest

import __spark_entry__ as entry

D = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings sources lineages orgs fetches raw_pages items item_events news_records places countries subjects subject_examples".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{D}/{t}.parquet'")
    return con


def norm(v):
    return round(v, 9) if isinstance(v, float) else v


@pytest.mark.parametrize("name", sorted(entry.oracle_sql()))
def test_query(spark, duck, name):
    cur = duck.execute(entry.oracle_sql()[name])
    cols = [c[0] for c in cur.description]
    want = sorted((tuple(norm(r[i]) for i in sorted(range(len(cols)), key=cols.__getitem__)) for r in cur.fetchall()), key=str)
    df = entry.queries()[name](spark, D)
    assert sorted(df.columns) == sorted(cols)
    got = sorted((tuple(norm(r[c]) for c in sorted(cols)) for r in df.collect()), key=str)
    assert len(got) == len(want)
    assert got == want


def test_every_oracle_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_entry(spark):
    assert entry.entry(spark).count() > 0
