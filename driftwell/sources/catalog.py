"""The catalogue of sources: configuration, endpoints, blocklist, robots."""

from __future__ import annotations

import urllib.robotparser
from urllib.parse import urlsplit

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from driftwell.functions import text

SOURCE = T.StructType([
    T.StructField("id", T.StringType(), False), T.StructField("name", T.StringType()), T.StructField("url", T.StringType()), T.StructField("country", T.StringType()),
    T.StructField("lang", T.ArrayType(T.StringType())), T.StructField("lineage", T.StringType()), T.StructField("engine", T.StringType()),
    T.StructField("endpoints", T.MapType(T.StringType(), T.StringType())), T.StructField("cadence", T.StringType()), T.StructField("priority", T.IntegerType()),
])
CONFIG = ["name", "url", "country", "lineage", "engine", "cadence", "priority"]


def load_yaml(spark: SparkSession, path: str, key: str = "sources", schema: T.StructType = SOURCE) -> DataFrame:
    """Catalogue file (hundreds of rows) as a table."""
    import yaml

    with open(path, encoding="utf-8") as f:
        rows = yaml.safe_load(f)[key]
    return spark.createDataFrame([tuple(r.get(c.name) for c in schema) for r in rows], schema)


def sync(old: DataFrame, config: DataFrame) -> DataFrame:
    """Configuration replaces configuration, state stays, sources gone from the file stay."""
    a = old.select("id", F.struct(*[c for c in old.columns if c != "id"]).alias("o"))
    b = config.select("id", F.struct(*CONFIG).alias("n"))
    both = a.join(b, "id", "full_outer")
    cols = [F.when(F.col("n").isNull(), F.col(f"o.{c}")).otherwise(F.col(f"n.{c}")).alias(c) for c in CONFIG]
    return both.select("id", *cols, F.coalesce("o.robots", F.lit("pending")).alias("robots"), F.coalesce("o.active", F.lit(1)).alias("active"))


def site(url: Column) -> Column:
    return F.regexp_extract(url, r"^[a-z]+://[^/?#]+", 0)


def endpoint(engine: Column, url: Column, endpoints: Column | None = None) -> Column:
    """Override of the engine, else the engine's own address, else the url."""
    wp = F.concat(site(url), F.lit("/wp-json/wp/v2/posts?per_page=20&_fields=id,link,title,excerpt,date_gmt,modified_gmt"))
    built = F.when(engine == "wp_json", wp).when(engine == "rss", F.concat(F.regexp_replace(url, r"/+\z", ""), F.lit("/feed/"))).otherwise(url)
    return F.coalesce(F.try_element_at(endpoints, engine), built) if endpoints is not None else built


def allowed(df: DataFrame, blocklist: DataFrame, url: str = "url") -> DataFrame:
    """Rows whose host is no blocked domain and no subdomain of one.

    Every suffix of the host is looked up by an equal-key anti join, so this is no theta join.
    """
    host = text.host(F.col(url))
    parts = F.split("__host", "\\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "."))
    domains = blocklist.select(F.lower("domain").alias("domain")).distinct()
    hosts = df.select(host.alias("__host")).filter("__host is not null").distinct()  # each host is looked up once
    blocked = hosts.select("__host", F.explode(suffixes).alias("domain")).join(domains, "domain", "left_semi").select("__host").distinct()
    return df.withColumn("__host", host).join(blocked, "__host", "left_anti").drop("__host")


def robots_allows(status: int | None, body: str, url: str, agent: str) -> bool:
    """5xx denies; 4xx and no answer allow; else what the file says."""
    if status is not None and status >= 500:
        return False
    if status is None or status >= 400:
        return True
    p = urllib.robotparser.RobotFileParser()
    p.parse(body.splitlines())
    return p.can_fetch(agent, url)


def robots_per_host(checks: DataFrame) -> DataFrame:
    """host, allowed: the verdict of the first url of each host in a run (E16). checks: url, at, allowed."""
    return checks.groupBy(text.host(F.col("url")).alias("host")).agg(F.min_by("allowed", F.struct("at", "url")).alias("allowed"))


def transitions(sources: DataFrame, outcomes: DataFrame) -> DataFrame:
    """Sources after a run: blocked ones inactive, robots verdicts kept (U6). outcomes: source_id, outcome."""
    o = outcomes.select(F.col("source_id").alias("id"), "outcome")
    df = sources.join(o, "id", "left")
    active = F.when(F.col("outcome") == "blocked", 0).otherwise(F.col("active"))
    robots = F.when(F.col("outcome") == "robots", "disallowed").when(F.col("outcome").isNotNull() & (F.col("outcome") != "blocked"), "allowed").otherwise(F.col("robots"))
    return df.withColumn("active", active).withColumn("robots", robots).drop("outcome")


def select(sources: DataFrame, ids: list[str] | None = None, cadence: str | None = None) -> DataFrame:
    """By id, by cadence, or all; active is not looked at."""
    if ids:
        return sources.filter(F.col("id").isin(ids))
    return sources.filter(F.col("cadence") == cadence) if cadence else sources


def hostname(url: str) -> str:
    return (urlsplit(url).hostname or "").removeprefix("www.")
