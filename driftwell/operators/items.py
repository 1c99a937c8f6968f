"""Keyed merges and enrichment of items and events.

A parquet table has no MERGE: a merge is a join of old and new rows by key that yields the new version
of the table; store.commit() writes it beside the old one and then switches over.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from driftwell.functions import text

# Venues and cities whose country is known, cities of the southern region, regions of countries.
CITY_COUNTRY = {
    **dict.fromkeys(["tokyo budokan", "nippon budokan", "hombu dojo", "tanabe city", "iwama", "shingu"], "JP"),
    **dict.fromkeys(["paris", "vincennes", "lyon", "marseille"], "FR"),
    "berlin": "DE", "bologne": "IT", "bologna": "IT", "louvain la neuve": "BE", "ostrava": "CZ",
    **dict.fromkeys(["são paulo", "rio de janeiro", "curitiba", "florianópolis", "criciúma", "blumenau", "joinville", "itajaí", "balneário camboriú", "porto alegre", "viamão"], "BR"),
    "buenos aires": "AR", "córdoba": "AR", "santiago": "CL",
}
SOUTH = ["florianópolis", "criciúma", "blumenau", "joinville", "itajaí", "balneário camboriú", "curitiba", "londrina", "maringá", "porto alegre", "viamão", "caxias do sul", "pelotas"]
REGIONS = {"BR": "brasil", "JP": "japao", **dict.fromkeys("AR CL UY PY".split(), "america_sul"), **dict.fromkeys("FR DE IT BE ES CH PT GB CZ NL AT PL GR".split(), "europa")}


def upsert(old: DataFrame, new: DataFrame, key: str, changed: Column, update: dict[str, Column], state: str = "merge_state") -> DataFrame:
    """New version of *old* after *new* rows, with what became of each row in *state*.

    old and new have the same columns. changed and update are over ``old`` and ``new`` structs; columns
    not in *update* keep their old value. new must have one row a key (first_per_key()).
    """
    columns = old.columns
    a = old.select(F.col(key).alias("__k"), F.struct(*columns).alias("old"))
    b = new.select(F.col(key).alias("__k"), F.struct(*columns).alias("new"))
    both = a.join(b, "__k", "full_outer")
    s = F.when(F.col("old").isNull(), "new").when(F.col("new").isNull(), "kept").when(changed, "updated").otherwise("unchanged")
    both = both.withColumn(state, s)
    out = [F.when(F.col(state) == "new", F.col(f"new.{c}")).when(F.col(state) == "updated", update.get(c, F.col(f"old.{c}"))).otherwise(F.col(f"old.{c}")).alias(c) for c in columns]
    return both.select(*out, state)


def upsert_items(old: DataFrame, new: DataFrame) -> DataFrame:
    """Items by url; a changed hash updates title, summary, updated_at, hash and drops translations."""
    hashed = text.item_hash(F.col("title"), F.col("summary"), F.col("starts_at"), F.col("city")) if {"starts_at", "city"} <= set(new.columns) else text.item_hash(F.col("title"), F.col("summary"), F.lit(None).cast("string"), F.lit(None).cast("string"))
    new = new.withColumn("content_hash", hashed).select(*old.columns)
    takes = ["title", "summary", "updated_at", "content_hash"]
    update = {c: F.col(f"new.{c}") for c in takes} | {c: F.lit(None).cast("string") for c in ("title_pt", "summary_pt")}
    return upsert(old, new, "url", ~F.col("old.content_hash").eqNullSafe(F.col("new.content_hash")), update)


def upsert_events(old: DataFrame, new: DataFrame) -> DataFrame:
    """Events by item_id; lineage, region and org_id of a known event stay."""
    takes = ["starts_at", "ends_at", "tz", "city", "country", "online", "instructor"]
    return upsert(old, new, "item_id", F.lit(True), {c: F.col(f"new.{c}") for c in takes})


def insert_ignore(old: DataFrame, seed: DataFrame, key: str) -> DataFrame:
    """Rows of *seed* whose key is not there yet are added."""
    return old.unionByName(seed.join(old.select(key), key, "left_anti").select(*old.columns), allowMissingColumns=True)


def fill(df: DataFrame, column: str, by_id: dict[str, str], key: str = "id") -> DataFrame:
    """Values for named rows where the column is null."""
    return df.withColumn(column, F.coalesce(F.col(column), text.lookup(by_id, F.col(key))))


def first_per_key(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The first row of each key by *order* (A16, K3): one aggregate."""
    rest = [c for c in df.columns if c not in keys]
    return df.groupBy(*keys).agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("__r")).select(*keys, "__r.*")


def latest(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The last row of each key by *order*: one aggregate."""
    rest = [c for c in df.columns if c not in keys]
    return df.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("__r")).select(*keys, "__r.*")


def classify_pending(items: DataFrame) -> DataFrame:
    """Items with news and pages promoted by their titles, never demoted (E-1, F5); reclassified is 0 or 1."""
    found = F.when(F.col("type").isin("news", "page"), text.classify_type(F.col("title")))
    return items.withColumn("reclassified", found.isNotNull().cast("int")).withColumn("type", F.coalesce(found, F.col("type")))


def city_key(city: Column) -> Column:
    return F.lower(text.strip(city))


def region_for(country: Column, city: Column) -> Column:
    """South before country; an unknown country is outro; nothing known is null (E-3)."""
    return F.when(city_key(city).isin(SOUTH), "sul_br").when(F.coalesce(country, F.lit("")) != "", text.lookup(REGIONS, F.upper(country), F.lit("outro")))


def country_for_city(city: Column) -> Column:
    return text.lookup(CITY_COUNTRY, city_key(city))


def geocode_pending(events: DataFrame, items: DataFrame, sources: DataFrame) -> DataFrame:
    """Events with country, region and lineage filled where null (E-2, J12, U5), region from the filled country."""
    i = items.select(F.col("id").alias("item_id"), "source_id")
    s = sources.select(F.col("id").alias("source_id"), F.col("lineage").alias("__lineage"))
    df = events.join(i, "item_id").join(s, "source_id", "left")
    df = df.withColumn("country", F.coalesce("country", country_for_city(F.col("city"))))
    df = df.withColumn("region", F.coalesce("region", region_for(F.col("country"), F.col("city")))).withColumn("lineage", F.coalesce("lineage", "__lineage"))
    return df.select(*events.columns)


def translation_queue(items: DataFrame, cache: DataFrame | None = None) -> DataFrame:
    """hash, text, lang, batch of the unique strings to translate (E-4, F6, A16, W9).

    Portuguese strings are copied, cached ones are hits; the rest count once each, by hash. The number of
    a batch is by the order of the hashes: a range partitioning gives each partition its offset, so no
    single task numbers all strings.
    """
    want = items.filter("title_pt is null or (summary is not null and summary_pt is null)").filter("coalesce(lang, '') <> 'pt'")
    each = want.select("lang", F.explode(F.array(F.when(F.col("title_pt").isNull(), F.col("title")), F.when(F.col("summary_pt").isNull(), F.col("summary")))).alias("text")).filter(F.coalesce(text.strip(F.col("text")), F.lit("")) != "")
    each = each.withColumn("hash", text.text_hash(F.col("text")))
    if cache is not None:
        each = each.join(cache.select(F.col("content_hash").alias("hash")), "hash", "left_anti")
    return each.groupBy("hash").agg(F.min("text").alias("text"), F.min("lang").alias("lang"))


def batches(queue: DataFrame, size: int = 25, buckets: int = 256) -> DataFrame:
    """*queue* with batch: numbers of batches of *size* in the order of the hash (W9). Two-level count, no global window."""
    b = queue.withColumn("__b", F.conv(F.substring("hash", 1, 2), 16, 10).cast("int"))
    n = b.groupBy("__b").agg(F.count("*").alias("__n"))
    off = n.select("__b", F.coalesce(F.sum("__n").over(Window.orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("__o"))  # 256 rows
    rn = F.row_number().over(Window.partitionBy("__b").orderBy("hash"))
    return b.join(F.broadcast(off), "__b").withColumn("batch", F.floor((rn + F.col("__o") - 1) / size).cast("bigint")).drop("__b", "__o")


def translate(queue: DataFrame, translator: Callable[[list[tuple[str, str]]], dict[str, str]], size: int = 25) -> DataFrame:
    """hash, text_pt by an injected translator, *size* strings a call (E-4, S30, N3, N4). Missing answers stay pending."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            pairs = list(zip(f["hash"], f["text"], strict=True))
            out = {}
            for k in range(0, len(pairs), size):
                out |= translator(pairs[k : k + size])
            yield pd.DataFrame({"hash": list(out), "text_pt": list(out.values())}, dtype="object")

    return queue.select("hash", "text").mapInPandas(run, "hash string, text_pt string")


def backfill(items: DataFrame, cache: DataFrame) -> DataFrame:
    """Items with translations from the cache; Portuguese items copy their own text. Old translations stay."""
    out = items
    for column in ("title", "summary"):
        c = cache.select(F.col("content_hash").alias("__h"), F.col("text_pt").alias("__t"))
        h = F.when(F.col(column).isNotNull(), text.text_hash(F.col(column)))
        out = out.withColumn("__k", h).join(c, F.col("__k") == F.col("__h"), "left")
        filled = F.coalesce(F.col(f"{column}_pt"), F.when(F.col("lang") == "pt", F.col(column)).otherwise(F.col("__t")))
        out = out.withColumn(f"{column}_pt", filled).drop("__k", "__h", "__t")
    return out


def numbered(df: DataFrame, key: str, start: int, out: str = "id", buckets: int = 256) -> DataFrame:
    """*df* with numbers from *start* + 1 in *out*, in the order of the key's hash: a two-level count, no global window."""
    b = df.withColumn("__b", F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int"))
    n = b.groupBy("__b").agg(F.count("*").alias("__n"))
    off = n.select("__b", F.coalesce(F.sum("__n").over(Window.orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("__o"))  # at most *buckets* rows
    rn = F.row_number().over(Window.partitionBy("__b").orderBy(key))
    return b.join(F.broadcast(off), "__b").withColumn(out, (rn + F.col("__o") + start).cast("bigint")).drop("__b", "__o")


#: What a translation service must answer (N5): a list of translations, each with the number and the text.
ANSWER = "struct<translations: array<struct<id: int, pt: string>>>"


def requests(queue: DataFrame, size: int = 25) -> DataFrame:
    """batch, hashes, request: JSON arrays of {id, text}, *size* strings each; letters stay as they are."""
    each = batches(queue.select("hash", "text"), size).groupBy("batch").agg(F.sort_array(F.collect_list(F.struct("hash", "text"))).alias("x"))
    numbered_ = F.transform("x", lambda x, i: F.struct(i.alias("id"), x["text"].alias("text")))
    return each.select("batch", F.col("x.hash").alias("hashes"), F.to_json(numbered_).alias("request"))


def answers(sent: DataFrame) -> DataFrame:
    """hash, text_pt of requests() with an *answer*: the JSON decoded by ANSWER.

    An answer that is no such JSON, a translation without number or text, or with a number that was not sent, gives nothing: its
    strings stay pending (E25).
    """
    told = sent.select("hashes", F.from_json("answer", ANSWER)["translations"].alias("t")).select("hashes", F.inline("t"))
    good = told.filter("id between 0 and size(hashes) - 1 and pt is not null")
    return good.select(F.element_at("hashes", F.col("id") + 1).alias("hash"), F.col("pt").alias("text_pt")).groupBy("hash").agg(F.max("text_pt").alias("text_pt"))


def ask(sent: DataFrame, send: Callable[[str], str]) -> DataFrame:
    """requests() with answer and error: *send* takes and gives JSON. A request that fails has an error, the others go on."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            out = []
            for request in f["request"]:
                try:
                    out.append((send(request), None))
                except Exception as e:  # a failed call leaves its strings pending
                    out.append((None, f"{type(e).__name__}: {e}"[:200]))
            yield f.assign(answer=[a for a, _ in out], error=[e for _, e in out])

    return sent.mapInPandas(run, "batch bigint, hashes array<string>, request string, answer string, error string")
