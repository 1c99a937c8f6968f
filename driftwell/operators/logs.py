"""Operators over append-only fetch and probe logs.

Rows are ordered by (time, id); a log row is unique by its id, so equal copies are made one first. The catalogue is
fixed and the log grows, so one source can hold a third of all rows: no window spans a whole source. Streaks
and last changes are partial aggregates; the previous hash is found within a day, and days are chained by one row each;
the newest n rows of a key are cut to n in every task before the shuffle (Spark's window group limit).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from driftwell.functions import dates, text

#: Rows that the alert streak looks back on, and failures in a row that raise one.
LOOK_BACK, ALERT_AT = 10, 3


def unique_log(fetches: DataFrame, key: str = "id") -> DataFrame:
    """Log rows, copies once."""
    return fetches.dropDuplicates([key])


def change_detection(log: DataFrame, keys: list[str], order: list[str], hash_col: str = "content_hash", status_col: str | None = "http_status") -> DataFrame:
    """*log* with changed_now: null for a first hash, 0 the same as before, 1 another.

    The hash before is the last non-null one of the same keys among rows of status 200; other rows
    get a null change. With status_col None every row with a hash counts (probes hash any answer).
    """
    counts = F.col(hash_col).isNotNull() & ((F.col(status_col) == 200) if status_col else F.lit(True))
    day = F.coalesce(F.substring(F.col(order[0]).cast("string"), 1, 10), F.lit(""))  # order by the text is order by its first letters first
    df = log.withColumns({"__h": F.when(counts, F.col(hash_col)), "__day": day})
    safe = {f"__k{i}": F.coalesce(F.col(k).cast("string"), F.lit("\0")) for i, k in enumerate(keys)}  # null keys are one key
    df = df.withColumns(safe)
    by = [*safe, "__day"]
    inside = Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    df = df.withColumn("__before", F.last("__h", ignorenulls=True).over(inside))
    # a row a key and day: the last hash of the days before
    days = log.withColumns({"__h": F.when(counts, F.col(hash_col)), "__day": day}).withColumns(safe).groupBy(*by).agg(F.max_by("__h", F.when(F.col("__h").isNotNull(), F.struct(*order))).alias("__last"))
    chain = Window.partitionBy(*safe).orderBy("__day").rowsBetween(Window.unboundedPreceding, -1)
    days = days.withColumn("__carried", F.last("__last", ignorenulls=True).over(chain)).drop("__last")
    df = df.join(days, by).withColumn("previous_hash", F.coalesce("__before", "__carried"))
    changed = F.when(F.col("__h").isNotNull() & F.col("previous_hash").isNotNull(), (F.col("__h") != F.col("previous_hash")).cast("int"))
    return df.withColumn("changed_now", changed).select(*log.columns, "previous_hash", "changed_now")


def outcome(log: DataFrame) -> DataFrame:
    """*log* (after change_detection) with outcome: what the ingest did with a row."""
    status, error = F.col("http_status"), F.coalesce("error", F.lit(""))
    o = (
        F.when(error.rlike("(?i)blocklist"), "blocked")
        .when(error.rlike("(?i)robots"), "robots")
        .when(error != "", "error")
        .when(status == 304, "not_modified")
        .when(status.isNull() | (status != 200), "http_error")
        .when(F.col("content_hash").isNull(), "parse_error")
        .when(F.col("previous_hash").isNull(), "baseline")
        .when(F.col("changed_now") == 0, "same")
        .otherwise("changed")
    )
    return log.withColumn("outcome", o)


def fail_streaks(log: DataFrame, sources: DataFrame, look_back: int | None = LOOK_BACK) -> DataFrame:
    """source_id, streak, last_error of active sources (W2-W4, J6): the failures in a row, newest first.

    look_back None counts without bound. A source never fetched has 0. The streak is the number of rows after the
    newest one that did not fail, looked at to look_back rows: two aggregates, no window.
    """
    at = F.struct("fetched_at", "id")
    rows = log.select("source_id", at.alias("at"), text.failed(F.col("error"), F.col("http_status")).alias("bad"), F.coalesce(F.nullif("error", F.lit("")), F.concat(F.lit("http_"), F.col("http_status"))).alias("what"))
    newest = rows.groupBy("source_id").agg(F.max(F.when(~F.col("bad"), F.col("at"))).alias("good"), F.max_by(F.struct(F.col("bad").alias("bad"), F.col("what").alias("what")), "at").alias("last"))
    after = rows.filter("bad").join(newest.select("source_id", "good"), "source_id").filter(F.col("good").isNull() | (F.col("at") > F.col("good")))
    per = after.groupBy("source_id").agg(F.count("*").alias("streak"))
    streak = F.coalesce("streak", F.lit(0)).cast("bigint")
    active = sources.filter("active = 1").select(F.col("id").alias("source_id"))
    out = active.join(newest, "source_id", "left").join(per, "source_id", "left")
    return out.select("source_id", (F.least(streak, F.lit(look_back).cast("bigint")) if look_back else streak).alias("streak"), F.when(F.col("last.bad"), F.col("last.what")).alias("last_error"))


def alert_lines(streaks: DataFrame, at: int = ALERT_AT, unknown: str = "desconhecido") -> DataFrame:
    """source_id, line: ALERT|id|streak|error or OK|id."""
    alert = F.concat_ws("|", F.lit("ALERT"), F.col("source_id"), F.col("streak").cast("string"), F.coalesce("last_error", F.lit(unknown)))
    return streaks.select("source_id", F.when(F.col("streak") >= at, alert).otherwise(F.concat(F.lit("OK|"), F.col("source_id"))).alias("line"))


def source_status(log: DataFrame, sources: DataFrame) -> DataFrame:
    """Active sources with last fetch, last success, last change, uncapped streak, health."""
    ok = text.succeeded(F.col("error"), F.col("http_status"))
    per = log.groupBy("source_id").agg(
        F.max("fetched_at").alias("last_fetch"),
        F.max(F.when(ok, F.col("fetched_at"))).alias("last_ok"),
        F.max(F.when(F.col("changed") == 1, F.col("fetched_at"))).alias("last_change"),
        F.count("*").alias("fetches"),
    )
    streak = fail_streaks(log, sources, None).withColumnRenamed("streak", "fail_streak")
    df = sources.filter("active = 1").select(F.col("id").alias("source_id"), "name", "priority").join(per, "source_id", "left").join(streak, "source_id")
    health = F.when(F.col("fail_streak") >= 3, "erro").when(F.col("fail_streak") > 0, "instável").when(F.col("last_fetch").isNull(), "aguardando").otherwise("ok")
    return df.select("source_id", "name", "priority", "last_fetch", "last_ok", "last_change", F.coalesce("fetches", F.lit(0)).cast("bigint").alias("fetches"), "fail_streak", "last_error", health.alias("health"), dates.minute_text(F.col("last_fetch")).alias("last_text"))


def cadence(log: DataFrame, key: str, at: str, changed: str, error: str) -> DataFrame:
    """Per key: probes, changes, errors, first, last, last_change, days_obs, interval_days, cadence (A1-A3)."""
    per = log.groupBy(key).agg(
        F.count("*").alias("probes"),
        F.sum(F.coalesce(F.col(changed), F.lit(0))).cast("bigint").alias("changes"),
        F.min(at).alias("first"),
        F.max(at).alias("last"),
        F.sum(F.when(F.col(error).isNotNull(), 1).otherwise(0)).cast("bigint").alias("errors"),
        F.max(F.when(F.col(changed) == 1, F.col(at))).alias("last_change"),
    )
    per = per.withColumn("days_obs", dates.span_days(F.col("first").cast("string"), F.col("last").cast("string")))
    gap = F.when(F.col("changes") > 0, F.col("days_obs") / F.col("changes"))
    # fixed values: the texts of the advice
    advice = (
        F.when(F.col("days_obs") < 7, "aguardando dados (≥7 dias)")
        .when(F.col("changes") == 0, "monthly (nenhuma mudança ainda — revisar aos 60d)")
        .when(gap <= 2, "daily")
        .when(gap <= 9, "weekly")
        .when(gap <= 20, "biweekly")
        .otherwise("monthly")
    )
    return per.withColumn("interval_days", gap).withColumn("cadence", advice)


def run_gate(outcomes: DataFrame, run: str) -> DataFrame:
    """Per run: sources, failed, exit_code 1 only if every source of a non-empty run failed.

    Network and parse errors fail a source; statuses, blocks and robots do not.
    """
    bad = F.col("outcome").isin("error", "parse_error")
    per = outcomes.groupBy(run).agg(F.count("*").alias("n"), F.sum(bad.cast("int")).cast("bigint").alias("failed"))
    return per.withColumn("exit_code", F.when(F.col("n") == F.col("failed"), 1).otherwise(0))


def latest_per_key(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The newest row of each key (S25, O9): one aggregate, no sort."""
    rest = [c for c in rows.columns if c not in keys]
    newest = rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("__r"))
    return newest.select(*keys, "__r.*")


def newest_n(rows: DataFrame, key: str, order: list[str], n: int) -> DataFrame:
    """The n newest rows of each key, with rn."""
    w = Window.partitionBy(key).orderBy(*[F.desc(c) for c in order])
    return rows.withColumn("rn", F.row_number().over(w)).filter(F.col("rn") <= n)
