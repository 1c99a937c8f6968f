"""Structured Streaming over the fetch log: what the batch operators compute, kept up to date.

State is one small record a key. Rows of a key are ordered by (time, id) inside a micro-batch; a row older
than the state's last one is late: it gets a null result and is counted, never reordered. What one key
holds at a time is its rows of one micro-batch, so a busy log sets maxFilesPerTrigger on its source.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

CHANGE = "id long, source_id string, endpoint string, previous_hash string, changed_now int, late int"
STREAK = "source_id string, fetched_at string, streak long, alert string, late long"


def change_detection(log: DataFrame) -> DataFrame:
    """id, previous_hash, changed_now of each row as it comes (W1); state: the last hash of (source, endpoint)."""

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last_hash, last_at = state.get if state.exists else (None, "")
        rows = []
        for r in pd.concat(list(frames)).sort_values(["fetched_at", "id"]).itertuples(index=False):
            if r.fetched_at < last_at:
                rows.append((r.id, *key, None, None, 1))
                continue
            last_at = r.fetched_at
            good = r.http_status == 200 and isinstance(r.content_hash, str)
            rows.append((r.id, *key, last_hash, int(r.content_hash != last_hash) if good and last_hash is not None else None, 0))
            last_hash = r.content_hash if good else last_hash
        state.update((last_hash, last_at))
        yield pd.DataFrame(rows, columns=[c.split(" ")[0] for c in CHANGE.split(", ")]).astype({"changed_now": "Int32"})

    some = log.select("id", "source_id", "endpoint", "fetched_at", "http_status", "content_hash")
    return some.groupBy("source_id", "endpoint").applyInPandasWithState(step, CHANGE, "hash string, at string", "append", GroupStateTimeout.NoTimeout)


def fail_streaks(log: DataFrame, at: int = 3) -> DataFrame:
    """source_id, streak and alert (opened, closed or null) after each micro-batch (W2, W6); state: the streak."""

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        streak, last_at, late = (*state.get, 0) if state.exists else (0, "", 0)
        before = streak
        for r in pd.concat(list(frames)).sort_values(["fetched_at", "id"]).itertuples(index=False):
            if r.fetched_at < last_at:
                late += 1
                continue
            last_at = r.fetched_at
            bad = bool(isinstance(r.error, str) and r.error) or (r.http_status == r.http_status and r.http_status is not None and r.http_status >= 400)
            streak = streak + 1 if bad else 0
        state.update((streak, last_at))
        alert = "opened" if streak >= at > before else "closed" if before >= at > streak else None
        yield pd.DataFrame([(*key, last_at, streak, alert, late)], columns=[c.split(" ")[0] for c in STREAK.split(", ")])

    some = log.select("id", "source_id", "fetched_at", "http_status", "error")
    return some.groupBy("source_id").applyInPandasWithState(step, STREAK, "streak long, at string", "update", GroupStateTimeout.NoTimeout)


def counts_per_window(log: DataFrame, window: str = "7 days", late: str = "2 days") -> DataFrame:
    """source_id, window_start, probes, changes per tumbling window, with a watermark for late rows (A1).

    A log row that comes again within the watermark counts once; rows without a readable time are left out.
    """
    at = F.col("fetched_at").try_cast("timestamp")
    df = log.withColumn("__at", at).filter("__at is not null").withWatermark("__at", late).dropDuplicatesWithinWatermark(["id"])
    return df.groupBy("source_id", F.window("__at", window)).agg(F.count("*").alias("probes"), F.sum(F.coalesce("changed", F.lit(0))).cast("bigint").alias("changes")).select("source_id", F.col("window.start").alias("window_start"), "probes", "changes")


def merge_batches(items: DataFrame, merge: Callable[[DataFrame], None], checkpoint: str):
    """Each micro-batch of parsed items is merged by *merge* (U1): updates must pass, so no dropDuplicates; all rows that are there are taken, then it ends."""
    return items.writeStream.foreachBatch(lambda batch, _: merge(batch)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def file_stream(spark, path: str, schema) -> DataFrame:
    return spark.readStream.schema(schema).parquet(path)
