"""Queries that run a stream or a parser; results that SQL can express have their SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from driftwell.functions import payloads
from driftwell.schemas import FETCH
from driftwell.session import shared_folder
from driftwell.sources.tables import table
from driftwell.streaming import logs


def _shared(spark: SparkSession) -> str:
    """A new folder under the session's checkpoint folder, which all executors share."""
    return f"{shared_folder(spark)}/streams/{uuid.uuid4().hex}"


def window_counts(spark: SparkSession, d: str) -> DataFrame:
    """source_id, window_start, probes, changes per week: the log read as a stream of files to its end (A1, §2.11)."""
    at = _shared(spark)
    # a glob stands for a file as well as for a folder of files
    counts = logs.counts_per_window(logs.file_stream(spark, f"{d}/fetches.parque[t]", FETCH).filter("fetched_at is not null"))

    def write(batch: DataFrame, n: int) -> None:
        batch.write.mode("overwrite").parquet(f"{at}/out/batch={n}")

    # update mode: windows that the watermark has passed leave the state; the last word of each window counts
    query = counts.writeStream.outputMode("update").foreachBatch(write).option("checkpointLocation", f"{at}/state").trigger(availableNow=True).start()
    query.awaitTermination()
    rows = spark.read.parquet(f"{at}/out").groupBy("source_id", "window_start").agg(F.max_by(F.struct("probes", "changes"), "batch").alias("last"))
    return rows.select("source_id", F.date_format("window_start", "yyyy-MM-dd").alias("window_start"), "last.probes", "last.changes")


def visible_hash(spark: SparkSession, d: str) -> DataFrame:
    """raw_path, text_hash, text_len of each page's visible text."""
    text = payloads.batched(payloads.visible_text)
    return table(spark, d, "raw_pages", "raw_path", "body").withColumn("__t", text("body")).select("raw_path", F.substring(F.sha2("__t", 256), 1, 16).alias("text_hash"), F.char_length("__t").alias("text_len"))


def json_field(spark: SparkSession, d: str) -> DataFrame:
    """event_id, k of the events' JSON properties."""
    return table(spark, d, "events", "event_id", "props").select("event_id", F.get_json_object("props", "$.k").alias("k"))


QUERIES = {"streaming_window_counts": window_counts, "visible_text_hash": visible_hash, "json_field": json_field}
ORACLES = {
    "streaming_window_counts": "SELECT source_id, strftime(make_timestamp(CAST(floor(epoch_us(CAST(fetched_at AS TIMESTAMPTZ)) / 604800000000) AS BIGINT) * 604800000000), '%Y-%m-%d') AS window_start, count(*) AS probes, CAST(sum(coalesce(changed, 0)) AS BIGINT) AS changes FROM (SELECT DISTINCT * FROM fetches) WHERE fetched_at IS NOT NULL GROUP BY 1, 2",
    "json_field": "SELECT event_id, json_extract_string(props, '$.k') AS k FROM events",
}
