"""Raw payload store: parquet with a binary body, partitioned by source and UTC day, and its replay."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from driftwell.functions import text


def write(payloads: DataFrame, path: str) -> None:
    """Append payloads (S9). Rows are grouped by partition before the write, so a task writes few files; hot sources are spread by hash."""
    df = payloads.withColumn("day", F.substring("fetched_at", 1, 10))
    df.repartition("source_id", "day", F.pmod(F.xxhash64("content_hash"), F.lit(8))).write.mode("append").partitionBy("source_id", "day").parquet(path)


def replay(spark: SparkSession, path: str) -> DataFrame:
    """Stored payloads with the kind that their first characters show."""
    df = spark.read.parquet(path)
    return df.withColumn("kind", text.payload_kind(F.decode("body", "UTF-8")))


def raw_path() -> Column:
    """Path text of a payload's row: raw/{source}/{day}/{hash}.{kind}."""
    return F.concat(F.lit("raw/"), F.col("source_id"), F.lit("/"), F.substring("fetched_at", 1, 10), F.lit("/"), F.col("content_hash"), F.lit("."), F.col("kind"))
