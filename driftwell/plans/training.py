"""Queries of the general training-data operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from driftwell.operators import timestamps
from driftwell.sources.tables import table


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    """field, row_key, utc of every readable time."""
    return timestamps.readable_times(
        table(spark, d, "items", "id", "source_id", "published_at"),
        table(spark, d, "item_events", "item_id", "starts_at", "tz"),
        table(spark, d, "news_records", "id", "source_id", "news_date"),
        table(spark, d, "sources", "id", "tz", "country"),
    )


QUERIES = {"p6_found": p6_found}
ORACLES: dict[str, str] = {}
