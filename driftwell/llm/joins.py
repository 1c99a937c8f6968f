"""Joins of many rows with a table that is usually small, without trusting that it is."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftwell.session import cut_lineage

#: A table of at most so many bytes is broadcast. A larger one is joined by key and a salt, over SALTS parts of each key.
BROADCAST_BYTES, SALTS = 32 << 20, 32


def bytes_of(df: DataFrame) -> int:
    """Bytes of all values, 16 for each that is no text or array."""
    size = [F.coalesce(F.octet_length(c), F.lit(0)) + 16 if t == "string" else F.coalesce(F.size(c), F.lit(0)) * 8 + 16 if t.startswith("array") else F.lit(16) for c, t in df.dtypes]
    return df.agg(F.sum(reduce(lambda a, b: a + b, size).cast("bigint"))).first()[0] or 0


def spread_join(rows: DataFrame, small: DataFrame, on: list[str], how: str, salt_by: list[str]) -> DataFrame:
    """rows joined with small (left or inner): no key's rows meet in one task, however many rows share it.

    small is written once and measured: broadcast up to BROADCAST_BYTES, else repeated for each salt, which
    rows take from the hash of *salt_by*.
    """
    small = cut_lineage(small)
    if bytes_of(small) <= BROADCAST_BYTES:
        return rows.join(F.broadcast(small), on, how)
    salted = small.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return rows.withColumn("__salt", F.pmod(F.xxhash64(*salt_by), F.lit(SALTS)).cast("int")).join(salted, [*on, "__salt"], how).drop("__salt")


#: Share of the rows from which on a key counts as hot: at most 1 / HOT_SHARE keys can.
HOT_SHARE = 1e-3


def look_up(rows: DataFrame, table: DataFrame, key: str, value: str) -> DataFrame:
    """*rows* with *value* of their key in *table* (one row a key, of any size), null where there is none.

    Keys that a share of the rows have are few by that share: they are looked up by broadcast. They and rows without a
    key ('' or null) then take keys of their own in the join of the others, so they spread over its tasks.
    """
    counts = rows.filter(F.coalesce(F.col(key), F.lit("")) != "").groupBy(key).agg(F.count("*").alias("__n"))
    total = rows.count()
    hot = counts.filter(F.col("__n") >= max(2.0, HOT_SHARE * total)).select(key).join(table, key, "left").select(key, F.lit(True).alias("__hot"), F.col(value).alias("__value"))
    found = rows.join(F.broadcast(hot), key, "left")
    alone = F.coalesce("__hot", F.lit(False)) | (F.coalesce(F.col(key), F.lit("")) == "")
    found = found.withColumn("__key", F.when(alone, F.concat(F.lit("\0"), F.monotonically_increasing_id().cast("string"))).otherwise(F.col(key)))
    cold = table.select(F.col(key).alias("__key"), F.col(value).alias("__cold"))
    return found.join(cold, "__key", "left").withColumn(value, F.coalesce("__value", "__cold")).drop("__key", "__hot", "__value", "__cold")
