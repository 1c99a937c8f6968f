"""Versioned tables: a new version is written beside the old ones, then a pointer file of its own makes it count."""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from driftwell.session import cut_lineage

#: Parts by key hash in which a merged table is kept: a merge rewrites the parts that its keys fall in, and no other.
BUCKETS = 64


def _fs(spark: SparkSession, path: str):
    jpath = spark._jvm.org.apache.hadoop.fs.Path(path)
    return jpath.getFileSystem(spark._jsc.hadoopConfiguration())


def _path(spark: SparkSession, *parts: str):
    return spark._jvm.org.apache.hadoop.fs.Path("/".join(parts))


def _versions(spark: SparkSession, table: str) -> list[int]:
    """Numbers of the committed versions."""
    fs, folder = _fs(spark, table), _path(spark, table)
    if not fs.exists(folder):
        return []
    names = (f.getPath().getName() for f in fs.listStatus(folder))
    return sorted(int(n.rpartition(".")[2]) for n in names if n.startswith("CURRENT.") and n.rpartition(".")[2].isdigit())


def current(spark: SparkSession, table: str) -> str | None:
    """Folder of the current version, the highest committed one; null for a new table."""
    found = _versions(spark, table)
    return f"{table}/v{found[-1]}" if found else None


def _layout(spark: SparkSession, table: str) -> dict[int, int] | None:
    """Bucket -> version that holds it; null for a table without buckets."""
    found = _versions(spark, table)
    if not found:
        return None
    stream = _fs(spark, table).open(_path(spark, table, f"CURRENT.{found[-1]}"))
    try:
        text = spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()
    return {int(b): v for b, v in json.loads(text).items()} if text else None


def _parts(spark: SparkSession, table: str, layout: dict[int, int]) -> DataFrame | None:
    paths = [f"{table}/v{v}/__bucket={b}" for b, v in sorted(layout.items())]
    return spark.read.parquet(*paths) if paths else None


def read(spark: SparkSession, table: str) -> DataFrame | None:
    layout = _layout(spark, table)
    if layout is not None:
        return _parts(spark, table, layout)
    at = current(spark, table)
    return spark.read.parquet(at) if at else None


def bucket(key: str) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(BUCKETS)).cast("int")


def merge(new: DataFrame, table: str, key: str, schema, how: Callable[[DataFrame, DataFrame], DataFrame], state: str = "merge_state") -> DataFrame:
    """Rows of the buckets that *new* falls in after *how*(old rows, new rows), with *state*; they become the next version.

    Only these buckets are read and written; the pointer names the version of every bucket. A table without buckets is
    put into buckets by its first merge. Where nothing is new or updated, nothing is written. Columns that an older version lacks are null.
    """
    spark = new.sparkSession
    touched = {r[0] for r in new.select(bucket(key)).distinct().collect()}  # at most BUCKETS numbers
    layout = _layout(spark, table)
    whole = read(spark, table) if layout is None else None
    old = whole if layout is None else _parts(spark, table, {b: v for b, v in layout.items() if b in touched})
    empty = spark.createDataFrame([], schema)
    old = empty if old is None else old.select(*[(F.col(f.name) if f.name in old.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in empty.schema])
    out = cut_lineage(how(old, new))
    if out.filter(F.col(state).isin("new", "updated")).isEmpty():
        return out
    n = (_versions(spark, table) or [0])[-1] + 1
    out.drop(state).withColumn("__bucket", bucket(key)).repartition("__bucket").write.mode("overwrite").partitionBy("__bucket").parquet(f"{table}/v{n}")
    if whole is not None:
        touched |= {r[0] for r in whole.select(bucket(key)).distinct().collect()}
    stream = _fs(spark, table).create(_path(spark, table, f"CURRENT.{n}"), False)
    stream.write(json.dumps({**(layout or {}), **dict.fromkeys(touched, n)}).encode())
    stream.close()
    return out


def commit(df: DataFrame, table: str) -> str:
    """Write *df* as the next version and make it the current one.

    A version counts from the moment its own pointer file exists: nothing is ever renamed or deleted, so a reader sees the old
    version or the new one, and a failed write leaves the old one in place.
    """
    spark = df.sparkSession
    n = (_versions(spark, table) or [0])[-1] + 1
    df.write.mode("overwrite").parquet(f"{table}/v{n}")
    _fs(spark, table).create(_path(spark, table, f"CURRENT.{n}"), False).close()
    return f"{table}/v{n}"


def append(df: DataFrame, table: str) -> None:
    """Append-only tables (fetch and probe logs): rows are added, none is changed."""
    df.write.mode("append").parquet(table)
