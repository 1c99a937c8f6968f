"""Connectors to the outside as interfaces; the ones here replay captures, so nothing needs a network.

fetch_all() keeps each host polite under parallelism: all requests of a host go to one partition and run one
after the other with a pause.
"""

from __future__ import annotations

import random
import time
from collections.abc import Callable, Iterator
from typing import Protocol

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftwell.functions import text

#: What a fetch of one row returns.
RESULT = "source_id string, endpoint string, http_status int, latency_ms int, etag string, last_modified string, error string, body binary"
TRIES, PAUSE = 3, (1.0, 2.0)


class Fetcher(Protocol):
    """(url, etag, last_modified) -> (status, headers, body); raises OSError on network errors."""

    def __call__(self, url: str, etag: str | None, last_modified: str | None) -> tuple[int, dict[str, str], bytes]: ...


def with_retries(fetch: Fetcher, url: str, etag: str | None, last_modified: str | None, sleep: Callable[[float], None] = time.sleep) -> tuple[int, dict[str, str], bytes]:
    """Server errors and network errors are tried again after 1, 2, 4 s; the last server error is returned, the last network error raised."""
    for attempt in range(TRIES):
        try:
            status, headers, body = fetch(url, etag, last_modified)
            if status < 500 or attempt == TRIES - 1:
                return status, headers, body
        except OSError:
            if attempt == TRIES - 1:
                raise
        sleep(2.0**attempt)
    raise AssertionError


def fetch_all(requests: DataFrame, fetch: Fetcher, sleep: Callable[[float], None] = time.sleep) -> DataFrame:
    """One result for each row of *requests* (source_id, endpoint, etag, last_modified)."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        last: dict[str, float] = {}
        for frame in frames:
            rows = []
            for r in frame.itertuples(index=False):
                if r.host in last:
                    sleep(max(0.0, random.uniform(*PAUSE) - (time.monotonic() - last[r.host])))
                began = time.monotonic()
                try:
                    status, headers, body = with_retries(fetch, r.endpoint, r.etag, r.last_modified, sleep)
                    rows.append((r.source_id, r.endpoint, status, int((time.monotonic() - began) * 1000), headers.get("etag"), headers.get("last-modified"), None, None if status == 304 else body))
                except OSError as e:
                    rows.append((r.source_id, r.endpoint, None, int((time.monotonic() - began) * 1000), None, None, str(e)[:200], None))
                last[r.host] = time.monotonic()
            yield pd.DataFrame(rows, columns=[c.split(" ")[0] for c in RESULT.split(", ")], dtype="object")

    df = requests.select("source_id", "endpoint", "etag", "last_modified", text.host(F.col("endpoint")).alias("host"))
    return df.repartition("host").mapInPandas(run, RESULT)


class Replay:
    """Fetcher over captures: url -> (status, headers, body); unknown urls raise."""

    def __init__(self, captures: dict[str, tuple[int, dict[str, str], bytes]]):
        self.captures = captures

    def __call__(self, url: str, etag: str | None, last_modified: str | None) -> tuple[int, dict[str, str], bytes]:
        if url not in self.captures:
            raise OSError(f"no capture of {url}")
        status, headers, body = self.captures[url]
        return (304, headers, b"") if etag and headers.get("etag") == etag else (status, headers, body)


def works(probed: DataFrame) -> DataFrame:
    """source_id, kind, url, http_status, works: a candidate works if it answers 200 with XML or JSON (S26, F14). probed has content_type."""
    good = (F.col("http_status") == 200) & F.lower(F.coalesce("content_type", F.lit(""))).rlike("xml|json")
    return probed.select("source_id", "kind", "url", "http_status", good.cast("int").alias("works"))


def candidates(sources: DataFrame) -> DataFrame:
    """source_id, kind, url of the interfaces that a source may have."""
    base = F.regexp_replace("url", r"/+\z", "")
    kinds = F.array(F.struct(F.lit("rss").alias("kind"), F.concat(base, F.lit("/feed/")).alias("url")), F.struct(F.lit("wp_json").alias("kind"), F.concat(base, F.lit("/wp-json/wp/v2/posts?per_page=1")).alias("url")))
    return sources.select(F.col("id").alias("source_id"), F.inline(kinds))
