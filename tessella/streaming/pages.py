"""Streams of pages: records as files arrive, roll-ups over what has come, and the cache as keyed state."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from tessella.operators.readiness import diagnose
from tessella.operators.records import records
from tessella.schema import CrawlOptions

PAGES = "page_id long, url string, html string"


def page_stream(spark: SparkSession, folder: str, per_trigger: int | None = None) -> DataFrame:
    """SS1: pages as Parquet files arrive in a folder."""
    reader = spark.readStream.schema(PAGES)
    return (reader.option("maxFilesPerTrigger", per_trigger) if per_trigger else reader).parquet(folder)


def record_stream(pages: DataFrame, options: CrawlOptions | None = None) -> DataFrame:
    """SS1: the same projection as over a table; append mode."""
    return records(pages, options)


def readiness_stream(pages: DataFrame, contract: str = "docs-page", options: CrawlOptions | None = None) -> DataFrame:
    """SS3: contract, verdict, n, meanScore over all pages so far; complete or update mode."""
    found = diagnose(records(pages, options or CrawlOptions(extractMarkdown=True)), contract)
    return found.groupBy("contract", "verdict").agg(F.count("*").alias("n"), F.avg("score").alias("meanScore"))


class TtlCache(StatefulProcessor):
    """SS2 for one key: an entry lives ``ttl`` seconds from when it was written; reads don't extend it.

    Input: key, id, t (seconds). Output: key, id, hit. Requests of a batch are taken in order of time.
    """

    def __init__(self, ttl: float):
        self.ttl = ttl

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.expiry = handle.getValueState("expiry", "expiry double")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        asked = pd.concat(list(rows)).sort_values(["t", "id"])
        got = self.expiry.get() if self.expiry.exists() else None
        expiry, hits = (got[0] if got else None), []
        for t in asked["t"]:
            hit = expiry is not None and t <= expiry
            if not hit:
                expiry = t + self.ttl
            hits.append(hit)
        self.expiry.update((float(expiry),))
        yield pd.DataFrame({"key": key[0], "id": asked["id"], "hit": hits})

    def close(self) -> None:
        pass


def cache_stream(requests: DataFrame, ttl: float) -> DataFrame:
    """SS2: which requests (key, id, t) of a stream the cache answers."""
    return requests.groupBy("key").transformWithStateInPandas(TtlCache(ttl), outputStructType="key long, id long, hit boolean", outputMode="Append", timeMode="None")


_CURRENT: list = []


def current_cache(capacity: int, ttl: float) -> LruCache:
    """SS5: the process's cache; other settings than before give a new, empty one."""
    if not _CURRENT or _CURRENT[0] != (capacity, ttl):
        _CURRENT[:] = [(capacity, ttl), LruCache(capacity, ttl)]
    return _CURRENT[1]


class LruCache:
    """SS2, W7: the bounded cache itself, for one fetcher process: capacity evicts what was used longest ago, also when a key is written again."""

    def __init__(self, capacity: int, ttl: float):
        self.capacity, self.ttl = capacity, ttl
        self.entries: dict[str, tuple[object, float]] = {}

    def get(self, key: str, now: float) -> object | None:
        entry = self.entries.pop(key, None)
        if entry is None or now > entry[1]:
            return None
        self.entries[key] = entry
        return entry[0]

    def put(self, key: str, value: object, now: float) -> None:
        if len(self.entries) >= self.capacity:
            del self.entries[next(iter(self.entries))]
        self.entries[key] = (value, now + self.ttl)
