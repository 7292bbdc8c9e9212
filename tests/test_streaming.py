"""Streams give what the tables give."""

import os

import pytest
from pyspark.sql import functions as F

from tessella.operators.graph import cache_log
from tessella.streaming.pages import cache_stream, page_stream, readiness_stream, record_stream

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no tables")


def run(df, name, mode, tmp_path):
    q = df.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", str(tmp_path / name)).start()
    q.processAllAvailable()
    q.stop()


def test_records_and_readiness(spark, tmp_path):
    from tessella.operators.readiness import diagnose
    from tessella.operators.records import records
    from tessella.schema import CrawlOptions

    folder = str(tmp_path / "pages")
    pages = spark.read.parquet(f"{DATA}/pages.parquet")
    pages.repartition(4).write.parquet(folder)
    run(record_stream(page_stream(spark, folder, 1)).select("url", "title"), "recs", "append", tmp_path)
    assert {tuple(r) for r in spark.table("recs").collect()} == {tuple(r) for r in records(pages).select("url", "title").collect()}
    run(readiness_stream(page_stream(spark, folder, 2)), "ready", "complete", tmp_path)
    want = diagnose(records(pages, CrawlOptions(extractMarkdown=True))).groupBy("contract", "verdict").agg(F.count("*").alias("n"), F.avg("score").alias("meanScore"))
    assert {tuple(r) for r in spark.table("ready").collect()} == {tuple(r) for r in want.collect()}


def test_cache_state(spark, tmp_path):
    log = spark.createDataFrame([(1, 1, 0.0), (1, 2, 300.0), (1, 3, 301.0), (1, 4, 500.0), (2, 5, 10.0)], "key long, id long, t double")
    hits = {r.id: r.hit for r in cache_log(log, 300, "key", "t").collect()}
    assert hits == {1: False, 2: True, 3: False, 4: True, 5: False}
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    folder = str(tmp_path / "log")
    log.coalesce(1).write.parquet(folder)
    try:
        run(cache_stream(spark.readStream.schema(log.schema).parquet(folder), 300), "hits", "append", tmp_path)
    except Exception as e:
        if "google.protobuf" in str(e) or "protobuf" in str(e):
            pytest.skip("keyed state needs protobuf")
        raise
    assert {r.id: r.hit for r in spark.table("hits").collect()} == hits
