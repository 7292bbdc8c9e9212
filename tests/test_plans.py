"""Registered queries against their SQL on the smallest tables, and what SQL can't show."""

import glob
import os

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from tessella.plans import registry

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no tables")


def plain(v):
    if isinstance(v, float):
        return None if v != v else round(v, 6)
    return v


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for p in glob.glob(f"{DATA}/*.parquet"):
        con.sql(f"create view {os.path.basename(p)[:-8]} as select * from '{p}'")
    return con


@pytest.mark.parametrize("name", sorted(registry.ORACLE_SQL))
def test_query_equals_sql(spark, duck, name):
    df = registry.QUERIES[name](spark, DATA)
    want = duck.sql(registry.ORACLE_SQL[name])
    assert sorted(df.columns) == sorted(want.columns)
    cols = sorted(df.columns)
    got = sorted(repr([plain(r[c]) for c in cols]) for r in df.collect())
    at = [want.columns.index(c) for c in cols]
    assert got == sorted(repr([plain(r[i]) for i in at]) for r in want.fetchall())


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.ORACLE_SQL)))
def test_other_queries_run(spark, name):
    assert registry.QUERIES[name](spark, DATA).count() > 0


def test_entry(spark):
    assert entry.entry(spark).count() > 0


def test_one_python_stage_for_the_flagship(spark):
    plan = registry.QUERIES[registry.FLAGSHIP](spark, DATA)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("MapInArrow") == 1


def test_palette_ignores_the_order_of_hits(spark):
    from tessella.operators.brand import palettes

    rows = [(1, "#112233", "a", 0.1), (1, "#ff0000", "b", 0.3), (1, "#fe0102", "c", 0.2), (1, "#00ff00", "style:var--brand", 0.1), (1, "#ffffff", "d", 9.0)]
    kind = "page_id long, value string, source string, weight double"
    a, b = (palettes(spark.createDataFrame(r, kind)).collect() for r in (rows, rows[::-1]))
    assert a == b
    got = {p.hex: (p.role, p.weight) for p in a[0].palette}
    assert got == {"#ff0000": (None, 0.5), "#00ff00": ("primary", 0.1), "#112233": ("background", 0.1)} or got["#00ff00"][0] == "primary"
    grey = palettes(spark.createDataFrame([(1, "#111111", "a", 1.0), (1, "#eeeeee", "b", 2.0)], kind)).first()
    assert [(p.hex, p.role) for p in grey.palette] == [("#111111", "primary"), ("#eeeeee", "background")]


def test_report_and_records(spark):
    from tessella.operators.readiness import diagnose, report
    from tessella.operators.records import records
    from tessella.schema import PAGE_FIELDS

    pages = spark.createDataFrame([(1, "https://a/", "<title>T</title><body>Access denied</body>", None), (2, "https://b/", None, "HTTP 429")], "page_id long, url string, html string, error string").withColumn("statusCode", F.lit(200))
    r = records(pages)
    assert r.columns == ["page_id", *PAGE_FIELDS]
    rows = {x.page_id: x for x in r.collect()}
    assert (rows[1].status, rows[1].errorType, rows[1].errorRetryable) == ("error", "blocked-bot", False)
    assert (rows[2].status, rows[2].errorType, rows[2].errorRetryable) == ("error", "rate-limit", True)
    text = report(diagnose(r)).first().report
    assert "Verdict: blocked" in text and "https://a/" in text and "Access denied" not in text


def test_empty_tables(spark):
    from tessella.operators.discover import discover
    from tessella.operators.graph import site_map
    from tessella.operators.readiness import diagnose, summarise
    from tessella.operators.records import records

    none = records(spark.createDataFrame([], "page_id long, url string, html string"))
    assert none.count() == 0 and summarise(diagnose(none)).count() == 0 and site_map(none).count() == 0 and discover(none).count() == 0


def test_listing_needs_more_than_one_item(spark):
    from tessella.operators.discover import record_types
    from tessella.operators.records import records

    ld = '<script type="application/ld+json">{"@type":"ItemList","itemListElement":[1,2,3]}</script>'
    pages = spark.createDataFrame([(1, "u", ld), (2, "u", "<table><tr><td>1<tr><td>2</table>")], "page_id long, url string, html string")
    assert {r.page_id: (r.recordType, r.itemCount) for r in record_types(records(pages)).collect()} == {1: ("listing", 3), 2: ("single", None)}


def test_crawl_ends_on_cycles(spark):
    from tessella.operators.graph import crawl

    links = spark.createDataFrame([("a", "b"), ("b", "a"), ("b", "c"), ("b", "gone")], "url string, href string")
    pages = spark.createDataFrame([("a",), ("b",), ("c",)], "url string")
    assert {tuple(r) for r in crawl(pages.filter("url = 'a'"), links, pages, 9).collect()} == {("a", 0), ("b", 1), ("c", 2)}


def test_embedding_count_is_checked(spark):
    from tessella.operators.embed import matched

    req = spark.createDataFrame([("k", 0, ["a", "b"])], "key string, batch int, input array<string>")
    res = spark.createDataFrame([("k", 0, '{"data":[{"embedding":[1]}]}')], "key string, batch int, response string")
    with pytest.raises(Exception, match="1 vectors for 2 inputs"):
        matched(req, res, "key").collect()
