"""What keeps work in proportion to the input and shared by all cores."""

import os

import pytest

from tessella.functions import urls
from tessella.functions.html import parse
from tessella.operators.parse import FLAT, parse_page
from tessella.plans import generated
from tessella.schema import CrawlOptions

DATA = "/root/testdata/sf0.001"
here = pytest.mark.skipif(not os.path.isdir(DATA), reason="no tables")

ODD = """<head><link rel=next href=2><base href=x><meta name=a content='b>c'><title>t <link rel="prev" href="1"></title><link rel="prev" href="0"
 ><noscript><img src="/n.png" alt='"'></noscript></head><body><p><img data-src="lazy.jpg" width = "7" src=""><meta property="og:x" content="&lt;"/><iframe><img src=no></iframe>
<link REL="canonical" HREF="/c" href="/d"><table><img/src=z.png><!-- <img src=hidden> --><img src="cut"""


def test_fields_of_single_elements_need_no_tree():
    every = (*FLAT, "title")  # the title needs the tree
    want = parse_page(ODD, "https://a.example/p/1", every, CrawlOptions())
    assert want["canonicalUrl"] == "/c" and len(want["images"]) == 4 and len(want["paginationLinks"]) == 2
    for f in FLAT:
        assert parse_page(ODD, "https://a.example/p/1", (f,), CrawlOptions()) == {f: want[f]}


def test_copies_end_at_the_element():
    doc = parse("<body><main><p>one</p><p class=x>two</p></main><p>three</p>")
    twin = doc.first("main").copy()
    assert twin.parent is None and [x.text() for x in twin.all("p")] == ["one", "two"] and twin.all("p")[0].parent is twin
    twin.all("p")[0].remove()
    assert len(doc.all("p")) == 3 and [x.text() for x in doc.all("main p, .x")] == ["one", "two"]


def test_plain_addresses_resolve_as_all_do():
    bases = ("https://a.example", "https://a.example/", "http://a.b/x/y", "https://a.b/x/y/", "https://a.b/x?q=1", "http://a.b:81/z", "https://A.b/q", "https://a.b/./c")
    for h in ("/p/1", "lazy.jpg", "a/b/", "?p=1", "/", "/.", "../x", "./y", "https://c.d/e", "https://C.d/e", "https://c.d", "//c.d/e", "/a b", "/é", "", "#f", "a:b", "/a/../b", "x..y"):
        for b in bases:
            assert urls.resolve(h, b) == urls._resolved(h, b), (h, b)


@here
@pytest.mark.parametrize("pages", ["product_pages", "customer_pages", "order_pages"])
def test_all_cores_share_the_pages_of_one_file(spark, pages):
    assert getattr(generated, pages)(spark, DATA).rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


@here
def test_crawls_parse_each_page_once(spark, monkeypatch):
    from tessella.operators import graph
    from tessella.plans import registry

    asked = []
    monkeypatch.setattr(graph, "crawl", lambda start, links, pages, *rest: asked.append((links, pages)) or pages)
    for name in ("cr1_crawl", "pr2_depth_limit", "pr3_page_budget"):
        registry.QUERIES[name](spark, DATA)
    assert [(plan(a).count("MapInArrow"), plan(b).count("MapInArrow")) for a, b in asked] == [(1, 0)] * 3


@here
def test_social_links_parse_the_pages_asked_for(spark):
    from tessella.plans import registry

    text = plan(registry.QUERIES["ex17_social_links"](spark, DATA))
    assert not [x for x in text[: text.index("MapInArrow")].splitlines() if "Filter" in x and "page_id" in x]


def test_hits_come_in_batches(spark, monkeypatch):
    import pyarrow as pa
    from tessella.operators import brand

    css = ["a{color:#123456}", None, "b{color:red}", "c{color:#fff;background:#000}", ""]
    pages = spark.createDataFrame(list(enumerate(css)), "page_id long, css string")
    kept, frame = [], type(pages)
    real = frame.mapInArrow
    monkeypatch.setattr(frame, "mapInArrow", lambda self, f, *a: kept.append(f) or real(self, f, *a))
    got = sorted((r.page_id, r.value) for r in brand.mine_css(pages).collect())
    assert got == [(0, "#123456"), (3, "#000000"), (3, "#ffffff")]
    batch = pa.RecordBatch.from_pydict({"page_id": range(5), "css": css})
    assert [b.num_rows for b in kept[0](iter([batch, batch]))] == [3, 3]


@here
@pytest.mark.parametrize("name", ["ag9_svg_colour", "src10_docx"])
def test_all_cores_share_work_that_is_long_for_each_row(spark, name):
    from tessella.plans import registry

    assert "RepartitionByExpression" in plan(registry.QUERIES[name](spark, DATA))


def test_links_of_a_page_make_no_frame_of_their_own():
    from pyspark.util import PythonEvalType
    from tessella.functions.sql import Links

    assert Links.evalType == PythonEvalType.SQL_TABLE_UDF  # as an Arrow function each row makes and converts a data frame


def test_pages_of_one_address_are_rows_of_their_own(spark, tmp_path):
    from tessella.plans import registry

    spark.createDataFrame([(i, "https://a.example/", "<p>x") for i in range(3)], "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    assert sorted(r.page_id for r in registry.QUERIES["ex32_defaults"](spark, str(tmp_path)).collect()) == [0, 1, 2]


@pytest.fixture(scope="module")
def odd_documents(spark, tmp_path_factory):
    import duckdb

    d = str(tmp_path_factory.mktemp("odd"))
    texts = ["", " ", "\n \t", None, "plain words", "tab\tline\nreturn\r and blanks " * 3, "N/A", " n/a ", "null and void", "x" * 40_000, "word " * 3_000, "Content: x", "  n/a  ", " " * 20 + "late"]
    spark.createDataFrame([(i + 12 * k, t) for k in range(6) for i, t in enumerate(texts[:12])] + list(enumerate(texts[12:], 100)), "doc_id long, text string").coalesce(1).write.parquet(f"{d}/documents.parquet")
    con = duckdb.connect()
    con.sql(f"create view documents as select * from '{d}/documents.parquet/*.parquet'")
    return d, con


def as_sql(spark, odd_documents, name):
    from tessella.plans import registry

    d, con = odd_documents
    df, want = registry.QUERIES[name](spark, d), con.sql(registry.ORACLE_SQL[name])
    assert df.columns == want.columns
    return sorted(map(repr, map(tuple, df.collect()))), sorted(map(repr, want.fetchall()))


def test_calls_leave_out_blank_documents_only(spark, odd_documents):
    got, want = as_sql(spark, odd_documents, "lm_calls")
    assert [x for x in got if "no-page-content" not in x] and got == want


def test_extraction_asks_about_documents_that_begin_with_a_title(spark, odd_documents):
    d, con = odd_documents
    con.sql("create or replace view documents as select * from read_parquet('" + d + "/documents.parquet/*.parquet') where doc_id % 12 <> 2")  # a line break is a title to its SQL
    spark.read.parquet(f"{d}/documents.parquet").filter("doc_id % 12 <> 2").write.parquet(f"{d}/some/documents.parquet")
    got, want = as_sql(spark, (f"{d}/some", con), "lm1_extract")
    assert len(got) > 30 and got == want


@here
def test_a_stream_keeps_all_cores_busy(spark, tmp_path):
    from tessella.plans.service_queries import arriving

    cores = arriving(spark, DATA, str(tmp_path / "in"))
    assert cores == spark.sparkContext.defaultParallelism and len(list((tmp_path / "in").glob("part-*.parquet"))) == 2 * cores
    assert spark.read.parquet(str(tmp_path / "in")).count() == spark.read.parquet(f"{DATA}/pages.parquet").count()


@here
@pytest.mark.parametrize("name", ["g2_grounded", "g3_ground_records", "j8_token_share", "g2_contains"])
def test_all_cores_share_the_documents_of_one_file(spark, name):
    from tessella.plans import registry

    assert "RepartitionByExpression" in plan(registry.QUERIES[name](spark, DATA))
