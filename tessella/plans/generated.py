"""Pages made with Spark from the star-schema tables: their extraction can be checked against the tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame, key: str) -> DataFrame:
    """Narrow rows dealt evenly to three tasks a core, before work that takes long for each: however few files hold the rows, all cores share it."""
    return df.repartition(3 * df.sparkSession.sparkContext.defaultParallelism, key)


def say(*parts: object) -> Column:
    """Text of literals and columns."""
    return F.concat(*(p if isinstance(p, Column) else F.lit(str(p)) for p in parts))


def s(name: str) -> Column:
    return F.col(name).cast("string")


def product_pages(spark: SparkSession, d: str) -> DataFrame:
    """A page for each part: JSON-LD product, image with a lazy source, price and stock in the text."""
    ld = F.to_json(F.struct(
        F.lit("https://schema.org").alias("@context"), F.lit("Product").alias("@type"), F.col("p_name").alias("name"), s("p_partkey").alias("sku"),
        F.struct(F.lit("Brand").alias("@type"), F.col("p_brand").alias("name")).alias("brand"),
        F.struct(F.lit("Offer").alias("@type"), F.col("p_retailprice").cast("decimal(12,2)").alias("price"), F.lit("USD").alias("priceCurrency"), F.lit("https://schema.org/InStock").alias("availability")).alias("offers"),
    ))
    html = say(
        '<!doctype html><html lang="en"><head><title>', F.col("p_name"), '</title><script type="application/ld+json">', ld, '</script><script type="application/ld+json">{broken</script></head><body><nav><a href="/">Home</a></nav><main><h1>',
        F.col("p_name"), '</h1><img src="/img/', s("p_partkey"), '.png" alt="', F.col("p_type"), '" width="', s("p_size"), '"><img data-src="lazy.jpg" loading="lazy"><p class="keep">Size ', s("p_size"), '</p><p class="drop">Advert ', s("p_size"),
        "</p>", F.when(F.col("p_partkey") % 2 == 0, "<p>In stock</p>").otherwise(""), "<ul><li>", F.col("p_brand"), "<li>", F.col("p_type"), "</ul></main><footer>Foot</footer></body></html>",
    )
    return spread(table(spark, d, "part"), "p_partkey").select(F.col("p_partkey").alias("page_id"), say("https://shop.example.com/p/", s("p_partkey")).alias("url"), html.alias("html"))


def catalogue_pages(spark: SparkSession, d: str) -> DataFrame:
    """A page for each nation with a table of its suppliers, in order of key."""
    rows = table(spark, d, "supplier").groupBy("s_nationkey").agg(F.array_sort(F.collect_list(F.struct("s_suppkey", "s_name"))).alias("x"))
    cells = F.array_join(F.transform("x", lambda r: F.concat(F.lit("<tr><td>"), r["s_suppkey"].cast("string"), F.lit("<td> "), r["s_name"])), "")
    df = table(spark, d, "nation").join(rows, F.col("n_nationkey") == F.col("s_nationkey"), "left")
    html = say("<html><body><h2>", F.col("n_name"), "</h2><table><tr><th>Key<th>Name", F.coalesce(cells, F.lit("")), "</table></body></html>")
    return df.select(F.col("n_nationkey").cast("long").alias("page_id"), say("https://cat.example.com/", s("n_nationkey")).alias("url"), html.alias("html"))


def customer_pages(spark: SparkSession, d: str) -> DataFrame:
    """A page for each customer: microdata and a form."""
    html = say(
        '<html><body><div itemscope itemtype="https://schema.org/Person"><span itemprop="name">', F.col("c_name"), '</span><meta itemprop="segment" content="', F.col("c_mktsegment"),
        '"><a itemprop="url" href="/c/', s("c_custkey"), '">x</a></div><form action="/save/', s("c_custkey"), '" method="post"><input name="name" required><input type="hidden" name="id"><input><select name="seg"><option>',
        F.col("c_mktsegment"), "<option>other</select><textarea name=note></textarea></form></body></html>",
    )
    return spread(table(spark, d, "customer"), "c_custkey").select(F.col("c_custkey").alias("page_id"), say("https://crm.example.com/c/", s("c_custkey")).alias("url"), html.alias("html"))


def order_pages(spark: SparkSession, d: str) -> DataFrame:
    """A page for each order: canonical, robots, meta, OpenGraph, alternates, neighbours."""
    k = F.col("o_orderkey")
    html = say(
        '<html lang="en-GB"><head><title> Order ', k.cast("string"), ' </title><link rel="canonical" href="/o/', k.cast("string"), '"><meta name="robots" content="', F.when(k % 3 == 0, "noindex").otherwise(""),
        '"><meta name="description" content="', F.when(k % 2 == 0, F.col("o_orderpriority")).otherwise(""), '"><meta property="og:description" content="og ', F.col("o_orderstatus"), '"><meta property="og:title" content="T', k.cast("string"),
        '"><meta name="twitter:card" content="summary"><meta name="author" content="first"><meta name="author" content="', F.col("o_orderstatus"), '"><link rel="alternate" hreflang="de" href="/de/', k.cast("string"),
        '"><link rel="next" href="', (k + 1).cast("string"), '"><link rel="prev" href="?p=', k.cast("string"), '"></head><body>x</body></html>',
    )
    return spread(table(spark, d, "orders"), "o_orderkey").select(k.alias("page_id"), say("https://ord.example.com/o/", k.cast("string")).alias("url"), html.alias("html"))


def graph_pages(spark: SparkSession, d: str) -> DataFrame:
    """Region pages link to their nations, nation pages to their customers and outside, customer pages back to their nation."""
    def links(rows: Column) -> Column:
        return F.array_join(F.transform(rows, lambda r: F.concat(F.lit('<a href="'), r["h"], F.lit('">'), r["t"], F.lit("</a>"))), " ")

    def page(base: int, key: Column, path: str, rows: Column) -> list[Column]:
        return [(key.cast("long") + base).alias("page_id"), say("https://g.example.com/", path, key.cast("string")).alias("url"), say("<html><body>", links(rows), "</body></html>").alias("html")]

    nations, customers = table(spark, d, "nation"), table(spark, d, "customer")
    item = lambda path, key, text: F.struct(F.col(key).cast("long").alias("o"), say(path, s(key)).alias("h"), F.col(text).alias("t"))
    by_region = nations.groupBy("n_regionkey").agg(F.array_sort(F.collect_list(item("/n/", "n_nationkey", "n_name"))).alias("x"))
    by_nation = customers.groupBy("c_nationkey").agg(F.array_sort(F.collect_list(item("/c/", "c_custkey", "c_name"))).alias("x"))
    outside = F.array(F.struct(F.lit(-1).cast("long").alias("o"), F.lit("https://www.facebook.com/x").alias("h"), F.lit("out").alias("t")), F.struct(F.lit(-1).cast("long").alias("o"), F.lit("https://netflix.com/").alias("h"), F.lit("out").alias("t")))
    return (
        by_region.select(*page(0, F.col("n_regionkey"), "r/", F.col("x")))
        .union(spread(by_nation, "c_nationkey").select(*page(1000, F.col("c_nationkey"), "n/", F.concat("x", outside))))
        .union(spread(customers, "c_custkey").select(*page(100_000, F.col("c_custkey"), "c/", F.array(item("/n/", "c_nationkey", "c_mktsegment")))))
    )


def sitemaps(spark: SparkSession, d: str) -> DataFrame:
    """One index of all nations, and a sitemap for each with its customers; a third of the children aren't there."""
    nations, customers = table(spark, d, "nation"), table(spark, d, "customer")
    index = nations.agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.col("n_nationkey").cast("int"))), lambda k: F.concat(F.lit("<sitemap><loc> https://m.example.com/map"), k.cast("string"), F.when(k % 5 == 4, "").otherwise(".xml"), F.lit("</loc></sitemap>"))), "").alias("x"))
    top = index.select(F.lit("https://m.example.com/index.xml").alias("url"), say("<sitemapindex>", F.col("x"), "</sitemapindex>").alias("xml"))
    below = customers.filter(F.col("c_nationkey") % 3 != 2).groupBy("c_nationkey").agg(F.array_join(F.transform(F.array_sort(F.collect_list("c_custkey")), lambda k: F.concat(F.lit("<url><LOC>https://m.example.com/c/"), k.cast("string"), F.lit(" </LOC></url>"))), "").alias("x"))
    k = F.col("c_nationkey")
    return top.union(below.select(say("https://m.example.com/map", k.cast("string"), F.when(k % 5 == 4, "").otherwise(".xml")), say("<urlset>", F.col("x"), "</urlset>")))


# Fixed values of the generated outcomes, by number.
MESSAGES = ("Request blocked - received 403 status code", "429 Too Many Requests", "getaddrinfo ENOTFOUND", "Navigation Timeout exceeded", "ECONNRESET", "Unexpected token: parse failed", "something odd", "CAPTCHA shown", "socket hang up", "DNS failure")
STATUSES = (0, 200, 404, 403, 429, 500, 503, 599, 418, 600)


def outcomes(spark: SparkSession, d: str) -> DataFrame:
    """A fetch outcome for each event: id, message (null for every eleventh), code, ok, score."""
    k = F.col("event_id")
    pick = lambda xs, by: F.element_at(F.array(*map(F.lit, xs)), ((F.floor(k / by) % len(xs)) + 1).cast("int"))
    return table(spark, d, "events").select(
        k.alias("id"), "user_id", "event_type", F.when(k % 11 != 0, pick(MESSAGES, 1)).alias("message"), pick(STATUSES, 10).alias("code"), (k % 4 != 0).alias("ok"), (k % 101).cast("int").alias("score"),
    )
