"""Link graph: site map, bounded crawl, link predicates, cache and frontier joins."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessella.functions.storage import new_path, stored
from tessella.functions.urls import glob_passes, with_scheme
from tessella.schema import CAPS


def edges(pages: DataFrame, seq: str = "page_id") -> DataFrame:
    """page_seq, url, pos, href, text, isExternal, rel for each link of each page."""
    return pages.select(F.col(seq).alias("page_seq"), "url", F.posexplode("links").alias("pos", "l")).select("page_seq", "url", "pos", "l.*")


def first_links(edges: DataFrame) -> DataFrame:
    """W1, J10: the first link to each address, by page, then place: an aggregate with partial results, not a sort."""
    first = F.min(F.struct("page_seq", "pos", "text", "isExternal", "rel"))
    return edges.groupBy("href").agg(first.alias("f")).select(F.col("href").alias("url"), "f.text", "f.isExternal", "f.rel")


def site_map(pages: DataFrame) -> DataFrame:
    """MP1, TK4: the distinct absolute links of successful pages, sorted by address."""
    ok = pages.filter(F.col("status") == "success") if "status" in pages.columns else pages
    return first_links(edges(ok)).orderBy("url")


def followed(pages: DataFrame, include: list[str] | None = None, exclude: list[str] | None = None, most: int = CAPS["follow"]) -> DataFrame:
    """PR1, W2: page url, pos, href: the first ``most`` internal links of each page, of those the ones whose address the globs let pass."""
    own = F.slice(F.filter("links", lambda x: ~x.isExternal), 1, most)
    rows = pages.select("url", F.posexplode(own).alias("pos", "l")).select("url", "pos", F.col("l.href").alias("href"))
    return rows.filter(glob_passes(F.col("href"), include or [], exclude or []))


def crawl(start: DataFrame, links: DataFrame, pages: DataFrame, max_depth: int, max_pages: int | None = 100) -> DataFrame:
    """CR1, J2: url, depth of the pages that a breadth-first crawl reaches.

    start: url; links: url, href; pages: url (what can be fetched). Each address is visited once, at its
    least depth. Within a depth, addresses come in order, and the page budget cuts there (PR3). Pages
    and links are read once and stored as narrow rows; each round joins the last frontier to the links
    and adds one part, by depth, to the table of what was seen.
    """
    spark = start.sparkSession
    have, links = stored(pages.select("url").distinct(), "pages"), stored(links.select("url", "href").distinct(), "links")
    path = new_path(spark, "seen")
    start.select("url").distinct().join(have, "url", "left_semi").write.parquet(f"{path}/depth=0")
    for depth in range(max_depth + 1):
        seen = spark.read.schema("url string, depth int").parquet(path)
        if depth == max_depth or (max_pages is not None and depth and seen.count() >= max_pages):
            break
        frontier = seen.filter(F.col("depth") == depth)
        if frontier.isEmpty():
            break
        reached = frontier.join(links, "url").select(F.col("href").alias("url")).distinct()
        reached.join(have, "url", "left_semi").join(seen, "url", "left_anti").write.parquet(f"{path}/depth={depth + 1}")
    return seen if max_pages is None else seen.orderBy("depth", "url").limit(max_pages)


def reach(spark, edges_view: str, start: str, depth: int) -> DataFrame:
    """CR1 for bounded depth as one recursive query: node, depth (least) over a view (src, dst)."""
    return spark.sql(f"""
        WITH RECURSIVE r(node, depth) AS (
          SELECT '{start}', 0
          UNION ALL
          SELECT e.dst, r.depth + 1 FROM r JOIN {edges_view} e ON r.node = e.src WHERE r.depth < {int(depth)})
        SELECT node, min(depth) AS depth FROM r GROUP BY node""")


def url_list(df: DataFrame, column: str) -> DataFrame:
    """SRC1."""
    return df.select(with_scheme(F.col(column)).alias("url"))


def precedence(explicit: DataFrame | None, search: DataFrame | None = None, sitemap: DataFrame | None = None) -> DataFrame | None:
    """SRC2: the first of the three that has rows; None if none has."""
    return next((df for df in (explicit, search, sitemap) if df is not None and not df.isEmpty()), None)


def cache_split(requests: DataFrame, cache: DataFrame, key: str = "key") -> tuple[DataFrame, DataFrame]:
    """J1: requests that the cache answers, and those that it doesn't."""
    return requests.join(cache, key, "left_semi"), requests.join(cache, key, "left_anti")


def by_suffix(df: DataFrame, url: str = "url") -> dict[str, DataFrame]:
    """SO5: pdf, docx and html rows by the end of the whole address: one with a query is html."""
    u = F.lower(url)
    pdf, docx = u.endswith(".pdf"), u.endswith(".docx")
    return {"pdf": df.filter(pdf), "docx": df.filter(docx), "html": df.filter(~pdf & ~docx)}


def not_emitted(requests: DataFrame, results: DataFrame, message: str = "No page result emitted") -> DataFrame:
    """CL4: error rows for requests when nothing at all was emitted."""
    any_ = results.limit(1).select(F.lit(1).alias("one"))
    return requests.join(any_, F.lit(True), "left_anti").select("url", F.lit("error").alias("status"), F.lit(message).alias("error"))


def cache_log(log: DataFrame, ttl: float, key: str = "key", ts: str = "ts") -> DataFrame:
    """SS2 over a table: for each request in time order, whether the cache of unbounded size answers it.

    An entry lives ``ttl`` seconds from when it was written, reads don't extend it, and at the exact
    end it still counts. Rows are dealt and sorted by key and time; a task holds the expiry of one key.
    """
    rows = log.select(F.col(key), F.col("id").cast("long").alias("id"), F.col(ts).cast("double").alias("t"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, expiry = None, None
        for b in batches:
            hits = []
            for k, t in zip(b.column(0).to_pylist(), b.column("t").to_pylist(), strict=True):
                if (k,) != last:
                    last, expiry = (k,), None
                hits.append(expiry is not None and t <= expiry)
                if not hits[-1]:
                    expiry = t + ttl
            yield pa.RecordBatch.from_arrays([b.column(0), b.column("id"), pa.array(hits, pa.bool_())], names=[key, "id", "hit"])

    return rows.repartition(key).sortWithinPartitions(key, "t", "id").mapInArrow(run, rows.select(key, "id").schema.add("hit", "boolean"))


def ranked_links(edges: DataFrame, most: int) -> DataFrame:
    """W2 as a window: the first ``most`` links of each page."""
    w = Window.partitionBy("page_seq").orderBy("pos")
    return edges.withColumn("rn", F.row_number().over(w)).filter(F.col("rn") <= most)
