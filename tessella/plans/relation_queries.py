"""Queries of relational plans: joins, roll-ups, ranks, graph, brand, cache."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tessella.functions import colours as K
from tessella.functions import errors as E
from tessella.functions import urls as U
from tessella.operators import brand as B
from tessella.operators import graph as GR
from tessella.operators import readiness as R
from tessella.operators.parse import parsed
from tessella.operators.records import records
from tessella.plans.expression_queries import _HEX, _HSL2, _OUT, CLASSED, pick, rgb
from tessella.plans.generated import graph_pages, outcomes, sitemaps, spread, table
from tessella.sources import web

ENTRIES: dict = {}


def query(name: str, sql: str | None = None):  # noqa: ANN201
    def keep(f):  # noqa: ANN001, ANN202
        ENTRIES[name] = (f, sql)
        return f

    return keep


# Readiness roll-ups over generated outcomes.
_VERDICTS = f"SELECT *, CASE WHEN ok THEN CASE WHEN score >= 70 THEN 'ready' ELSE 'needs-review' END WHEN type IN ('blocked-bot', 'rate-limit') THEN 'blocked' ELSE 'failed' END AS verdict FROM ({CLASSED})"


def verdicts(spark, d, contract="event_type"):  # noqa: ANN001, ANN201
    o = outcomes(spark, d).withColumn("type", E.error_type(F.col("message"), F.col("code")))
    status = F.when(F.col("ok"), "success").otherwise("error")
    o = o.withColumn("verdict", R.verdict(status, F.col("type"), F.col("score"), F.lit(False)))
    return o.select("id", F.expr(contract).alias("contract"), "type", "ok", "score", "verdict", F.when(~F.col("ok"), F.array("type")).otherwise(F.array().cast("array<string>")).alias("blockers"))


@query("dg5_outcome_verdicts", f"SELECT id, verdict FROM ({_VERDICTS})")
def _(spark, d):
    return verdicts(spark, d).select("id", "verdict")


@query("ag2_summary_by_contract", f"""SELECT event_type AS contract, count(*) AS totalUrls, count(*) FILTER (verdict = 'ready') AS readyUrls, count(*) FILTER (verdict = 'blocked') AS blockedUrls, count(*) FILTER (verdict = 'failed') AS failedUrls,
  count(*) FILTER (verdict = 'needs-review') AS needsReviewUrls, CAST(round(avg(score)) AS INTEGER) AS averageScore FROM ({_VERDICTS}) GROUP BY event_type""")
def _(spark, d):
    return R.summarise(verdicts(spark, d)).drop("workflowVerdict", "recommendedNextStep")


_FLOWS = f"SELECT event_type || '-' || user_id AS contract, count(*) AS n, count(*) FILTER (verdict = 'ready') AS r, count(*) FILTER (verdict = 'blocked') AS b, count(*) FILTER (verdict = 'failed') AS f FROM ({_VERDICTS}) GROUP BY 1"


@query("dg7_workflow_verdict", f"SELECT contract, n, CASE WHEN r = n THEN 'ready' WHEN b = n THEN 'blocked' WHEN f = n THEN 'failed' WHEN r > 0 THEN 'mixed' ELSE 'needs-review' END AS workflow, CASE WHEN r = n THEN 'run-contract-extraction' WHEN b = n THEN 'fix-access-first' WHEN f = n THEN 'do-not-automate' WHEN r > 0 THEN 'extract-ready-subset' ELSE 'manual-review' END AS action FROM ({_FLOWS})")
def _(spark, d):
    s = R.summarise(verdicts(spark, d, "event_type || '-' || user_id"))
    return s.select("contract", F.col("totalUrls").cast("long").alias("n"), F.col("workflowVerdict").alias("workflow"), F.col("recommendedNextStep.action").alias("action"))


@query("ag3_blockers", f"SELECT event_type AS contract, type AS blocker, count(*) AS n FROM ({CLASSED}) WHERE NOT ok GROUP BY ALL")
def _(spark, d):
    return R.blockers_by_type(verdicts(spark, d))


@query("ag5_weighted_score", "SELECT event_id, CAST(round(100.0 * ((CASE WHEN event_id % 2 = 0 THEN 20 ELSE 0 END) + (CASE WHEN event_id % 3 = 0 THEN 15 ELSE 0 END)) / 35) AS INTEGER) AS score FROM events")
def _(spark, d):
    k = F.col("event_id")
    signals = F.array(R._signal("a", k % 2 == 0, 20, k), R._signal("b", k % 3 == 0, 15, k))
    return table(spark, d, "events").select("event_id", R.score(signals).alias("score"))


@query("cl4_no_result_rows", "SELECT url, 'error' AS status FROM pages")
def _(spark, d):
    p = table(spark, d, "pages")
    return GR.not_emitted(p.select("url"), p.filter("page_id < 0")).select("url", "status")


# Graph.
_NATIONS = "SELECT 'https://g.example.com/n/' || n_nationkey AS url, n_name AS text, false AS external FROM nation"


@query("mp1_site_map", f"{_NATIONS} UNION ALL SELECT 'https://g.example.com/c/' || c_custkey, c_name, false FROM customer UNION ALL SELECT * FROM (VALUES ('https://www.facebook.com/x', 'out', true), ('https://netflix.com/', 'out', true))")
def _(spark, d):
    found = GR.site_map(parsed(graph_pages(spark, d), "links"))
    return found.select("url", "text", F.col("isExternal").alias("external"))


@query("mp1_site_map_pages", r"SELECT count(*) AS pages, sum(len(list_distinct(regexp_extract_all(html, '<a href=\"([^\"]*)\"', 1)))) AS links FROM pages")
def _(spark, d):
    e = GR.edges(parsed(table(spark, d, "pages"), "links"))
    n = table(spark, d, "pages").agg(F.count("*").alias("pages"))
    return n.crossJoin(e.select("page_seq", "href").distinct().agg(F.count("*").alias("links")))


@query("w1_first_link", "SELECT 'https://g.example.com/n/' || n_nationkey AS url, n_name AS text FROM nation")
def _(spark, d):
    e = GR.edges(parsed(graph_pages(spark, d), "links"))
    return GR.first_links(e).filter("url LIKE '%/n/%'").select("url", "text")


@query("w2_followed_links", "SELECT 'https://g.example.com/n/' || c_nationkey AS url, count(*) AS n, max(c_custkey) AS last FROM (SELECT *, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) AS rn FROM customer) WHERE rn <= 50 AND c_custkey % 10 <> 7 GROUP BY c_nationkey")
def _(spark, d):
    p = parsed(graph_pages(spark, d), "links").filter("url LIKE '%/n/%'")
    f = GR.followed(p, include=["*/c/*"], exclude=["*7"])
    return f.groupBy("url").agg(F.count("*").alias("n"), F.max(F.regexp_extract("href", r"(\d+)$", 1).cast("long")).alias("last"))


@query("w2_first_links_window", "SELECT page_seq, count(*) AS n FROM (SELECT 1000 + c_nationkey AS page_seq FROM (SELECT *, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) AS rn FROM customer) WHERE rn <= 48 UNION ALL SELECT DISTINCT 1000 + c_nationkey FROM customer UNION ALL SELECT DISTINCT 1000 + c_nationkey FROM customer) GROUP BY page_seq")
def _(spark, d):
    e = GR.edges(parsed(graph_pages(spark, d), "links").filter("url LIKE '%/n/%'"))
    return GR.ranked_links(e, 50).groupBy("page_seq").agg(F.count("*").alias("n"))


_REACH = "SELECT 'https://g.example.com/r/0' AS url, 0 AS depth UNION ALL SELECT 'https://g.example.com/n/' || n_nationkey, 1 FROM nation WHERE n_regionkey = 0 AND n_nationkey IN (SELECT c_nationkey FROM customer) UNION ALL SELECT 'https://g.example.com/c/' || c_custkey, 2 FROM (SELECT *, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) AS rn FROM customer) JOIN nation ON c_nationkey = n_nationkey WHERE n_regionkey = 0 AND rn <= 50"


@query("cr1_crawl", _REACH)
def _(spark, d):
    p = parsed(graph_pages(spark, d), "links")
    start = spark.createDataFrame([("https://g.example.com/r/0",)], "url string")
    return GR.crawl(start, GR.followed(p).select("url", "href"), graph_pages(spark, d).select("url"), 4, None)


@query("pr3_page_budget", f"SELECT url, depth FROM ({_REACH}) ORDER BY depth, url LIMIT 20")
def _(spark, d):
    p = parsed(graph_pages(spark, d), "links")
    start = spark.createDataFrame([("https://g.example.com/r/0",)], "url string")
    return GR.crawl(start, GR.followed(p).select("url", "href"), graph_pages(spark, d).select("url"), 4, 20)


@query("pr2_depth_limit", f"SELECT url, depth FROM ({_REACH}) WHERE depth <= 1")
def _(spark, d):
    p = parsed(graph_pages(spark, d), "links")
    start = spark.createDataFrame([("https://g.example.com/r/0",)], "url string")
    return GR.crawl(start, GR.followed(p).select("url", "href"), graph_pages(spark, d).select("url"), 1, None)


@query("cr1_recursive_query", "SELECT 'r0' AS node, 0 AS depth UNION ALL SELECT 'n' || n_nationkey, 1 FROM nation WHERE n_regionkey = 0 UNION ALL SELECT 'c' || c_custkey, 2 FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE n_regionkey = 0")
def _(spark, d):
    n, c = table(spark, d, "nation"), table(spark, d, "customer")
    down = n.selectExpr("concat('r', n_regionkey) src", "concat('n', n_nationkey) dst").union(c.selectExpr("concat('n', c_nationkey)", "concat('c', c_custkey)"))
    down.createOrReplaceTempView("tessella_edges")
    return GR.reach(spark, "tessella_edges", "r0", 2)


_CHILD = "n % 5 <> 4"


@query("src4_sitemaps", "SELECT CASE WHEN k IS NULL THEN 'https://m.example.com/map' || n || (CASE WHEN n % 5 = 4 THEN '' ELSE '.xml' END) ELSE k END AS root, 'https://m.example.com/c/' || c_custkey AS url FROM (SELECT c_custkey, c_nationkey AS n, unnest([NULL, 'https://m.example.com/index.xml']) AS k FROM customer) WHERE n % 3 <> 2 AND (k IS NULL OR n % 5 <> 4)")
def _(spark, d):
    return web.expand_sitemaps(sitemaps(spark, d)).select("root", "url")


@query("j3_sitemap_index", "SELECT count(*) AS n FROM customer WHERE c_nationkey % 3 <> 2 AND c_nationkey % 5 <> 4")
def _(spark, d):
    m = sitemaps(spark, d)
    return web.expand_sitemaps(m, m.filter("url LIKE '%index.xml'")).agg(F.count("*").alias("n"))


@query("src2_precedence", "SELECT url FROM pages WHERE page_id % 2 = 1")
def _(spark, d):
    p = table(spark, d, "pages")
    return GR.precedence(p.filter("page_id < 0").select("url"), p.filter("page_id % 2 = 1").select("url"), p.select("url"))


@query("so5_routes", "SELECT 'pdf' AS kind, count(*) AS n FROM events WHERE event_id % 4 = 0 UNION ALL SELECT 'docx', count(*) FROM events WHERE event_id % 4 = 1 UNION ALL SELECT 'html', count(*) FROM events WHERE event_id % 4 > 1")
def _(spark, d):
    names = ("http://a/x.PDF", "http://a/y.docx", "http://a/x.pdf?x=1", "http://a/")
    parts = GR.by_suffix(table(spark, d, "events").select(pick(names, F.col("event_id")).alias("url")))
    out = None
    for kind, df in parts.items():
        n = df.agg(F.lit(kind).alias("kind"), F.count("*").alias("n"))
        out = n if out is None else out.union(n)
    return out


@query("so4_unknown_formats", "SELECT event_id, CASE WHEN event_id % 2 = 0 THEN 'pdf' ELSE '' END AS unknown FROM events")
def _(spark, d):
    from tessella.operators.columns import FORMATS

    asked = F.when(F.col("event_id") % 2 == 0, F.array(F.lit("text"), F.lit("pdf"))).otherwise(F.array(F.lit("links")))
    return table(spark, d, "events").select("event_id", F.array_join(F.array_except(asked, F.array(*map(F.lit, FORMATS))), ",").alias("unknown"))


@query("so2_union_of_origins", "SELECT c, count(*) AS n FROM (SELECT CASE WHEN page_id % 3 = 0 THEN true ELSE false END AS c FROM pages) GROUP BY c")
def _(spark, d):
    p = table(spark, d, "pages")
    hit, miss = GR.cache_split(p.withColumn("key", F.col("page_id")), p.filter("page_id % 3 = 0").select(F.col("page_id").alias("key")))
    both = hit.withColumn("c", F.lit(True)).unionByName(miss.withColumn("c", F.lit(False)))
    return both.groupBy("c").agg(F.count("*").alias("n"))


@query("j1_cache_hits_misses", "SELECT o_orderkey AS key, o_orderkey % 3 = 0 AS hit FROM orders")
def _(spark, d):
    o = table(spark, d, "orders").select(F.col("o_orderkey").alias("key"))
    hit, miss = GR.cache_split(o, o.filter("key % 3 = 0"))
    return hit.select("key", F.lit(True).alias("hit")).union(miss.select("key", F.lit(False).alias("hit")))


_TTL = 300


@query("ss2_cache_log", f"""
WITH RECURSIVE l AS (SELECT user_id, event_id, epoch_us(ts) / 1e6 AS t, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS rn FROM events),
f AS (SELECT user_id, event_id, rn, false AS hit, t + {_TTL} AS expiry FROM l WHERE rn = 1
  UNION ALL SELECT l.user_id, l.event_id, l.rn, l.t <= f.expiry, CASE WHEN l.t <= f.expiry THEN f.expiry ELSE l.t + {_TTL} END FROM f JOIN l ON l.user_id = f.user_id AND l.rn = f.rn + 1)
SELECT user_id, event_id AS id, hit FROM f""")
def _(spark, d):
    log = table(spark, d, "events").select("user_id", F.col("event_id").alias("id"), (F.unix_micros(F.col("ts").cast("timestamp")) / 1e6).alias("ts"))
    return GR.cache_log(log, _TTL, "user_id", "ts")


@query("j10_distinct_links", "SELECT count(*) AS n FROM (SELECT 'n' || c_nationkey AS x FROM customer UNION SELECT 'c' || c_custkey FROM customer UNION SELECT 'n' || n_nationkey FROM nation UNION SELECT 'a' UNION SELECT 'b')")
def _(spark, d):
    return GR.edges(parsed(graph_pages(spark, d), "links")).select("href").distinct().agg(F.count("*").alias("n"))


@query("tk4_sorted_links", "SELECT url, CAST(row_number() OVER (ORDER BY url) AS INTEGER) AS place FROM (SELECT DISTINCT url FROM pages)")
def _(spark, d):
    w = Window.orderBy("url")
    return table(spark, d, "pages").select("url").distinct().withColumn("place", F.row_number().over(w))


# Brand.
_HITS = f"SELECT p_partkey, CAST(p_partkey % 50 AS BIGINT) AS page_id, '#' || printf('%02x', (p_partkey % 4 * 60)::INTEGER) || printf('%02x', (p_partkey // 4 % 3 * 100)::INTEGER) || '30' AS value, 's' || p_partkey % 3 AS source, CASE WHEN p_partkey % 3 = 0 THEN 0.4 ELSE 0.12 END::DOUBLE AS weight FROM part"


def hits(spark, d):  # noqa: ANN001, ANN201
    k = F.col("p_partkey")
    two = lambda c: F.lower(F.lpad(F.hex(c.cast("int")), 2, "0"))
    return table(spark, d, "part").select(
        (k % 50).alias("page_id"), F.concat(F.lit("#"), two(k % 4 * 60), two(F.floor(k / 4) % 3 * 100), F.lit("30")).alias("value"), F.concat(F.lit("s"), (k % 3).cast("string")).alias("source"), F.when(k % 3 == 0, 0.4).otherwise(0.12).alias("weight"),
    )


@query("ag6_colour_groups", f"SELECT page_id, value AS hex, round(sum(weight), 6) AS weight, arg_min(source, (-weight, source)) AS source FROM ({_HITS}) GROUP BY page_id, value")
def _(spark, d):
    return B.colour_groups(hits(spark, d)).select("page_id", "hex", F.round("weight", 6).alias("weight"), "source")


@query("br2_palette")
def _(spark, d):
    h = hits(spark, d)
    themes = h.select("page_id").distinct().withColumn("themeColor", F.when(F.col("page_id") % 2 == 0, "#b4c830"))
    return B.palettes(h, themes).select("page_id", "themeColor", F.to_json("palette").alias("palette"))


@query("tk1_top_colours", f"""
WITH g AS (SELECT page_id, value AS hex, sum(weight) AS w FROM ({_HITS}) GROUP BY 1, 2),
r AS (SELECT *, ('0x' || hex[2:3])::INTEGER AS r, ('0x' || hex[4:5])::INTEGER AS g, 48 AS b FROM g),
h AS (SELECT *, greatest(r, g, b) / 255.0::DOUBLE AS hi, least(r, g, b) / 255.0::DOUBLE AS lo FROM r),
s AS (SELECT *, CASE WHEN hi = lo THEN 0 WHEN (hi + lo) / 2 > 0.5 THEN (hi - lo) / (2 - hi - lo) ELSE (hi - lo) / (hi + lo) END AS s FROM h)
SELECT page_id, CAST(rn AS INTEGER) AS rank, hex FROM (SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY round(s * w, 6) DESC, hex) AS rn FROM s) WHERE rn <= 5""")
def _(spark, d):
    g = B.colour_groups(hits(spark, d)).withColumn("k", F.round(K.hsl(K.hex_rgba(F.col("hex"))).s * F.col("weight"), 6))
    w = Window.partitionBy("page_id").orderBy(F.desc("k"), "hex")
    return g.withColumn("rank", F.row_number().over(w)).filter("rank <= 5").select("page_id", "rank", "hex")


@query("br1_css_hits", """WITH h AS (SELECT p_partkey AS page_id, '#' || lower(printf('%06x', p_partkey * 7919 % 16777216)) AS own, '#' || printf('%02x', p_partkey % 256) || '0a14' AS a FROM part)
SELECT page_id, own AS value, 'style:var--brand' AS source, 0.4::DOUBLE AS weight FROM h UNION ALL SELECT page_id, own, 'style', 0.12::DOUBLE FROM h UNION ALL SELECT page_id, a, 'style', 0.12::DOUBLE FROM h UNION ALL SELECT page_id, '#ffffff', 'style', 0.12::DOUBLE FROM h""")
def _(spark, d):
    k = F.col("p_partkey")
    css = F.concat(F.lit(":root{--brand: var(--x); --x: #"), F.lpad(F.hex(k * 7919 % 16777216), 6, "0"), F.lit("; --gap: 4px} a{color: rgb("), (k % 256).cast("string"), F.lit(",10,20)} b{color:#fff}"))
    return B.mine_css(spread(table(spark, d, "part"), "p_partkey").select(k.alias("page_id"), css.alias("css")))


@query("j6_css_variables", "SELECT p_partkey AS page_id, '#' || lower(printf('%06x', p_partkey * 7919 % 16777216)) AS brand FROM part")
def _(spark, d):
    k = F.col("p_partkey")
    css = F.concat(F.lit(":root{--brand: var(--x); --x: #"), F.lpad(F.hex(k * 7919 % 16777216), 6, "0"), F.lit("; --gap: 4px}"))
    found = B.mine_css(spread(table(spark, d, "part"), "p_partkey").select(k.alias("page_id"), css.alias("css")))
    return found.filter("source LIKE '%:var--brand'").select("page_id", F.col("value").alias("brand"))


_CAND = "SELECT CAST(p_size AS BIGINT) AS page_id, p_partkey AS pos, 'https://l.example/' || p_partkey % 900 || CASE WHEN p_partkey % 3 = 0 THEN '.svg' ELSE '.png' END AS url, CASE WHEN p_partkey % 3 = 0 THEN 'svg' ELSE 'png' END AS type, (30 + p_partkey % 61) / 100.0::DOUBLE AS confidence FROM part"


def logo_candidates(spark, d):  # noqa: ANN001, ANN201
    k = F.col("p_partkey")
    return table(spark, d, "part").select(
        F.col("p_size").cast("long").alias("page_id"), k.alias("pos"), F.concat(F.lit("https://l.example/"), (k % 900).cast("string"), F.when(k % 3 == 0, ".svg").otherwise(".png")).alias("url"), F.lit("x").alias("source"),
        F.when(k % 3 == 0, "svg").otherwise("png").alias("type"), ((30 + k % 61) / 100).alias("confidence"),
    )


_BEST = f"SELECT page_id, url, max(confidence) AS confidence, arg_min(pos, (-confidence, pos)) AS pos, any_value(type) AS type FROM ({_CAND}) GROUP BY page_id, url"


@query("ag10_best_candidates", f"SELECT page_id, url, pos, round(confidence, 6) AS confidence FROM ({_BEST})")
def _(spark, d):
    return B.best_candidates(logo_candidates(spark, d)).select("page_id", "url", "pos", F.round("confidence", 6).alias("confidence"))


@query("tk3_probed", f"SELECT page_id, url FROM (SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY confidence DESC, pos) AS rn FROM ({_BEST})) WHERE rn <= 6")
def _(spark, d):
    return B.to_probe(logo_candidates(spark, d)).select("page_id", "url")


_PROBE = "n % 4 <> 0"
_QUALITY = "CASE WHEN type = 'svg' THEN CASE WHEN n % 5 <> 4 AND n % 4 <> 0 THEN 1.3 ELSE 0.85 END WHEN n % 5 = 4 OR n % 4 = 0 THEN 0.85 WHEN n % 7 = 0 THEN 0.2 ELSE (CASE WHEN n * 997 < 300 THEN 0.3 WHEN n * 997 < 1000 THEN 0.7 WHEN n * 997 <= 500000 THEN 1.25 WHEN n * 997 <= 2000000 THEN 0.9 ELSE 0.5 END) * 1.15 END"


@query("br4_rank_logos", f"SELECT page_id, CAST(rank AS INTEGER) AS rank, url FROM (SELECT page_id, url, row_number() OVER (PARTITION BY page_id ORDER BY round(confidence * ({_QUALITY}), 9) DESC, url) AS rank FROM (SELECT *, CAST(regexp_extract(url, '(\\d+)\\.', 1) AS BIGINT) AS n FROM ({_BEST}))) WHERE rank <= 4")
def _(spark, d):
    c = logo_candidates(spark, d)
    n = F.regexp_extract("url", r"(\d+)\.", 1).cast("long")
    probes = c.select("url").distinct().filter(n % 4 != 0).select("url", (n % 5 != 4).alias("ok"), (n * 997).alias("bytes"), F.when(n % 7 == 0, "text/html").otherwise("image/png").alias("contentType"))
    return B.rank_logos(c, probes).select("page_id", "rank", "url")


@query("co9_logo_quality", f"SELECT p_partkey, round(({_QUALITY})::DOUBLE, 6) AS f FROM (SELECT p_partkey, p_partkey AS n, CASE WHEN p_partkey % 3 = 0 THEN 'svg' ELSE 'png' END AS type FROM part)")
def _(spark, d):
    n = F.col("p_partkey")
    f = K.logo_quality(F.lit("https://x/"), F.when(n % 3 == 0, "svg").otherwise("png"), F.when(n % 4 != 0, n % 5 != 4), n * 997, F.when(n % 7 == 0, "text/html").otherwise("image/png"))
    return table(spark, d, "part").select("p_partkey", F.round(f, 6).alias("f"))


@query("ag8_pixel_colour", f"""
WITH px AS (SELECT p_partkey % 40 AS image_id, * FROM ({_HSL2})), k AS (SELECT * FROM px WHERE form <> 1 AND NOT (l > 0.93 OR l < 0.07 OR s < 0.12)),
bins AS (SELECT image_id, (r >> 3) * 1024 + (g >> 3) * 32 + (b >> 3) AS bin, count(*) AS n, CAST(round(avg(r)) AS INTEGER) AS r, CAST(round(avg(g)) AS INTEGER) AS g, CAST(round(avg(b)) AS INTEGER) AS b FROM k GROUP BY 1, 2)
SELECT image_id, {_HEX} AS hex FROM (SELECT *, row_number() OVER (PARTITION BY image_id ORDER BY n DESC, bin) AS rn FROM bins) WHERE rn = 1""")
def _(spark, d):
    px = rgb(spark, d).select((F.col("p_partkey") % 40).alias("image_id"), "r", "g", "b", F.when(F.col("form") == 1, 100).otherwise(255).alias("a"))
    return B.pixel_colour(px)


@query("ag9_svg_colour", "SELECT p_partkey AS image_id, CASE WHEN p_partkey % 2 = 0 THEN '#1050c0' ELSE '#c05010' END AS hex FROM part")
def _(spark, d):
    k = F.col("p_partkey")
    two = F.when(k % 2 == 0, "#1050c0").otherwise("#C05010")
    svg = F.concat(F.lit('<svg><path fill="'), two, F.lit('"/><path style="stroke: '), two, F.lit('"/><path fill="#ffffff"/><path fill="#ffffff"/><path fill="#ffffff"/><path fill="#11aa55"/></svg>'))
    return B.svg_colour(spread(table(spark, d, "part"), "p_partkey").select(k.alias("image_id"), svg.alias("svg")))


@query("br6_fold_logo_colour", "SELECT p_partkey, CASE WHEN p_partkey % 2 = 0 THEN '#ff2000:primary,#00ff00:' ELSE '#0000ff:primary,#ff2000:,#00ff00:' END AS palette FROM part")
def _(spark, d):
    entry = lambda h, r: F.struct(F.lit(h).alias("hex"), F.lit(r).cast("string").alias("role"), F.lit("style").alias("source"), F.lit(1.0).alias("weight"))
    p = F.array(entry("#ff2000", None), entry("#00ff00", "primary"))
    out = B.fold_logo_colour(p, F.when(F.col("p_partkey") % 2 == 0, "#ff0000").otherwise("#0000ff"))
    return table(spark, d, "part").select("p_partkey", F.array_join(F.transform(out, lambda x: F.concat(x["hex"], F.lit(":"), F.coalesce(x["role"], F.lit("")))), ",").alias("palette"))


@query("j5_stylesheets", "SELECT p_partkey AS page_id, CASE WHEN p_partkey % 2 = 0 THEN 'a{}' || chr(10) || chr(10) || 'c{}' ELSE 'a{}' || chr(10) || 'b{}' || chr(10) || 'c{}' END AS css FROM part")
def _(spark, d):
    k = F.col("p_partkey")
    own = F.concat(F.lit("https://shop.example.com/"), k.cast("string"))
    links = F.array(F.concat(own, F.lit("/a.css")), F.lit("https://cdn.other.net/x.css"), F.concat(own, F.lit("/b.css")), F.lit("https://www.example.com/c.css"), F.concat(own, F.lit("/d.css")))
    p = table(spark, d, "part").select(k.alias("page_id"), own.alias("url"), links.alias("stylesheets"))
    kind = lambda n, when: p.filter(when).select(F.concat("url", F.lit(f"/{n}.css")).alias("url"), F.lit(f"{n}{{}}").alias("css"))
    sheets = kind("a", "true").union(kind("b", "page_id % 2 = 1")).union(kind("d", "true")).union(p.limit(1).selectExpr("'https://www.example.com/c.css'", "'c{}'"))
    return B.page_sheets(p, sheets.withColumn("status", F.lit(200)).withColumn("contentType", F.lit("text/css")))


@query("src12_manifest_icons", "SELECT 'https://m/' || p_partkey AS url, 0 AS pos, '/i.png' AS src, CASE WHEN p_size * 20 >= 512 THEN 0.88 WHEN p_size * 20 >= 192 THEN 0.84 ELSE 0.7 END::DOUBLE AS confidence, '#123456' AS theme FROM part")
def _(spark, d):
    n = (F.col("p_size") * 20).cast("string")
    icon = F.struct(F.lit("/i.png").alias("src"), F.concat(F.lit("16x16 "), n, F.lit("x"), n).alias("sizes"))
    json = F.to_json(F.struct(F.array(icon).alias("icons"), F.lit("#123456").alias("theme_color")))
    got = B.manifest_icons(table(spark, d, "part").select(F.concat(F.lit("https://m/"), F.col("p_partkey").cast("string")).alias("url"), json.alias("json")))
    return got.select("url", "pos", "src", "confidence", F.col("themeColorRaw").alias("theme"))


@query("br3_logo_candidates")
def _(spark, d):
    from tessella.plans.generated import product_pages

    p = parsed(product_pages(spark, d), "logoCandidates")
    return p.select("page_id", F.explode("logoCandidates").alias("c")).select("page_id", "c.*")


@query("js2_organisation", "SELECT p_partkey AS page_id, p_brand AS name, 'https://x.com/' || p_partkey AS social FROM part")
def _(spark, d):
    k = F.col("p_partkey").cast("string")
    org = F.struct(F.lit("Organization").alias("@type"), F.col("p_brand").alias("name"), F.array(F.concat(F.lit("https://x.com/"), k), F.lit("https://else.example/")).alias("sameAs"))
    ld = F.to_json(F.struct(F.array(F.struct(F.lit("WebSite").alias("@type"), F.lit("Site").alias("name")).cast("struct<`@type`:string,name:string>")).alias("sites"), F.array(org).alias("@graph")))
    got = B.organisations(table(spark, d, "part").select(F.col("p_partkey").alias("page_id"), F.array(ld).alias("structuredData")))
    return got.select("page_id", "brandOrg.name", F.array_join("brandOrg.socialLinks", ",").alias("social"))


@query("page_records", "SELECT page_id, url, 'success' AS status FROM pages")
def _(spark, d):
    return records(table(spark, d, "pages")).select("page_id", "url", "status")


@query("pr1_prefiltered_crawl", r"SELECT count(*) AS n FROM pages WHERE regexp_matches(url, '(?i)/en/')")
def _(spark, d):
    p = table(spark, d, "pages").filter(U.glob_passes(F.col("url"), ["*/en/*"], []))
    return parsed(p, "title").agg(F.count("*").alias("n"))


@query("tk5_missing_order", f"SELECT type, n, CAST(row_number() OVER (ORDER BY n DESC, type) AS INTEGER) AS place FROM (SELECT type, count(*) AS n FROM ({CLASSED}) GROUP BY type)")
def _(spark, d):
    n = verdicts(spark, d).groupBy("type").agg(F.count("*").alias("n"))
    return n.withColumn("place", F.row_number().over(Window.orderBy(F.desc("n"), "type")))


@query("outcome_totals", f"SELECT event_type, count(*) AS n, count(*) FILTER (ok) AS good FROM ({_OUT}) GROUP BY event_type")
def _(spark, d):
    return outcomes(spark, d).groupBy("event_type").agg(F.count("*").alias("n"), F.count_if("ok").alias("good"))
