"""Queries over small fixed cases, for what SQL can't compute: the expected rows, written by hand, are the SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessella.operators import brand as B
from tessella.operators import contracts as CT
from tessella.operators import ground as G
from tessella.operators import readiness as R
from tessella.operators.parse import parsed
from tessella.operators.records import records
from tessella.schema import CrawlOptions
from tessella.sources.sinks import chunk_text

ENTRIES: dict = {}


def values(columns: str, *rows: tuple) -> str:
    """The rows as SQL."""

    def said(v: object) -> str:
        if v is None:
            return "NULL"
        return str(v).lower() if isinstance(v, bool) else str(v) if isinstance(v, int) else f"{v}::DOUBLE" if isinstance(v, float) else "'" + str(v).replace("'", "''") + "'"

    return f"SELECT * FROM (VALUES {', '.join('(' + ', '.join(map(said, r)) + ')' for r in rows)}) t({columns})"


def query(name: str, sql: str):  # noqa: ANN201
    def keep(f):  # noqa: ANN001, ANN202
        ENTRIES[name] = (f, sql)
        return f

    return keep


def pages(spark, *html: str):  # noqa: ANN001, ANN201
    return spark.createDataFrame([(i, f"https://a.example/{i}", h) for i, h in enumerate(html)], "page_id int, url string, html string")


MARKDOWN = (
    ("<body><h1>A <em>b</em></h1><p>One<br>two &amp; <strong>three</strong></p><ul><li>x<li>y<ul><li>z</ul></ul>", "# A *b*\n\nOne  \ntwo & **three**\n\n-   x\n-   y\n    -   z"),
    ("<body><ol><li>a<li>b</ol><blockquote>q</blockquote><pre><code>x = 1\ny</code></pre>", "1.  a\n2.  b\n\n> q\n\n```\nx = 1\ny\n```"),
    ("<body><table><tr><th>K<th>V<tr><td>a|b<td>1</table>", "| K | V |\n| --- | --- |\n| a\\|b | 1 |"),
)


@query("ex11_markdown_cases", values("page_id, markdown", *((i, md) for i, (_, md) in enumerate(MARKDOWN))))
def _(spark, d):
    return parsed(pages(spark, *(h for h, _ in MARKDOWN)), "markdown").select("page_id", "markdown")


@query("ex12_html_cases", values("page_id, html", (0, "<p>One</p><p>Two <b>x</b></p>"), (1, "<div id=\"m\">y</div>")))
def _(spark, d):
    return parsed(pages(spark, "<html><head><title>t</title></head><body><p>One<p>Two <b>x</b></p></body></html>", "<body><div id=m>y</div>"), "html").select("page_id", F.regexp_replace("html", r"^\s*<html.*?<body>|</body>.*$", "").alias("html"))


@query("st1_chunk_cases", values("page_id, index, section, text, charCount", (0, 0, "B", "# A\n\nfirst part of ten", 22), (0, 1, "C", "t of ten\n\n## B\n\nsecond part here", 32), (0, 2, "C", "art here\n\n### C\n\nthird", 22), (1, 0, None, "no heading at all", 17)))
def _(spark, d):
    texts = spark.createDataFrame([(0, "# A\n\nfirst part of ten\n\n## B\n\nsecond part here\n\n### C\n\nthird"), (1, "no heading at all"), (2, ""), (3, None)], "page_id int, md string")
    from tessella.operators.embed import chunked

    return texts.select("page_id", F.explode(chunked(36, 10)("md")).alias("c")).select("page_id", "c.index", "c.section", "c.text", "c.charCount")


@query("snk6_chunk_text_cases", values("k, text", (0, "md\n\n--- chunk 0 (S) ---\none\n\n--- chunk 1 ---\ntwo"), (1, "alone")))
def _(spark, d):
    kind = "k int, md string, chunks array<struct<index:int,section:string,text:string>>"
    return spark.createDataFrame([(0, "md", [(0, "S", "one"), (1, None, "two")]), (1, "alone", None)], kind).select("k", chunk_text(F.col("md"), F.col("chunks")).alias("text"))


HITS = [
    (1, "#112233", "a", 0.1), (1, "#ff0000", "b", 0.3), (1, "#fe0102", "c", 0.2), (1, "#00ff00", "style:var--brand", 0.1), (1, "#ffffff", "d", 9.0),
    (2, "#111111", "a", 1.0), (2, "#eeeeee", "b", 2.0), (3, "#ffffff", "a", 1.0), (3, "#0000ff", "b", 0.1),
]


@query("br2_palette_cases", values(
    "page_id, place, hex, role, weight", (1, 0, "#ff0000", "accent", 0.5), (1, 1, "#00ff00", "primary", 0.1), (1, 2, "#112233", "background", 0.1),
    (2, 0, "#111111", "primary", 1.0), (2, 1, "#eeeeee", "background", 2.0), (3, 0, "#0000ff", "background", 0.1), (3, 1, "#ffffff", "primary", 1.5),
))
def _(spark, d):
    """Near reds merge; grey goes unless there is nothing else, or it is the theme colour."""
    themes = spark.createDataFrame([(1, None), (2, None), (3, "#ffffff")], "page_id int, themeColor string")
    got = B.palettes(spark.createDataFrame(HITS, "page_id int, value string, source string, weight double"), themes)
    return got.select("page_id", F.posexplode("palette").alias("place", "p")).select("page_id", "place", "p.hex", "p.role", "p.weight")


_FLAT = "This bright home has a large garden and is close to shops, schools and the station. " * 6


@query("dg1_signal_cases", values(
    "page_id, score, verdict, missing", (0, 95, "ready", "structured-data-signal"), (1, 30, "needs-review", "price-signal,location-signal,bed-bath-signal,listing-language,image-signal,structured-data-signal,contact-signal"),
    (2, 0, "needs-review", "content-volume,title-signal,price-signal,location-signal,bed-bath-signal,listing-language,image-signal,structured-data-signal,contact-signal"),
))
def _(spark, d):
    html = (
        f"<title>Two bedroom flat</title><body><p>{_FLAT}</p><p>For sale: 2 bedrooms, London, £450,000</p><img src=a.png><form action=/ask><input name=q></form>",
        "<title>Some long title</title><body><p>" + "Nothing of that kind is told in these words. " * 12, "<title>Short</title><body><p>Hello",
    )
    df = R.diagnose(records(pages(spark, *html), CrawlOptions(extractMarkdown=True, extractEmails=True, extractPhones=True)), "real-estate-listing")
    return df.select("page_id", "score", "verdict", F.array_join("missingReadinessSignals", ",").alias("missing"))


GROUNDED = (("Acme Corp", "the ACME   corp sells", True), ("42", "only 41 left", False), ("12,500.5", "pays 12500.5 a year", True), ("Beta", "alpha only", False), (None, "anything", True), ("Café", "the CAFE is open", True))


@query("g2_grounded_cases", values("k, grounded", *((i, g) for i, (_, _, g) in enumerate(GROUNDED))))
def _(spark, d):
    rows = spark.createDataFrame([(i, v, t) for i, (v, t, _) in enumerate(GROUNDED)], "k int, value string, text string")
    return rows.select("k", G.grounded_text("value", "text").alias("grounded"))


@query("g3_record_cases", values("k, title, price, nulled", (0, "Red bike", "120", ""), (1, None, "120", "title"), (2, "Red bike", None, "offer.price"), (3, None, None, "title,offer.price")))
def _(spark, d):
    texts = spark.createDataFrame([(0, "A red  bike for 120 euros"), (1, "A blue boat for 120 euros"), (2, "A red bike"), (3, "")], "k int, text string")
    got = texts.select("k", G.ground_json(F.lit('{"title": "Red bike", "offer": {"price": 120}}'), F.col("text")).alias("g"))
    return got.select("k", F.get_json_object("g.data", "$.title").alias("title"), F.get_json_object("g.data", "$.offer.price").alias("price"), F.array_join("g.nulledFields", ",").alias("nulled"))


@query("ct1_names", values("name, place", ("brand-context", 1), ("docs-page", 2), ("product-page", 3), ("real-estate-listing", 4)))
def _(spark, d):
    return spark.createDataFrame([(n, i + 1) for i, n in enumerate(CT.names())], "name string, place int")


BLOCKED = (("localhost", True), ("a.LOCALHOST.", True), ("db.internal", True), ("nas.local", True), ("box.lan", True), ("metadata.google.internal", True), ("", True), ("10.0.0.1", True), ("example.com", False), ("internal.example.com", False), ("8.8.8.8", False), (None, True))


@query("pr5_blocked_cases", values("k, blocked", *((i, b) for i, (_, b) in enumerate(BLOCKED))))
def _(spark, d):
    from tessella.functions.urls import blocked_host

    return spark.createDataFrame([(i, h) for i, (h, _) in enumerate(BLOCKED)], "k int, h string").select("k", blocked_host(F.col("h")).alias("blocked"))


ERRORS = (("HTTP 429 Too Many Requests", None, "rate-limit", True), ("failed", 503, "http-5xx", True), ("failed", 404, "http-4xx", False), ("navigation timeout", None, "timeout", True), ("getaddrinfo ENOTFOUND x", None, "dns", False))


@query("cl1_error_cases", values("k, type, retryable", *((i, t, r) for i, (_, _, t, r) in enumerate(ERRORS))))
def _(spark, d):
    from tessella.functions.errors import error_class

    df = spark.createDataFrame([(i, m, c) for i, (m, c, _, _) in enumerate(ERRORS)], "k int, m string, code int")
    return df.select("k", error_class(F.col("m"), F.col("code")).alias("c")).select("k", "c.type", "c.retryable")


COLOURS = (("Teal !important", "#008080"), ("#abc", "#aabbcc"), ("#AABBCC80", "#aabbcc"), ("rgb(100% 0% 50% / .5)", "#ff0080"), ("rgba(1,2,3,0.05)", None), ("hsl(120, 100%, 25%)", "#008000"), ("transparent", None), ("var(--x)", None), ("red", "#ff0000"), ("white", "#ffffff"))


@query("co5_colour_cases", values("k, hex", *((i, h) for i, (_, h) in enumerate(COLOURS))))
def _(spark, d):
    from tessella.functions.colours import normalise

    return spark.createDataFrame([(i, c) for i, (c, _) in enumerate(COLOURS)], "k int, c string").select("k", normalise(F.col("c")).alias("hex"))
