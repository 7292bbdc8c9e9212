"""Queries of column expressions: text, URLs, hosts, errors, colours, keys, records."""

from __future__ import annotations

import functools

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.functions import colours as K
from tessella.functions import errors as E
from tessella.functions import keys
from tessella.functions import text as X
from tessella.functions import urls as U
from tessella.operators import contracts as CT
from tessella.operators import embed as EM
from tessella.operators import ground as G
from tessella.operators.records import ADVICE, error_message
from tessella.plans.generated import MESSAGES, STATUSES, outcomes, say, spread, table
from tessella.schema import CrawlOptions
from tessella.sources import sinks, web

ENTRIES: dict = {}


def query(name: str, sql: str | None = None):  # noqa: ANN201
    def keep(f):  # noqa: ANN001, ANN202
        ENTRIES[name] = (f, sql)
        return f

    return keep


def pick(values, n):  # noqa: ANN001, ANN201
    """One of some literals, by number."""
    return F.element_at(F.array(*map(F.lit, values)), (n % len(values) + 1).cast("int"))


def sql_pick(values, n: str) -> str:  # noqa: ANN001
    return f"CASE ({n}) % {len(values)} " + " ".join(f"WHEN {i} THEN '{v}'" for i, v in enumerate(values)) + " END"


# Text.
@query("st2_collapse", r"SELECT doc_id, trim(regexp_replace(text, '\s+', ' ', 'g')) AS flat FROM documents")
def _(spark, d):
    return table(spark, d, "documents").select("doc_id", X.collapse(F.col("text")).alias("flat"))


@query("st4_normalise")
def _(spark, d):
    return table(spark, d, "documents").select("doc_id", G.normalised("text").alias("plain"))


@query("st5_canonical_number", r"SELECT o_orderkey, regexp_extract(replace(t, ',', ''), '\d+(?:\.\d+)?') AS number FROM (SELECT o_orderkey, 'about ' || CAST(o_orderkey AS BIGINT) || ',500.' || (o_orderkey % 90) || ' or 7' AS t FROM orders)")
def _(spark, d):
    k = F.col("o_orderkey").cast("string")
    t = F.concat(F.lit("about "), k, F.lit(",500."), (F.col("o_orderkey") % 90).cast("string"), F.lit(" or 7"))
    return table(spark, d, "orders").select("o_orderkey", X.canonical_number(t).alias("number"))


@query("st6_clip", r"SELECT doc_id, CASE WHEN length(s) > 80 THEN left(s, 79) || '…' ELSE s END AS sample FROM (SELECT doc_id, trim(regexp_replace(text, '\s+', ' ', 'g')) AS s FROM documents)")
def _(spark, d):
    return table(spark, d, "documents").select("doc_id", X.clip(F.col("text")).alias("sample"))


NAMES = ("Unit_Price", "  Size ", "@type", "a__b  c", "___", "SKU")


@query("st7_field_name", r"SELECT event_id, CASE WHEN k <> '' AND k[1] <> '@' THEN k END AS key FROM (SELECT event_id, trim(regexp_replace(lower(trim(regexp_replace(" + sql_pick(NAMES, "event_id") + r", '_+', ' ', 'g'))), '[_\s]+', ' ', 'g')) AS k FROM events)")
def _(spark, d):
    return table(spark, d, "events").select("event_id", X.field_key(pick(NAMES, F.col("event_id"))).alias("key"))


@query("st9_table_cell", r"SELECT doc_id, replace(replace(text, '|', '\|'), chr(10), ' ') AS cell FROM documents")
def _(spark, d):
    return table(spark, d, "documents").select("doc_id", X.table_cell(F.col("text")).alias("cell"))


@query("st10_fence", "SELECT event_id, trim(props) AS body FROM events")
def _(spark, d):
    fenced = F.when(F.col("event_id") % 2 == 0, F.concat(F.lit("```json\n"), "props", F.lit("\n``` "))).otherwise(F.col("props"))
    return table(spark, d, "events").select("event_id", X.fence_stripped(fenced).alias("body"))


SAID = (" N/A ", "null", "None", "Not Found", "value", "", "na", "not specified", "unknown")


@query("st11_absent", "SELECT event_id, CASE WHEN event_id % 9 IN (2, 4, 6, 8) THEN " + sql_pick(SAID, "event_id") + " END AS given FROM events")
def _(spark, d):
    return table(spark, d, "events").select("event_id", X.absent_to_null(pick(SAID, F.col("event_id"))).alias("given"))


@query("st13_truncate", "SELECT doc_id, CAST(CASE WHEN length(text) > 1000 THEN 1020 ELSE length(text) END AS INTEGER) AS n FROM documents")
def _(spark, d):
    return table(spark, d, "documents").select("doc_id", F.length(X.truncated_prompt(F.col("text"), 1000)).alias("n"))


@query("hk1_md5", "SELECT doc_id, left(md5(text), 12) AS hash FROM documents")
def _(spark, d):
    return table(spark, d, "documents").select("doc_id", X.short_md5(F.col("text")).alias("hash"))


@query("hk2_crawl_key", "SELECT url, left(sha256('1|' || url || '|" + keys.shape(CrawlOptions()).replace("'", "''") + "'), 16) AS key FROM pages")
def _(spark, d):
    return table(spark, d, "pages").select("url", keys.crawl_key(F.col("url"), CrawlOptions()).alias("key"))


@query("hk3_extract_key", "SELECT url, 'x' || left(sha256('1|' || url || '|" + keys.stable_json({"contract": "docs-page", "model": "m"}) + "|" + keys.shape(CrawlOptions()).replace("'", "''") + "'), 23) AS key FROM pages")
def _(spark, d):
    return table(spark, d, "pages").select("url", keys.extract_key(F.col("url"), CrawlOptions(), model="m", contract="docs-page").alias("key"))


@query("st1_chunks")
def _(spark, d):
    doc = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", "role", "text"))), lambda x: F.concat(F.lit("# "), x["role"], F.lit("\n\n"), x["text"], F.lit("\n"))), "")
    md = table(spark, d, "conversations").groupBy("conv_id").agg(doc.alias("md"))
    return md.select("conv_id", F.explode(EM.chunked(600, 50)("md")).alias("c")).select("conv_id", "c.index", "c.section", "c.charCount", "c.hash")


@query("w8_section_carried", "SELECT conv_id, turn, last_value(CASE WHEN turn % 3 = 0 THEN role END IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS section FROM conversations")
def _(spark, d):
    from pyspark.sql import Window

    w = Window.partitionBy("conv_id").orderBy("turn").rowsBetween(Window.unboundedPreceding, 0)
    return table(spark, d, "conversations").select("conv_id", "turn", F.last(F.when(F.col("turn") % 3 == 0, F.col("role")), ignorenulls=True).over(w).alias("section"))


# Addresses.
@query("src1_url_list", "SELECT CASE WHEN starts_with(u, 'http') THEN u ELSE 'https://' || u END AS url FROM (SELECT CASE WHEN page_id % 2 = 0 THEN regexp_replace(url, '^https?://', '') ELSE url END AS u FROM pages)")
def _(spark, d):
    bare = F.when(F.col("page_id") % 2 == 0, F.regexp_replace("url", "^https?://", "")).otherwise(F.col("url"))
    return table(spark, d, "pages").select(U.with_scheme(bare).alias("url"))


@query("pr1_globs", r"SELECT page_id, regexp_matches(url, '(?i)^.*/en/.*$') AND NOT regexp_matches(url, '(?i)^.*.html$') AS passes FROM pages")
def _(spark, d):
    return table(spark, d, "pages").select("page_id", U.glob_passes(F.col("url"), ["*/EN/*"], ["*.html"]).alias("passes"))


ODD_URLS = ("", "ftp://a.com/x", "http://localhost:80/a", "https://EXAMPLE.com", "http://10.0.0.1/", "/relative", "https://x.internal/", "http://user@[::1]/", "http://8.8.8.8/x y")
REASONS = ("empty", "scheme", "blocked host", None, "blocked host", "not absolute", "blocked host", "blocked host", None)


@query("pr4_public_url", "SELECT event_id, CASE event_id % 9 " + " ".join(f"WHEN {i} THEN {repr(r) if r else 'NULL'}" for i, r in enumerate(REASONS)) + " END AS reason FROM events")
def _(spark, d):
    return table(spark, d, "events").select("event_id", U.public_url_reason(pick(ODD_URLS, F.col("event_id"))).alias("reason"))


HOSTS = ("localhost", "a.localhost", "db.internal", "printer.local.", "x.lan", "metadata", " ", "example.com", "localhost.com", "internal")


@query("pr5_blocked_host", "SELECT event_id, event_id % 10 < 7 AS blocked FROM events")
def _(spark, d):
    return table(spark, d, "events").select("event_id", U.blocked_host(pick(HOSTS, F.col("event_id"))).alias("blocked"))


_IP = "SELECT o_orderkey, CAST(o_orderkey % 260 AS INTEGER) AS a, CAST((o_orderkey // 7) % 259 AS INTEGER) AS b, CAST(o_orderkey % 4 AS INTEGER) AS form FROM orders"
_PRIVATE = "a > 255 OR b > 255 OR a IN (0, 10, 127) OR (a = 169 AND b = 254) OR (a = 172 AND b BETWEEN 16 AND 31) OR (a = 192 AND b IN (0, 168)) OR (a = 100 AND b BETWEEN 64 AND 127) OR (a = 198 AND b IN (18, 19)) OR a >= 224"


@query("pr6_private_ip", f"SELECT o_orderkey, CASE WHEN form = 3 THEN a % 2 = 0 WHEN form = 2 AND (a > 255 OR b > 255) THEN false ELSE ({_PRIVATE}) END AS private FROM ({_IP})")
def _(spark, d):
    a, b = (F.col("o_orderkey") % 260).cast("int"), (F.floor(F.col("o_orderkey") / 7) % 259).cast("int")
    dotted = F.concat_ws(".", a.cast("string"), b.cast("string"), F.lit("7"), F.lit("9"))
    hexed = F.when((a > 255) | (b > 255), F.lit("::ffff:zz")).otherwise(F.concat(F.lit("::FFFF:"), F.lower(F.hex(a * 256 + b)), F.lit(":0709")))
    v6 = F.when(a % 2 == 0, F.concat(F.lit("fe80::"), F.lower(F.hex(a)))).otherwise(F.concat(F.lit("[2606:4700::"), F.lower(F.hex(a)), F.lit("]")))
    form = F.col("o_orderkey") % 4
    ip = F.when(form == 3, v6).when(form == 2, hexed).when(form == 1, F.concat(F.lit("::ffff:"), dotted)).otherwise(dotted)
    return table(spark, d, "orders").select("o_orderkey", U.private_ip(ip).alias("private"))


NAMED_HOSTS = ("www.a.co.uk", "b.co.uk", "x.y.example.com", "example.com", "deep.a.co.uk", "other.com.au", "localhost", "EXAMPLE.com.")
DOMAINS = ("a.co.uk", "b.co.uk", "example.com", "example.com", "a.co.uk", "other.com.au", "localhost", "example.com")


@query("pr9_same_site", "SELECT event_id, (" + sql_pick(DOMAINS, "event_id") + ") = (" + sql_pick(DOMAINS, "event_id // 8") + ") AS same FROM events")
def _(spark, d):
    return table(spark, d, "events").select("event_id", U.same_site(pick(NAMED_HOSTS, F.col("event_id")), pick(NAMED_HOSTS, F.floor(F.col("event_id") / 8))).alias("same"))


@query("ur3_registrable_domain", "SELECT event_id, " + sql_pick(DOMAINS, "event_id") + " AS domain FROM events")
def _(spark, d):
    return table(spark, d, "events").select("event_id", U.registrable_domain(pick(NAMED_HOSTS, F.col("event_id"))).alias("domain"))


@query("ur2_host", "SELECT page_id, lower(regexp_extract(url, '^https?://([^/?#:]*)', 1)) AS host FROM pages")
def _(spark, d):
    return table(spark, d, "pages").select("page_id", U.host(F.col("url")).alias("host"))


FILES = ("a.PNG", "b.jpeg?x=1", "c.svg", "data:image/svg+xml,x", "d.txt", "e.webp")


@query("ur4_image_type", "SELECT event_id, " + sql_pick(("png", "jpg", "svg", "svg", "", "webp"), "event_id").replace("''", "NULL") + " AS kind FROM events")
def _(spark, d):
    return table(spark, d, "events").select("event_id", U.image_type(pick(FILES, F.col("event_id"))).alias("kind"))


@query("pr8_headers", "SELECT event_id, 'accept' AS kept, 'host,proxy-x,x-forwarded-for' AS dropped FROM events")
def _(spark, d):
    h = F.create_map(F.lit("Host"), F.lit("a"), F.lit("accept"), F.col("event_type"), F.lit("X-Forwarded-For"), F.lit("b"), F.lit(" proxy-x"), F.lit("c"))
    return table(spark, d, "events").select("event_id", F.array_join(F.map_keys(U.clean_headers(h)), ",").alias("kept"), F.array_join(U.dropped_headers(h), ",").alias("dropped"))


# Errors.
_M = sql_pick(MESSAGES, "event_id")
_S = "CASE (event_id // 10) % 10 " + " ".join(f"WHEN {i} THEN {v}" for i, v in enumerate(STATUSES)) + " END"
_OUT = f"SELECT event_id AS id, user_id, event_type, CASE WHEN event_id % 11 <> 0 THEN {_M} END AS message, {_S} AS code, event_id % 4 <> 0 AS ok, CAST(event_id % 101 AS INTEGER) AS score FROM events"


def _any(words) -> str:  # noqa: ANN001
    return "(" + " OR ".join(f"contains(m, '{w}')" for w in words) + ")"


_TYPE = f"CASE WHEN code = 429 OR {_any(E.RATE_LIMIT)} THEN 'rate-limit' WHEN code BETWEEN 500 AND 599 THEN 'http-5xx' WHEN code = 403 OR {_any(E.BLOCKED)} THEN 'blocked-bot' WHEN code BETWEEN 400 AND 499 THEN 'http-4xx' WHEN {_any(E.DNS)} THEN 'dns' WHEN {_any(E.TIMEOUT)} THEN 'timeout' WHEN {_any(E.NETWORK)} THEN 'network' WHEN {_any(E.PARSE)} THEN 'parse' ELSE 'unknown' END"
CLASSED = f"SELECT *, {_TYPE} AS type FROM (SELECT *, lower(coalesce(message, '')) AS m FROM ({_OUT}))"


@query("cl1_error_class", f"SELECT id, type, type IN ('rate-limit', 'http-5xx', 'timeout', 'network') AS retryable FROM ({CLASSED})")
def _(spark, d):
    return outcomes(spark, d).select("id", E.error_class(F.col("message"), F.col("code")).alias("c")).select("id", "c.type", "c.retryable")


@query("cl2_error_page", f"SELECT id, CASE WHEN type = 'blocked-bot' THEN message || '{ADVICE}' ELSE message END AS error FROM ({CLASSED})")
def _(spark, d):
    return outcomes(spark, d).select("id", error_message(F.col("message"), E.error_type(F.col("message"), F.col("code"))).alias("error"))


@query("cl3_llm_error", f"SELECT id, CASE WHEN contains(m, 'aborted') OR contains(m, 'timeout') THEN 'llm-timeout' WHEN contains(m, 'http ') THEN 'llm-http-error' ELSE 'llm-network' END AS kind FROM ({CLASSED})")
def _(spark, d):
    return outcomes(spark, d).select("id", E.llm_error(F.col("message")).alias("kind"))


@query("snk1_totals", f"SELECT count(*) AS totalScraped, count(*) FILTER (NOT ok) AS totalErrors, CAST(max(score) AS INTEGER) AS durationMs FROM ({_OUT})")
def _(spark, d):
    return sinks.run_totals(outcomes(spark, d).select(F.when(F.col("ok"), "success").otherwise("error").alias("status"), F.col("score").alias("responseTimeMs")))


@query("snk5_charged", f"SELECT count(*) FILTER (ok) AS charged, CAST(0 AS BIGINT) AS dry FROM ({_OUT})")
def _(spark, d):
    p = outcomes(spark, d).select(F.when(F.col("ok"), "success").otherwise("error").alias("status"))
    return sinks.charged(p).crossJoin(sinks.charged(p, dry_run=True).withColumnRenamed("charged", "dry"))


@query("snk3_json_document")
def _(spark, d):
    return sinks.json_document(table(spark, d, "pages"))


# Colours.
_RGB = "SELECT p_partkey, CAST(p_partkey * 7 % 256 AS INTEGER) AS r, CAST(p_partkey * 13 % 256 AS INTEGER) AS g, CAST(p_partkey * 29 % 256 AS INTEGER) AS b, CAST(p_partkey % 5 AS INTEGER) AS form FROM part"
_HEX = "'#' || printf('%02x', r) || printf('%02x', g) || printf('%02x', b)"


def rgb(spark, d):  # noqa: ANN001, ANN201
    k = F.col("p_partkey")
    return table(spark, d, "part").select("p_partkey", *((k * m % 256).cast("int").alias(c) for c, m in (("r", 7), ("g", 13), ("b", 29))), (k % 5).cast("int").alias("form"))


def css(df):  # noqa: ANN001, ANN201
    r, g, b = (F.col(c).cast("string") for c in "rgb")
    h = F.concat(F.lit("#"), *(F.lpad(F.hex(c), 2, "0") for c in "rgb"))
    form = F.col("form")
    return (
        F.when(form == 0, h).when(form == 1, F.concat(F.lit("rgb("), r, F.lit(", "), g, F.lit(","), b, F.lit(")"))).when(form == 2, F.concat(F.lit("RGBA("), r, F.lit(" "), g, F.lit(" "), b, F.lit(" / 50%) !important")))
        .when(form == 3, F.concat(F.lit("rgba("), r, F.lit(","), g, F.lit(","), b, F.lit(",0.05)"))).otherwise(F.lit("var(--x)"))
    )


@query("co5_normalise", f"SELECT p_partkey, CASE WHEN form < 3 THEN {_HEX} END AS hex FROM ({_RGB})")
def _(spark, d):
    df = rgb(spark, d)
    return df.select("p_partkey", K.normalise(css(df)).alias("hex"))


@query("co1_hex", f"SELECT p_partkey, r, g, b, round(CASE WHEN form = 0 THEN 1.0 ELSE form / 255.0 END, 6) AS a FROM ({_RGB})")
def _(spark, d):
    h = F.concat(*(F.lpad(F.hex(c), 2, "0") for c in "rgb"), F.when(F.col("form") == 0, "").otherwise(F.lpad(F.hex("form"), 2, "0")))
    return rgb(spark, d).select("p_partkey", K.hex_rgba(h).alias("c")).select("p_partkey", "c.r", "c.g", "c.b", F.round("c.a", 6).alias("a"))


@query("co2_rgb", f"""SELECT p_partkey, CASE WHEN form = 3 THEN round(p * 255 / 100.0) ELSE r END::DOUBLE AS r, CASE WHEN form = 3 THEN 0 ELSE g END::DOUBLE AS g, CASE WHEN form = 3 THEN 255 ELSE b END::DOUBLE AS b,
  CASE form WHEN 1 THEN 0.5 WHEN 2 THEN p / 100.0::DOUBLE ELSE 1 END::DOUBLE AS a FROM (SELECT *, p_partkey % 101 AS p FROM ({_RGB}))""")
def _(spark, d):
    """Commas; commas and alpha; blanks, slash and percent alpha; percent channels; blanks."""
    r, g, b, p = (F.col(c).cast("string") for c in ("r", "g", "b", "p"))
    df = rgb(spark, d).withColumn("p", F.col("p_partkey") % 101)
    forms = (say("rgb( ", r, " , ", g, " , ", b, " )"), say("rgba(", r, ",", g, ",", b, ",0.5)"), say("RGB(", r, " ", g, " ", b, " / ", p, "%)"), say("rgb(", p, "%, 0%, 100%)"), say("rgb(", r, " ", g, " ", b, ")"))
    text = F.element_at(F.array(*forms), (F.col("p_partkey") % 5 + 1).cast("int"))
    return df.select("p_partkey", K.rgb_rgba(text).alias("c")).select("p_partkey", *(F.col(f"c.{x}").cast("double").alias(x) for x in "rgba"))


@query("co3_hsl", """
WITH x AS (SELECT p_partkey, CAST(p_partkey % 360 AS DOUBLE) AS h, (p_partkey % 101) / 100.0::DOUBLE AS s, ((p_partkey // 3) % 101) / 100.0::DOUBLE AS l FROM part),
y AS (SELECT *, s * least(l, 1 - l) AS a FROM x),
z AS (SELECT p_partkey, l, a, (0 + h / 30) % 12 AS k0, (8 + h / 30) % 12 AS k8, (4 + h / 30) % 12 AS k4 FROM y)
SELECT p_partkey, CAST(round(255 * (l - a * greatest(-1, least(k0 - 3, 9 - k0, 1)))) AS INTEGER) AS r, CAST(round(255 * (l - a * greatest(-1, least(k8 - 3, 9 - k8, 1)))) AS INTEGER) AS g,
  CAST(round(255 * (l - a * greatest(-1, least(k4 - 3, 9 - k4, 1)))) AS INTEGER) AS b FROM z""")
def _(spark, d):
    k = F.col("p_partkey")
    text = F.concat(F.lit("hsl("), (k % 360).cast("string"), F.lit(", "), (k % 101).cast("string"), F.lit("%, "), (F.floor(k / 3) % 101).cast("string"), F.lit("%)"))
    return table(spark, d, "part").select("p_partkey", K.hsl_rgba(text).alias("c")).select("p_partkey", "c.r", "c.g", "c.b")


@query("co4_named", "SELECT event_id, " + sql_pick(tuple(K.NAMED.values()), "event_id") + " AS hex FROM events")
def _(spark, d):
    return table(spark, d, "events").select("event_id", K.normalise(F.initcap(pick(tuple(K.NAMED), F.col("event_id")))).alias("hex"))


_HSL = f"SELECT *, (greatest(r,g,b) + least(r,g,b)) / 510.0::DOUBLE AS l, (greatest(r,g,b) - least(r,g,b)) / 255.0::DOUBLE AS dd FROM ({_RGB})"
_HSL2 = f"SELECT *, CASE WHEN dd = 0 THEN 0 WHEN l > 0.5 THEN dd / (2 - 2 * l) ELSE dd / (2 * l) END AS s, 60 * CASE WHEN dd = 0 THEN 0 WHEN greatest(r,g,b) = r THEN (g - b) / 255.0::DOUBLE / dd + CASE WHEN g < b THEN 6 ELSE 0 END WHEN greatest(r,g,b) = g THEN (b - r) / 255.0::DOUBLE / dd + 2 ELSE (r - g) / 255.0::DOUBLE / dd + 4 END AS h FROM ({_HSL})"


@query("co6_hsl", f"SELECT p_partkey, round(h, 4) AS h, round(s, 6) AS s, round(l, 6) AS l FROM ({_HSL2})")
def _(spark, d):
    df = rgb(spark, d).select("p_partkey", K.hsl(F.struct("r", "g", "b")).alias("c"))
    return df.select("p_partkey", F.round("c.h", 4).alias("h"), F.round("c.s", 6).alias("s"), F.round("c.l", 6).alias("l"))


@query("pr11_neutral", f"SELECT p_partkey, l > 0.93 OR l < 0.07 OR s < 0.12 AS neutral FROM ({_HSL2})")
def _(spark, d):
    return rgb(spark, d).select("p_partkey", K.neutral(K.hsl(F.struct("r", "g", "b"))).alias("neutral"))


@query("co7_distance", f"SELECT p_partkey, round(sqrt(r * r + (g - 255) * (g - 255) + b * b), 6) AS d FROM ({_RGB})")
def _(spark, d):
    green = F.struct(F.lit(0).alias("r"), F.lit(255).alias("g"), F.lit(0).alias("b"))
    return rgb(spark, d).select("p_partkey", F.round(K.distance(F.struct("r", "g", "b"), green), 6).alias("d"))


@query("co8_hue_distance", f"SELECT p_partkey, round(CASE WHEN x > 180 THEN 360 - x ELSE x END, 4) AS d FROM (SELECT p_partkey, abs(h - 240) % 360 AS x FROM ({_HSL2}))")
def _(spark, d):
    df = rgb(spark, d)
    return df.select("p_partkey", F.round(K.hue_distance(K.to_hex(F.struct("r", "g", "b")), F.lit("#0000ff")), 4).alias("d"))


# Records, grounding, embeddings.
@query("ct1_registry")
def _(spark, d):
    return CT.registry(spark).orderBy("name")


_REC = """SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN '  ' ELSE 'Order' END AS name, CASE WHEN o_orderkey % 2 = 0 THEN 0.0 END AS amount, CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE 'https://x/' END AS src FROM orders"""


@query("ct2_validation", f"SELECT o_orderkey, concat_ws(',', CASE WHEN trim(name) = '' THEN 'name' END, CASE WHEN amount IS NULL THEN 'price' END, CASE WHEN src IS NULL THEN 'sourceUrl' END) AS missing, trim(name) <> '' AND amount IS NOT NULL AND src IS NOT NULL AS valid FROM ({_REC})")
def _(spark, d):
    k = F.col("o_orderkey")
    rec = F.to_json(F.struct(F.when(k % 3 == 0, "  ").otherwise("Order").alias("name"), F.struct(F.when(k % 2 == 0, 0.0).alias("amount")).alias("price"), F.when(k % 5 != 0, "https://x/").alias("sourceUrl")))
    df = CT.attach_validation(table(spark, d, "orders").select("o_orderkey", rec.alias("data"), F.lit("success").alias("status")), "product-page")
    return df.select("o_orderkey", F.array_join("validation.missingRequiredFields", ",").alias("missing"), "validation.valid")


@query("ct3_attach", "SELECT o_orderkey, CASE WHEN o_orderkey % 2 = 0 THEN 'docs-page' ELSE 'docs-page' END AS contract, CASE WHEN o_orderkey % 2 = 0 THEN false END AS valid FROM orders")
def _(spark, d):
    k = F.col("o_orderkey")
    df = CT.attach_validation(table(spark, d, "orders").select("o_orderkey", F.lit('["no object"]').alias("data"), F.when(k % 2 == 0, "success").otherwise("error").alias("status")), "docs-page")
    return df.select("o_orderkey", F.col("contract.name").alias("contract"), "validation.valid")


@query("ag12_tokens", r"SELECT doc_id, len(list_distinct(regexp_extract_all(lower(text), '[\p{L}\p{N}]{3,}'))) AS words, len(list_distinct(list_transform(regexp_extract_all(text, '\d[\d,]*(?:\.\d+)?'), lambda x: replace(x, ',', '')))) AS numbers FROM documents")
def _(spark, d):
    return table(spark, d, "documents").select("doc_id", F.size(G.source_tokens(F.col("text"))).cast("long").alias("words"), F.size(G.source_numbers(F.col("text"))).cast("long").alias("numbers"))


#: Benchmark items that are held against all documents at a time.
ITEMS = 4096


def each_item(spark, d, doc, item, f):  # noqa: ANN001, ANN201
    """``f`` over all documents (doc_id, ``doc`` of the text) and all items (item_id, ``item`` of the value), by blocks of items."""
    docs = spread(table(spark, d, "documents").select("doc_id", "text"), "doc_id").select("doc_id", doc(F.col("text")).alias("text"))
    items = table(spark, d, "benchmark").select("item_id", item(F.col("text")).alias("value"))
    n = max(1, -(-items.count() // ITEMS))
    return functools.reduce(DataFrame.union, [f(docs, items.filter(F.pmod(F.xxhash64("item_id", "value"), F.lit(n)) == b)) for b in range(n)])


@query("g2_contains", r"SELECT doc_id, item_id FROM (SELECT doc_id, trim(regexp_replace(lower(text), '\s+', ' ', 'g')) AS t FROM documents) JOIN (SELECT item_id, trim(regexp_replace(lower(text), '\s+', ' ', 'g')) AS v FROM benchmark) ON contains(t, v)")
def _(spark, d):
    return each_item(spark, d, G.flat, G.flat, lambda docs, items: docs.join(F.broadcast(items), F.col("text").contains(F.col("value")))).select("doc_id", "item_id")


@query("g2_grounded")
def _(spark, d):
    return each_item(spark, d, lambda c: c, lambda c: c, G.grounded_pairs)


@query("g3_ground_records")
def _(spark, d):
    rec = lambda c: F.to_json(F.struct(F.substring(c, 1, 40).alias("title"), F.struct(F.lit(19.9).alias("amount"), F.lit(True).alias("ok")).alias("price")))
    return each_item(spark, d, lambda c: c, rec, G.ground_pairs)


@query("j8_token_share", r"SELECT doc_id, item_id, round(len(list_intersect(v, t)) / nullif(len(v), 0), 6) AS share FROM (SELECT doc_id, list_distinct(regexp_extract_all(lower(text), '[\p{L}\p{N}]{3,}')) AS t FROM documents) CROSS JOIN (SELECT item_id, list_distinct(regexp_extract_all(lower(text), '[\p{L}\p{N}]{3,}')) AS v FROM benchmark)")
def _(spark, d):
    return each_item(spark, d, G.source_tokens, G.source_tokens, G.token_shares).withColumn("share", F.round("share", 6))


@query("em1_batches", "SELECT lang, batch, count(*) AS n, min(doc_id) AS first_id, sum(length(text)) AS chars FROM (SELECT lang, doc_id, text, (row_number() OVER (PARTITION BY lang ORDER BY doc_id) - 1) // 16 AS batch FROM documents) GROUP BY lang, batch")
def _(spark, d):
    df = EM.requests(table(spark, d, "documents").withColumn("t", F.concat_ws("\x01", F.col("doc_id").cast("string"), "text")), "lang", "doc_id", "t")
    first = F.split(F.get("input", F.lit(0)), "\x01")[0].cast("long")
    chars = F.aggregate("input", F.lit(0).cast("long"), lambda a, x: a + F.length(F.regexp_replace(x, "^[0-9]+\x01", "")))
    return df.select("lang", "batch", F.size("input").cast("long").alias("n"), first.alias("first_id"), chars.alias("chars"))


@query("j9_matched_vectors", "SELECT lang, (r - 1) // 16 AS batch, CAST((r - 1) % 16 AS INTEGER) AS index, CAST((r - 1) % 16 AS DOUBLE) AS value FROM (SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY doc_id) AS r FROM documents)")
def _(spark, d):
    req = EM.requests(table(spark, d, "documents"), "lang", "doc_id", "text")
    items = F.transform("input", lambda x, i: F.struct((F.size("input") - 1 - i).alias("index"), F.array((F.size("input") - 1 - i).cast("double")).alias("embedding")))
    res = req.select("lang", "batch", F.to_json(F.struct(items.alias("data"))).alias("response"))
    return EM.matched(req, res, "lang").select("lang", "batch", "index", F.col("vector")[0].alias("value"))


@query("ag15_embedding_totals", "SELECT CAST(len(arg_min(embedding, vec_id)) AS INTEGER) AS dims, count(*) AS n FROM embeddings")
def _(spark, d):
    return EM.totals(table(spark, d, "embeddings"), "embedding")


@query("src3_json_results", "SELECT event_id, 'https://r.example/' || event_id || '|http://s.example/' AS urls FROM events")
def _(spark, d):
    link = lambda c: F.struct(c.alias("link"))
    response = F.to_json(F.struct(F.array(link(F.concat(F.lit("https://r.example/"), F.col("event_id").cast("string"))), link(F.lit("ftp://no")), link(F.lit("http://s.example/")), link(F.lit("http://third/"))).alias("organic")))
    return table(spark, d, "events").select("event_id", F.array_join(web.json_results(response, 2), "|").alias("urls"))


@query("src3_html_results", "SELECT event_id, 'https://r.example/a b' || event_id || '|http://s.example/' AS urls FROM events")
def _(spark, d):
    page = F.concat(F.lit('<a href="/url?q=https://www.google.com/x&z"></a><a href="/url?q=https://r.example/a%20b'), F.col("event_id").cast("string"), F.lit('&x"></a><a href="/url?q=http://s.example/"></a><a href="/url?q=http://s.example/"></a>'))
    return table(spark, d, "events").select("event_id", F.array_join(web.html_results(page, 5), "|").alias("urls"))


@query("src11_provided", "SELECT event_id, CASE WHEN event_id % 3 = 0 THEN event_type WHEN event_id % 3 = 1 THEN '<p>' END AS content FROM events")
def _(spark, d):
    k = F.col("event_id")
    return table(spark, d, "events").select("event_id", web.provided(F.when(k % 3 < 2, "<p>").otherwise(" "), F.when(k % 3 == 0, F.col("event_type")).otherwise("  ")).alias("content"))


@query("src8_pdf_text", "SELECT p_partkey, p_name || ' ' || p_brand AS text, CAST(1 AS INTEGER) AS pages, p_type AS title FROM part")
def _(spark, d):
    pdf = F.concat(F.lit("%PDF-1.4\n<</Type /Page>>\nBT ("), "p_name", F.lit(") Tj ("), "p_brand", F.lit(") Tj ET\n/Title ("), "p_type", F.lit(")"))
    got = table(spark, d, "part").select("p_partkey", web.pdf_column(pdf.cast("binary")).alias("pdf"))
    return got.select("p_partkey", "pdf.text", "pdf.pages", F.try_element_at("pdf.metadata", F.lit("Title")).alias("title"))


@query("js4_repaired_answers", "SELECT event_id, user_id FROM events")
def _(spark, d):
    from tessella.operators.extract import parsed

    @F.udf("string")
    def repair(t):  # noqa: ANN001, ANN202
        import json

        return json.dumps(parsed(t))

    cut = F.concat(F.lit('```json\n{"user": '), F.col("user_id").cast("string"), F.lit(', "tags": ["a", "b'))
    return table(spark, d, "events").select("event_id", F.get_json_object(repair(cut), "$.user").cast("long").alias("user_id"))
