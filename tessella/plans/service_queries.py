"""Queries of what talks to services, with stand-ins for them: fetches, model calls, stores, streams, caches, documents."""

from __future__ import annotations

import io
import json
import zipfile

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.functions import keys
from tessella.functions.storage import new_path, stored
from tessella.operators import brand as B
from tessella.operators import contracts as CT
from tessella.operators import discover as FD
from tessella.operators import extract as X
from tessella.operators.records import records
from tessella.plans.generated import say, spread, table
from tessella.schema import CrawlOptions
from tessella.sources import sinks, web
from tessella.streaming import pages as S

ENTRIES: dict = {}


def query(name: str, sql: str | None = None):  # noqa: ANN201
    def keep(f):  # noqa: ANN001, ANN202
        ENTRIES[name] = (f, sql)
        return f

    return keep


def mapped(df: DataFrame, f, key: str, *columns: str, out: str = "value") -> DataFrame:  # noqa: ANN001
    """key and ``f`` of the columns (text of anything) for each row, in Arrow batches."""

    def run(batches):  # noqa: ANN001, ANN202
        for b in batches:
            rows = zip(*(b.column(c).to_pylist() for c in columns), strict=True)
            yield pa.RecordBatch.from_arrays([b.column("__key"), pa.array([f(*r) for r in rows], pa.string())], names=[key, out])

    return df.select(F.col(key).alias("__key"), *columns).mapInArrow(run, df.select(key).schema.add(out, "string"))


# Fetches.
class FakeSite:
    """Answers by what the address says: /ok, /moved, /loop, /inside, /gone, /busy (succeeds at the third try)."""

    def __init__(self) -> None:
        self.tries: dict[str, int] = {}

    def fetch(self, url: str, options: dict) -> dict:
        kind, _, k = url.split("/", 3)[3].partition("/")
        self.tries[url] = self.tries.get(url, 0) + 1
        if kind == "moved":
            return {"status": 302, "headers": {"Location": f"/ok/{k}"}}
        if kind == "loop":
            return {"status": 301, "headers": {"location": url}}
        if kind == "inside":
            return {"status": 302, "headers": {"location": "http://db.corp.example.com/"}}
        if kind == "gone":
            return {"status": 404, "headers": {}, "html": ""}
        if kind == "busy" and self.tries[url] % 3:
            raise OSError("connection reset")
        if kind == "down":
            return {"status": 503, "headers": {}}
        return {"status": 200, "headers": {"Content-Type": "text/html"}, "html": f"<title>{k}</title>"}


def fake_names(name: str) -> list[str]:
    return ["93.184.216.34", "10.1.2.3"] if name.startswith("db.") else ["93.184.216.34"]


KINDS = ("ok", "moved", "loop", "inside", "gone", "busy", "down")
_KIND = "['" + "','".join(KINDS) + "'][event_id % 7 + 1]"


@query("src5_fetch", f"""SELECT event_id, CASE k WHEN 'loop' THEN 301 WHEN 'inside' THEN 302 WHEN 'gone' THEN 404 WHEN 'down' THEN 503 ELSE 200 END AS status, CASE WHEN k IN ('ok', 'moved', 'busy') THEN '<title>' || event_id || '</title>' WHEN k = 'gone' THEN '' END AS html,
  CASE k WHEN 'loop' THEN 'too many redirects' WHEN 'inside' THEN 'blocked address: http://db.corp.example.com/' WHEN 'gone' THEN 'HTTP 404' WHEN 'down' THEN 'HTTP 503' END AS error,
  CASE k WHEN 'moved' THEN 2 WHEN 'loop' THEN 6 WHEN 'busy' THEN 3 WHEN 'down' THEN 3 ELSE 1 END AS attempts, CASE k WHEN 'moved' THEN 1 WHEN 'loop' THEN 6 WHEN 'inside' THEN 1 ELSE 0 END AS hops FROM (SELECT event_id, {_KIND} AS k FROM events)""")
def _(spark, d):
    kind = F.element_at(F.array(*map(F.lit, KINDS)), (F.col("event_id") % 7 + 1).cast("int"))
    urls = table(spark, d, "events").select("event_id", say("https://site.example/", kind, "/", F.col("event_id").cast("string")).alias("url"))
    got = web.fetched(urls, FakeSite(), fake_names)
    return got.select(F.regexp_extract("url", "[0-9]+$", 0).cast("long").alias("event_id"), F.col("statusCode").alias("status"), "html", "error", "attempts", "hops")


@query("pr7_private_hosts", "SELECT * FROM (VALUES ('127.0.0.1', true), ('8.8.8.8', false), ('[::1]', true), ('::ffff:10.0.0.1', true), ('2606:4700::1111', false), ('LocalHost', true), ('a.internal.', true), ('example.com', false), ('169.254.169.254', true), ('100.64.0.1', true), ('0.0.0.0', true), ('224.0.0.1', true), ('', true)) t(host, blocked)")
def _(spark, d):
    names = ("127.0.0.1", "8.8.8.8", "[::1]", "::ffff:10.0.0.1", "2606:4700::1111", "LocalHost", "a.internal.", "example.com", "169.254.169.254", "100.64.0.1", "0.0.0.0", "224.0.0.1", "")
    return mapped(spark.createDataFrame([(x,) for x in names], "host string"), lambda h: str(web.private_host(h)), "host", "host").select("host", F.col("value").cast("boolean").alias("blocked"))


# Documents.
@query("src9_lenient_pdf", "SELECT p_partkey, p_name || ' (' || p_brand || ') ' || p_type AS text FROM part")
def _(spark, d):
    data = say("%PDF-1.4 broken\nBT /F1 12 Tf (", F.col("p_name"), ") Tj % (not shown) Tj\n(\\(", F.col("p_brand"), "\\)) ' (", F.col("p_type"), ") Tj (kept by no operator) ET").cast("binary")
    return mapped(table(spark, d, "part").select("p_partkey", data.alias("b")), web.lenient_pdf_text, "p_partkey", "b", out="text")


def docx(title: str, line: str) -> bytes:
    out = io.BytesIO()
    w = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("word/document.xml", f'<w:document {w}><w:body><w:p><w:pPr><w:pStyle w:val="Heading2"/></w:pPr><w:r><w:t>{title}</w:t></w:r></w:p><w:p><w:r><w:rPr><w:b/></w:rPr><w:t>{line}</w:t></w:r></w:p></w:body></w:document>')
    return out.getvalue()


@query("src10_docx", "SELECT c_custkey, c_name || chr(10) || chr(10) || c_mktsegment AS text, '## ' || c_name || chr(10) || chr(10) || '**' || c_mktsegment || '**' AS markdown FROM customer")
def _(spark, d):
    read = lambda a, b: json.dumps(web.read_docx(docx(a, b)))
    got = mapped(spread(table(spark, d, "customer"), "c_custkey"), read, "c_custkey", "c_name", "c_mktsegment")
    return got.select("c_custkey", F.get_json_object("value", "$.text").alias("text"), F.get_json_object("value", "$.markdown").alias("markdown"))


# Sinks, written and read back.
@query("snk2_json_lines", "SELECT c_custkey, c_name FROM customer")
def _(spark, d):
    path = new_path(spark, "lines")
    sinks.write_json_lines(table(spark, d, "customer").select("c_custkey", "c_name"), path)
    return spark.read.schema("c_custkey long, c_name string").json(path)


@query("snk4_store", "SELECT 'report/' || n_nationkey AS key, CASE WHEN n_nationkey % 2 = 0 THEN 'new ' ELSE 'old ' END || n_name AS text, 'text/plain' AS type FROM nation")
def _(spark, d):
    path, n = new_path(spark, "store"), table(spark, d, "nation")
    put = lambda df, word: sinks.put_values(df.select(say("report/", F.col("n_nationkey").cast("string")).alias("key"), say(word, F.col("n_name")).alias("content"), F.lit("text/plain").alias("contentType")), path)
    put(n, "old ")
    put(n.filter("n_nationkey % 2 = 0"), "new ")
    return sinks.get_values(spark, path).select("key", F.col("content").cast("string").alias("text"), F.col("contentType").alias("type"))


# Model calls.
class FakeModel:
    """Answers by the address in the request."""

    def complete(self, system: str, user: str, response_format: dict) -> str:
        k = int(user.split("Address: ")[1].split("\n")[0].rsplit("/", 1)[1])
        case, size = k % 6, len(user.split("Content:\n")[1].removesuffix("\n\n[content cut here]"))
        if case == 1 and response_format["type"] != "text":
            raise X.LlmError("HTTP 400: response_format isn't known here", 400)
        if case == 2 and size > 9_000:
            raise X.LlmError("HTTP 400: maximum context length", 400)
        if case == 3:
            raise X.LlmError("request timeout")
        return {4: " ", 5: "sorry, no"}.get(case, json.dumps({"k": k, "form": response_format["type"], "size": size, "colour": "N/A"}))


_SIZE = "CASE WHEN n <= 30000 THEN n ELSE 30000 END"


@query("lm_calls", f"""SELECT doc_id, CASE WHEN c < 3 THEN 'success' ELSE 'error' END AS status, CASE c WHEN 3 THEN 'llm-timeout' WHEN 4 THEN 'llm-empty-response' WHEN 5 THEN 'json-parse-error' END AS type, CASE WHEN c < 3 THEN CASE WHEN c = 1 THEN 'text' ELSE 'json_schema' END END AS form,
  CAST(CASE WHEN c = 0 OR c = 1 THEN {_SIZE} WHEN c = 2 THEN CASE WHEN n <= 9000 THEN n WHEN least(n, 30000) // 2 <= 9000 THEN greatest(4000, least(n, 30000) // 2) ELSE greatest(4000, least(n, 30000) // 2 // 2) END END AS BIGINT) AS size
  FROM (SELECT doc_id, doc_id % 6 AS c, length(text) AS n FROM documents WHERE trim(text, ' ' || chr(9) || chr(10) || chr(13)) <> '')""")
def _(spark, d):
    docs = table(spark, d, "documents").filter(F.trim(F.col("text"), F.lit(" \t\n\r")) != "").select(say("https://d.example/", F.col("doc_id").cast("string")).alias("url"), F.col("text").alias("markdown"))
    options = X.ExtractOptions(schema={"type": "object", "properties": {"k": {"type": "integer"}}})
    got = X.extract(docs, FakeModel(), options)
    return got.select(F.regexp_extract("url", "[0-9]+$", 0).cast("long").alias("doc_id"), "status", F.col("errorType").alias("type"), F.get_json_object("data", "$.form").alias("form"), F.get_json_object("data", "$.size").cast("long").alias("size"))


@query("lm4_no_content", "SELECT event_id, 'error' AS status, 'no-page-content' AS type FROM events")
def _(spark, d):
    blank = F.when(F.col("event_id") % 2 == 0, " \n ")
    got = X.extract(table(spark, d, "events").select(F.col("event_id").cast("string").alias("url"), blank.alias("markdown")), FakeModel(), X.ExtractOptions())
    return got.select(F.col("url").cast("long").alias("event_id"), "status", F.col("errorType").alias("type"))


@query("st15_messages", "SELECT o_orderkey, 'Extract the data.' || chr(10) || 'Address: https://o/' || o_orderkey || chr(10) || chr(10) || 'Content:' || chr(10) || CASE WHEN length(o_orderpriority) <= 5 THEN o_orderpriority ELSE left(o_orderpriority, 5) || chr(10) || chr(10) || '[content cut here]' END AS value FROM orders")
def _(spark, d):
    told = lambda text, k: X.messages(text, f"https://o/{k}", X.ExtractOptions(), 5)[1]
    return mapped(table(spark, d, "orders"), told, "o_orderkey", "o_orderpriority", "o_orderkey")


@query("fd4_merged_fields", "SELECT p_partkey, 'price:1.0:meta,brand:' || CASE WHEN p_partkey % 2 = 0 THEN p_brand ELSE '' END || ':llm' AS fields, CASE WHEN p_partkey % 3 = 0 THEN 'listing' ELSE 'single' END AS type, CASE WHEN p_partkey % 3 = 0 THEN CAST(4 AS INTEGER) END AS items FROM part")
def _(spark, d):
    def merge(k, brand, name):  # noqa: ANN001, ANN202
        base = {"fields": [{"name": "price", "sample": "1.0", "source": "meta"}], "recordType": "single", "itemCount": None}
        proposal = {"fields": [{"name": "Price", "sample": "2"}, {"name": "brand", "sample": brand}, {"name": "@id", "sample": brand}], "recordType": "listing" if k % 3 == 0 else "single", "itemCount": 4.6}
        got = FD.merge_proposed(base, proposal, f"{name} by {brand.upper()}" if k % 2 == 0 else name)
        return json.dumps({"fields": ",".join(":".join((f["name"], f["sample"], f["source"])) for f in got["fields"]), "type": got["recordType"], "items": got["itemCount"]})

    got = mapped(table(spark, d, "part"), merge, "p_partkey", "p_partkey", "p_brand", "p_name")
    return got.select("p_partkey", *(F.get_json_object("value", f"$.{c}").cast(k).alias(c) for c, k in (("fields", "string"), ("type", "string"), ("items", "int"))))


# JSON.
@query("hk4_stable_json", """SELECT event_id, '{"a":{"x":[2,1],"y":"' || event_type || '"},"b":' || user_id || '}' AS value FROM events""")
def _(spark, d):
    made = lambda user, kind: keys.stable_json({"b": user, "a": {"y": kind, "x": [2, 1]}})
    return mapped(table(spark, d, "events"), made, "event_id", "user_id", "event_type")


SCHEMAS = (
    ('{"properties":{"a":{"type":"string"}}}', '{"properties":{"a":{"type":["string","null"]}}}'),
    ('{"properties":{"e":{"enum":["x"],"type":"string"},"c":{"const":1,"type":"integer"},"u":{"anyOf":[{"type":"string"}]}}}', '{"properties":{"c":{"const":1,"type":"integer"},"e":{"enum":["x"],"type":"string"},"u":{"anyOf":[{"type":"string"}]}}}'),
    ('{"items":{"properties":{"n":{"type":["number","null"]}}},"type":"array"}', '{"items":{"properties":{"n":{"type":["number","null"]}}},"type":"array"}'),
    ('{"$defs":{"d":{"type":"integer"}},"additionalProperties":{"type":"boolean"}}', '{"$defs":{"d":{"type":["integer","null"]}},"additionalProperties":{"type":["boolean","null"]}}'),
    ('{"properties":{"__proto__":{"type":"string"},"b":{"properties":{"c":{"type":"number"}},"type":"object"}}}', '{"properties":{"b":{"properties":{"c":{"type":["number","null"]}},"type":["object","null"]}}}'),
)


@query("js5_nullable_schemas", "SELECT * FROM (VALUES " + ", ".join(f"({i}, '{want}')" for i, (_, want) in enumerate(SCHEMAS)) + ") t(k, value)")
def _(spark, d):
    rows = spark.createDataFrame([(i, given) for i, (given, _) in enumerate(SCHEMAS)], "k int, s string")
    return mapped(rows, lambda s: keys.stable_json(CT.nullable_schema(json.loads(s))), "k", "s")


@query("js6_absent_values", """SELECT o_orderkey, '{"list":[null,"' || o_orderpriority || '"],"nested":{"deep":{"n":1}},"status":' || CASE WHEN o_orderkey % 2 = 0 THEN 'null' ELSE '"' || o_orderstatus || '"' END || '}' AS value FROM orders""")
def _(spark, d):
    def made(k, status, priority):  # noqa: ANN001, ANN202
        value = {"status": " N/A " if k % 2 == 0 else status, "list": ["not found", priority], "nested": {"deep": {"n": 1, "constructor": 2}, "prototype": {}}, "__proto__": 3}
        return keys.stable_json(CT.without_absent(value))

    return mapped(table(spark, d, "orders"), made, "o_orderkey", "o_orderkey", "o_orderstatus", "o_orderpriority")


# Streams and the cache.
def arriving(spark, d, folder):  # noqa: ANN001, ANN201
    """The pages as files of a stream, two for each core; gives the number of cores: so many at a time keep all of them busy, and make two batches."""
    cores = spark.sparkContext.defaultParallelism
    table(spark, d, "pages").select("page_id", "url", "html").repartition(2 * cores).write.parquet(folder)
    return cores


@query("ss1_record_stream", "SELECT page_id, url, 'success' AS status FROM pages")
def _(spark, d):
    source, sink = new_path(spark, "stream-in"), new_path(spark, "stream-out")
    cores = arriving(spark, d, source)
    out = S.record_stream(S.page_stream(spark, source, cores)).select("page_id", "url", "status")
    out.writeStream.format("parquet").option("path", sink).option("checkpointLocation", new_path(spark, "stream-state")).outputMode("append").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(out.schema).parquet(sink)


@query("ss3_readiness_stream", "SELECT 'docs-page' AS contract, count(*) AS n FROM pages")
def _(spark, d):
    source, sink = new_path(spark, "stream-in"), new_path(spark, "stream-out")
    cores = arriving(spark, d, source)
    out = S.readiness_stream(S.page_stream(spark, source, cores))

    def keep(rows: DataFrame, batch: int) -> None:
        rows.write.mode("overwrite").parquet(f"{sink}/batch={batch}")  # a batch that is run again replaces itself

    out.writeStream.foreachBatch(keep).option("checkpointLocation", new_path(spark, "stream-state")).outputMode("complete").trigger(availableNow=True).start().awaitTermination()
    got = spark.read.parquet(sink)
    last = got.agg(F.max("batch").alias("b"))
    return got.join(F.broadcast(last), got.batch == last.b).groupBy("contract").agg(F.sum("n").alias("n"))


@query("ss5_cache_settings", "SELECT * FROM (VALUES (1, false), (2, true), (3, false), (4, false), (5, true), (6, false)) t(id, hit)")
def _(spark, d):
    """Requests of one key in one process; the third comes with other settings, the sixth with the first ones again."""
    log = spark.createDataFrame([(1, 10, 60.0, 0.0), (2, 10, 60.0, 5.0), (3, 20, 60.0, 6.0), (4, 20, 90.0, 7.0), (5, 20, 90.0, 97.0), (6, 10, 60.0, 98.0)], "id int, capacity int, ttl double, t double").coalesce(1)

    def run(batches):  # noqa: ANN001, ANN202
        for b in batches:
            hits = []
            for r in b.to_pylist():
                cache = S.current_cache(r["capacity"], r["ttl"])
                hits.append(cache.get("page", r["t"]) is not None)
                if not hits[-1]:
                    cache.put("page", True, r["t"])
            yield pa.RecordBatch.from_arrays([b.column("id"), pa.array(hits)], names=["id", "hit"])

    return log.sortWithinPartitions("id").mapInArrow(run, "id int, hit boolean")


# Brand.
@query("br5_logo_colour", "SELECT p_partkey AS page_id, CASE WHEN p_partkey % 3 = 2 THEN '#00aa00' ELSE '#1155cc' END AS hex FROM part WHERE p_partkey % 3 > 0")
def _(spark, d):
    """Best logo grey: the second one's colour counts; some pages have grey logos alone."""
    k = F.col("p_partkey")
    drawing = lambda c: say("data:image/svg+xml;utf8,%3Csvg%3E%3Cpath%20fill%3D%22%23", c, "%22%2F%3E%3C%2Fsvg%3E")
    second = F.when(k % 3 == 1, drawing("1155cc")).when(k % 3 == 2, "https://f.example/green.svg").otherwise(drawing("999999"))
    logos = F.array(F.struct(F.lit(1).alias("rank"), drawing("808080").alias("url")), F.struct(F.lit(2).alias("rank"), second.alias("url")), F.struct(F.lit(4).alias("rank"), drawing("ff0000").alias("url")))
    ranked = table(spark, d, "part").select(k.alias("page_id"), F.explode(logos).alias("l")).select("page_id", "l.*")
    files = spark.createDataFrame([("https://f.example/green.svg", "<svg><rect fill='#00AA00'/></svg>")], "url string, content string")
    return B.logo_colours(ranked, files)
