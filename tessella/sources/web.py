"""Sources: fetcher and search interfaces, search results, sitemaps, PDF and DOCX files."""

from __future__ import annotations

import io
import ipaddress
import re
import zipfile
import zlib
from collections.abc import Callable, Iterator
from typing import Protocol
from urllib.parse import urljoin, urlsplit
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessella.functions.errors import any_of
from tessella.schema import PDF, S, struct

# An address in a sitemap, a result in a search page, and hosts that are no results.
LOC = r"(?i)<loc>\s*(https?://[^<]+?)\s*</loc>"
RESULT = r"href=\"/url\?q=(https?://[^&\"]+)"
OWN_HOSTS = ("google.com", "youtube.com/redirect")
TEXT_CAP = 100_000


class PageFetcher(Protocol):
    """SRC5, SRC6: gives a page's HTML, status and headers. Called on executors; rendering and browser actions are its own matter."""

    def fetch(self, url: str, options: dict) -> dict: ...


class SearchProvider(Protocol):
    """SRC3: the JSON text or HTML of a search's answer."""

    def search(self, query: str, limit: int) -> str: ...


#: Redirects followed, and tries of a failed request: fixed values.
HOPS, TRIES = 5, 3
FETCHED = "url string, finalUrl string, statusCode int, html string, headers map<string,string>, error string, attempts int, hops int"


def fetch_one(fetcher: PageFetcher, resolve_host: Callable[[str], list[str]], url: str, options: dict, tries: int = TRIES) -> dict:
    """SRC5, SS4, PR7: one page. Each hop's host and every address it resolves to must be public; redirects are followed by hand.

    The fetcher gives status, headers and html, or raises. A failure, 429 and 5xx are tried again.
    """
    row = {"url": url, "finalUrl": url, "statusCode": None, "html": None, "headers": {}, "error": None, "attempts": 0, "hops": 0}
    at = url
    while True:
        name = urlsplit(at).hostname or ""
        if urlsplit(at).scheme not in ("http", "https") or not name or private_host(name) or any(private_host(a) for a in resolve_host(name)):
            return row | {"error": f"blocked address: {at}"}
        got, why = None, None
        for _ in range(tries):
            row["attempts"] += 1
            try:
                got, why = fetcher.fetch(at, options), None
            except Exception as e:
                why = str(e) or type(e).__name__
                continue
            if got["status"] != 429 and got["status"] < 500:
                break
        if got is None or why:
            return row | {"error": why}
        headers = {k.lower(): v for k, v in got.get("headers", {}).items()}
        row |= {"finalUrl": at, "statusCode": got["status"], "headers": headers, "html": got.get("html")}
        if got["status"] not in (301, 302, 303, 307, 308) or not headers.get("location"):
            return row | {"error": f"HTTP {got['status']}" if got["status"] >= 400 else None}
        row["hops"] += 1
        if row["hops"] > HOPS:
            return row | {"error": "too many redirects"}
        at = urljoin(at, headers["location"])


def private_host(name: str) -> bool:
    """PR5, PR6 for one host or address, on an executor."""
    n = name.strip("[]").rstrip(".").lower()
    try:
        a = ipaddress.ip_address(n)
    except ValueError:
        return n in ("", "localhost", "metadata", "metadata.google.internal") or n.endswith((".localhost", ".internal", ".local", ".lan"))
    a = getattr(a, "ipv4_mapped", None) or a
    return not a.is_global or a.is_multicast


def fetched(urls: DataFrame, fetcher: PageFetcher, resolve_host: Callable[[str], list[str]], options: dict | None = None, tries: int = TRIES) -> DataFrame:
    """SRC5: a row for each url: what came back, or why nothing did. Calls run in partitions: their number bounds what runs at once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = (pa.string(), pa.string(), pa.int32(), pa.string(), pa.map_(pa.string(), pa.string()), pa.string(), pa.int32(), pa.int32())
        names = ["url", "finalUrl", "statusCode", "html", "headers", "error", "attempts", "hops"]
        for b in batches:
            for s in range(0, len(b), 100):
                rows = [fetch_one(fetcher, resolve_host, u, options or {}, tries) for u in b.column("url")[s : s + 100].to_pylist()]
                cols = [[list(r[n].items()) if n == "headers" else r[n] for r in rows] for n in names]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=names)

    return urls.filter("url IS NOT NULL").select("url").mapInArrow(run, FETCHED)


def asked_results(limit: int) -> int:
    """Results asked of a provider: two more than wanted, twenty at most."""
    return min(limit + 2, 20)


def json_results(response: Column, limit: int) -> Column:
    """SRC3: the first http(s) links of a provider's answer; an answer that is no JSON has none."""
    organic = F.from_json(response, "struct<organic:array<struct<link:string>>>")["organic"]
    links = F.filter(F.transform(organic, lambda x: x["link"]), lambda u: u.rlike("(?i)^https?://"))
    return F.slice(F.coalesce(links, F.array().cast("array<string>")), 1, limit)


def html_results(page: Column, limit: int) -> Column:
    """SRC3: distinct links of a results page, without the search host's own."""
    links = F.transform(F.regexp_extract_all(page, F.lit(RESULT), F.lit(1)), lambda u: F.coalesce(F.try_url_decode(u), u))
    links = F.filter(links, lambda u: ~any_of(u, OWN_HOSTS))
    return F.slice(F.array_distinct(links), 1, limit)


def sitemap_urls(xml: Column) -> Column:
    """SRC4: the addresses of one sitemap in order, not decoded."""
    return F.transform(F.regexp_extract_all(xml, F.lit(LOC), F.lit(1)), lambda u: F.trim(u))


def expand_sitemaps(maps: DataFrame, roots: DataFrame | None = None, most: int | None = None) -> DataFrame:
    """SRC4, J3: root, pos, url: the addresses of each root sitemap (url, xml).

    An index gives those of its children that end with .xml or have "sitemap" in their address, one
    level down; its own entries and children that aren't there count for nothing.
    """
    roots = roots or maps
    own = roots.select(F.col("url").alias("root"), F.posexplode(sitemap_urls(F.col("xml"))).alias("i", "u"), F.col("xml").contains("<sitemapindex").alias("is_index"))
    plain = own.filter(~F.col("is_index")).select("root", F.array("i", F.lit(0)).alias("at"), F.col("u").alias("url"))
    child = own.filter("is_index").filter(F.col("u").endswith(".xml") | F.col("u").contains("sitemap"))
    below = child.join(maps.select(F.col("url").alias("u"), "xml"), "u").select("root", "i", F.posexplode(sitemap_urls(F.col("xml"))).alias("j", "url"))
    df = plain.union(below.select("root", F.array("i", "j").alias("at"), "url"))
    per = df.groupBy("root").agg(F.array_sort(F.collect_list(F.struct("at", "url"))).alias("x"))
    urls = F.transform("x", lambda r: r["url"])
    return per.select("root", F.posexplode(F.slice(urls, 1, most) if most else urls).alias("pos", "url"))


#: Escapes in a string of a page's content.
ESCAPES = {"n": "\n", "r": "\r", "t": "\t", "b": "\b", "f": "\f", "\n": ""}
_LEXEME = re.compile(r"[()\[\]]|%[^\r\n]*|<[^<>]*>|[^\s()\[\]<>%]+")


def _literal(raw: str, at: int) -> tuple[str, int]:
    """The string whose bracket is before ``at``, with balanced brackets inside, and where it ends."""
    out, depth, n = [], 1, len(raw)
    while at < n:
        c = raw[at]
        at += 1
        if c == "\\" and at < n:
            octal = re.compile("[0-7]{1,3}").match(raw, at)
            out.append(chr(int(octal[0], 8) & 255) if octal else ESCAPES.get(raw[at], raw[at]))
            at = octal.end() if octal else at + 1
            continue
        depth += (c == "(") - (c == ")")
        if not depth:
            break
        out.append(c)
    return "".join(out), at


def shown_strings(raw: str) -> Iterator[tuple[str, str]]:
    """("text" or "array", string) for each operator that shows text, in order."""
    held: list[str] = []
    array: list[str] | None = None
    at = 0
    while m := _LEXEME.search(raw, at):
        word, at = m[0], m.end()
        if word == "(":
            text, at = _literal(raw, at)
            (held if array is None else array).append(text)
        elif word == "[":
            array = []
        elif word == "]" and array is not None:
            held, array = ["".join(array)], None
            shown = _LEXEME.search(raw, at)
            if shown and shown[0] == "TJ" and held[0]:
                yield "array", held[0]
            held = []
        elif array is None:
            if word in ("Tj", "TJ", "'") and held:
                yield "text", held[-1]
            held = []


def lenient_pdf_text(data: bytes) -> str:
    """SRC9: what text shows in uncompressed streams of a broken PDF; arrays of strings count only where nothing else shows."""
    found = list(shown_strings(data.decode("latin-1")))
    plain = [t for kind, t in found if kind == "text" and t.strip()] or [t for kind, t in found if kind == "array"]
    lines = (" ".join(x.replace("\t", " ").split(" ")).strip() for x in " ".join(plain).splitlines())
    return "\n".join(x for x in (re.sub(" +", " ", line) for line in lines) if x)


def _inflated(data: bytes) -> bytes:
    """The file with its Flate streams unpacked."""
    out = [data]
    for m in re.finditer(rb"stream\r?\n(.*?)\r?\nendstream", data, re.S):
        try:
            out.append(zlib.decompressobj().decompress(m[1], 50_000_000))
        except zlib.error:
            continue
    return b"\n".join(out)


def read_pdf(data: bytes | None) -> dict | None:
    """SRC8: text, pages and metadata of a PDF with simple fonts; None for what isn't one."""
    if not data or b"%PDF" not in data[:1024]:
        return None
    full = _inflated(data)
    meta = {k.decode(): _literal(v.decode("latin-1") + ")", 0)[0] for k, v in re.findall(rb"/(Title|Author|Subject|Keywords|Creator|Producer)\s*\(((?:\\.|[^\\()])*)\)", full)}
    return {"text": lenient_pdf_text(full)[:TEXT_CAP], "pages": len(re.findall(rb"/Type\s*/Page(?![a-zA-Z])", full)), "metadata": list(meta.items())}


_W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"


def read_docx(data: bytes | None) -> dict | None:
    """SRC10: text and markdown of a DOCX; None for what isn't one."""
    try:
        with zipfile.ZipFile(io.BytesIO(data or b"")) as z:
            root = ElementTree.fromstring(z.read("word/document.xml"))
    except (zipfile.BadZipFile, KeyError, ElementTree.ParseError):
        return None
    plain, marked = [], []
    for p in root.iter(f"{_W}p"):
        style = p.find(f"{_W}pPr/{_W}pStyle")
        runs = []
        for r in p.iter(f"{_W}r"):
            t = "".join(x.text or "" if x.tag == f"{_W}t" else "\t" if x.tag == f"{_W}tab" else "\n" if x.tag == f"{_W}br" else "" for x in r)
            bold = r.find(f"{_W}rPr/{_W}b") is not None
            runs.append((t, f"**{t}**" if bold and t.strip() else t))
        text, mark = "".join(a for a, _ in runs), "".join(b for _, b in runs)
        level = re.match(r"(?i)heading\s*([1-6])$", style.get(f"{_W}val", "")) if style is not None else None
        plain.append(text)
        if mark.strip():
            marked.append(f"{'#' * int(level[1])} {text}" if level else f"- {mark}" if p.find(f"{_W}pPr/{_W}numPr") is not None else mark)
    return {"text": "\n\n".join(plain).strip()[:TEXT_CAP], "markdown": "\n\n".join(marked)[:TEXT_CAP]}


@F.pandas_udf(PDF)
def pdf_column(data):  # noqa: ANN001, ANN201
    """SRC8 over a binaryFile column."""
    import pandas as pd

    rows = [read_pdf(bytes(d)) if d is not None else None for d in data]
    made = [{"text": r["text"], "pages": r["pages"], "metadata": dict(r["metadata"])} if r else {"text": None, "pages": None, "metadata": None} for r in rows]
    return pd.DataFrame(made, columns=["text", "pages", "metadata"])


DOCX = struct(text=S, markdown=S)


@F.pandas_udf(DOCX)
def docx_column(data):  # noqa: ANN001, ANN201
    """SRC10 over a binaryFile column."""
    import pandas as pd

    rows = [read_docx(bytes(d)) if d is not None else None for d in data]
    return pd.DataFrame([r or {"text": None, "markdown": None} for r in rows], columns=["text", "markdown"])


def documents(spark, path: str, kind: str) -> DataFrame:
    """SRC8, SRC10: path and parsed content of the .pdf or .docx files under a folder; a document's markdown is its text where it has none of its own."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", f"*.{kind}").option("recursiveFileLookup", True).load(path)
    if kind == "pdf":
        df = files.select("path", pdf_column("content").alias("pdf"))
        return df.select("path", "pdf", F.col("pdf.text").alias("markdown"), F.nullif(F.try_element_at("pdf.metadata", F.lit("Title")), F.lit("")).alias("title"))
    return files.select("path", docx_column("content").alias("d")).select("path", "d.text", "d.markdown")


def provided(html: Column, markdown: Column) -> Column:
    """SRC11: given content, Markdown first; blanks are none."""
    return F.coalesce(*(F.when(F.regexp_replace(c, r"(?U)\s+", "") != "", c) for c in (markdown, html)))
