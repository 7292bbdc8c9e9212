"""Pure functions: chunks, grounding, schemas, JSON repair, colours, sources, cache, discovery merge."""

import io
import json
import zipfile
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tessella.functions import colours as K
from tessella.functions.text import chunk_text
from tessella.functions.urls import resolve
from tessella.operators import contracts as CT
from tessella.operators import discover as FD
from tessella.operators.brand import css_variables, png_pixels
from tessella.operators.brand import organisation as brand_organisation
from tessella.operators.extract import ExtractOptions, LlmError, ask, extract_one, parsed, repaired
from tessella.operators.ground import Source, ground, grounded
from tessella.sources.web import lenient_pdf_text, read_docx, read_pdf
from tessella.streaming.pages import LruCache


def test_chunks():
    md = "intro\n# One\naaaa\n## Two\nbbbb\n"
    c = chunk_text(md, 14, 0)
    assert [x["text"] for x in c] == ["intro", "# One\naaaa", "## Two\nbbbb"]
    assert [x["section"] for x in c] == ["One", "Two", "Two"]  # a chunk carries the heading that didn't fit
    assert [x["index"] for x in c] == [0, 1, 2]
    assert chunk_text(md, 14, 3)[1]["text"] == "ro\n# One\naaaa"
    assert chunk_text("", 10) == [] and chunk_text("x", 0) == [] and chunk_text("  \n", 5) == []
    assert len(chunk_text("# A\n" + "x" * 500, 100)) == 1


@given(st.text(alphabet="# ab\n", max_size=80), st.integers(1, 30))
@settings(max_examples=200, deadline=None)
def test_chunks_cover_the_text(text, size):
    got = "".join(c["text"] for c in chunk_text(text, size, 0))
    assert "".join(got.split()) == "".join(text.split())


@pytest.mark.parametrize(("href", "want"), [
    ("x", "https://e.com/a/x"), ("/x y", "https://e.com/x%20y"), ("../z", "https://e.com/z"), ("?q", "https://e.com/a/b?q"), ("#f", "https://e.com/a/b#f"), ("HTTP://E.com:80/", "http://e.com/"),
    ("//o.com", "https://o.com/"), ("mailto:a@b", "mailto:a@b"), ("http://", None), ("http://[bad", None), ("", "https://e.com/a/b"), ("é", "https://e.com/a/%C3%A9"),
])
def test_resolve(href, want):
    assert resolve(href, "https://e.com/a/b") == want


def test_grounding():
    s = Source.of("Price 1,234.50 in Café Münster; call 12 34. The quick brown fox jumps over it.")
    assert grounded("cafe munster", s) and grounded(1234.5 and 12, s) and grounded("", s)
    assert not grounded("1234", s) and not grounded(99, s) and not grounded("Berlin", s)
    assert grounded("quick foxes: brown fox jumps over", s)
    value, nulled = ground({"a": ["fox", "cat"], "b": True, "c": {"d": 7}, "__proto__": 1}, s)
    assert value == {"a": ["fox", None], "b": True, "c": {"d": None}} and nulled == ["a[1]", "c.d"]


@given(st.recursive(st.none() | st.booleans() | st.integers() | st.text(max_size=8), lambda x: st.lists(x, max_size=3) | st.dictionaries(st.text(max_size=3), x, max_size=3), max_leaves=10))
@settings(max_examples=150, deadline=None)
def test_grounding_adds_nothing_and_absent_is_idempotent(value):
    got, _ = ground(value, Source.of("some text"))
    flat = json.dumps(got)
    assert ground(got, Source.of("some text"))[0] == json.loads(flat)
    once = CT.without_absent(value)
    assert CT.without_absent(once) == once


def test_absent_values():
    assert CT.without_absent({"a": " N/A ", "b": ["none", "null"], "c": "Na"}) == {"a": None, "b": ["none", None], "c": "Na"}
    deep = "null"
    for _ in range(200):
        deep = [deep]
    assert CT.without_absent(deep) is not None


def test_nullable_schema():
    schema = {"type": "object", "properties": {"a": {"type": "string"}, "e": {"type": "string", "enum": ["x"]}, "l": {"type": "array", "items": {"type": "object", "properties": {"n": {"type": "number"}}}}}, "$defs": {"d": {"type": "integer"}}}
    before = json.dumps(schema)
    out = CT.nullable_schema(schema)
    assert out["properties"]["a"]["type"] == ["string", "null"] and out["properties"]["e"] == {"type": "string", "enum": ["x"]}
    assert out["properties"]["l"]["items"]["properties"]["n"]["type"] == ["number", "null"] and out["$defs"]["d"]["type"] == ["integer", "null"]
    assert json.dumps(schema) == before and CT.nullable_schema(out) == out


def test_schema_translation():
    for c in CT.CONTRACTS.values():
        assert CT.spark_type(CT.json_schema(c.schema)).simpleString() == c.schema.simpleString()
    assert CT.names() == ["brand-context", "docs-page", "product-page", "real-estate-listing"]
    with pytest.raises(ValueError, match="docs-page"):
        CT.contract("x")


@pytest.mark.parametrize(("text", "want"), [('{"a": [1, 2', {"a": [1, 2]}), ('{"a": "x', {"a": "x"}), ('{"a": 1, "b":', {"a": 1}), ('{"a": 1, "b', {"a": 1}), ('{"a": {"b": [true, {"c": "x\\\\', {"a": {"b": [True, {"c": "x\\"}]}}), ('{"a": tru', None), ("", None), ('{"a": 1, ', {"a": 1}), ('[{"a": 1},', [{"a": 1}]), ("nope", None)])
def test_json_repair(text, want):
    assert repaired(text) == want


def test_answers():
    assert parsed('```json\n{"a": 1}\n```') == {"a": 1} and parsed("3") == 3 and parsed('{"a": [1') == {"a": [1]}


class Fake:
    def __init__(self, *answers):
        self.answers, self.calls = list(answers), []

    def complete(self, system, user, response_format):
        self.calls.append((len(user), response_format["type"]))
        a = self.answers.pop(0)
        if isinstance(a, Exception):
            raise a
        return a


def test_extraction_rows():
    ok = extract_one(Fake('{"title": "fox", "n": "N/A", "x": "invented"}'), "the fox", "u", ExtractOptions(ground=True))
    assert ok["status"] == "success" and json.loads(ok["data"]) == {"title": "fox", "n": None, "x": None} and ok["nulledFields"] == ["x"]
    assert extract_one(Fake(), "  ", "u", ExtractOptions())["errorType"] == "no-page-content"
    assert extract_one(Fake(" "), "c", "u", ExtractOptions())["errorType"] == "llm-empty-response"
    assert extract_one(Fake("sorry"), "c", "u", ExtractOptions())["errorType"] == "json-parse-error"
    assert extract_one(Fake(LlmError("HTTP 500 ", 500)), "c", "u", ExtractOptions())["errorType"] == "llm-http-error"


def test_format_fallback_and_overflow():
    f = Fake(LlmError("HTTP 400: response_format not supported", 400), "{}")
    ask(f, "c", "u", ExtractOptions(contract="docs-page"))
    assert [k for _, k in f.calls] == ["json_schema", "text"]
    f = Fake(LlmError("HTTP 400 maximum context length", 400), LlmError("HTTP 400 maximum context length", 400), "{}")
    _, sent = ask(f, "x" * 40_000, "u", ExtractOptions())
    assert len(sent) == 7_500 and len(f.calls) == 3


def test_css_variables():
    v = css_variables("--brand: var(--a); --a: var(--b, #111); --c: var(--none, red); --d: 1; --d: 2")
    assert v["--brand"] == "#111" and v["--c"] == "red" and v["--d"] == "2"
    assert css_variables("--a: var(--b); --b: var(--a)")


def test_organisation(spark):
    def organisation(texts):
        r = spark.createDataFrame([(texts,)], "t array<string>").select(brand_organisation(F.col("t")).alias("o")).first().o
        return r.asDict() if r else None

    ld = json.dumps([{"@type": "WebSite", "name": "S"}, {"@graph": [{"@type": ["Thing", "NewsOrganization"], "legalName": " L ", "image": [{"contentUrl": "i"}], "sameAs": "https://www.x.com/a"}]}])
    assert organisation([ld]) == {"name": "L", "description": None, "logo": "i", "socialLinks": ["https://www.x.com/a"]}
    assert organisation(['{"@type":"WebSite","name":"S"}'])["name"] == "S" and organisation(['{"@type":"Person"}']) is None and organisation([]) is None


def png(width, height, colour, rows, palette=None):
    import struct

    def chunk(kind, body):
        return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))

    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", width, height, 8, colour, 0, 0, 0)) + (chunk(b"PLTE", palette) if palette else b"") + chunk(b"IDAT", zlib.compress(rows)) + chunk(b"IEND", b"")


def test_png_pixels():
    rng = np.random.default_rng(1)
    for colour, n in ((2, 3), (6, 4), (0, 1), (4, 2)):
        px = rng.integers(0, 256, (7, 5, n))
        lines, above = b"", np.zeros((5, n), int)
        for y, row in enumerate(px):  # each row by another filter
            left = np.concatenate((np.zeros((1, n), int), row[:-1]))
            corner = np.concatenate((np.zeros((1, n), int), above[:-1]))
            guess = left + above - corner
            paeth = np.where((abs(guess - left) <= abs(guess - above)) & (abs(guess - left) <= abs(guess - corner)), left, np.where(abs(guess - above) <= abs(guess - corner), above, corner))
            by = (0 * row, left, above, (left + above) // 2, paeth)[y % 5]
            lines += bytes([y % 5]) + ((row - by) % 256).astype(np.uint8).tobytes()
            above = row
        got = png_pixels(png(5, 7, colour, lines))
        flat = px.reshape(-1, n)
        assert (got[:, :3] == (flat[:, :3] if n > 2 else flat[:, :1])).all() and (got[:, 3] == (flat[:, -1] if n in (2, 4) else 255)).all()
    assert png_pixels(png(2, 1, 3, b"\x00\x01\x00", b"\x01\x02\x03\x09\x08\x07")).tolist() == [[9, 8, 7, 255], [1, 2, 3, 255]]
    assert png_pixels(b"GIF89a") is None and png_pixels(None) is None and png_pixels(png(9, 9, 2, b"\0")) is None


def test_logo_colours(spark):
    from tessella.operators.brand import logo_colours

    red = png(2, 2, 2, (b"\0" + b"\xf0\x10\x10" * 2) * 2)
    grey = png(1, 1, 2, b"\0\x80\x80\x80")
    ranked = [(1, 1, "g.png"), (1, 2, "data:image/svg+xml;utf8,%3Csvg%3E%3Cpath%20fill%3D%22%231155cc%22%2F%3E%3C%2Fsvg%3E"), (1, 3, "r.png"), (2, 1, "r.png"), (3, 4, "r.png"), (4, 1, "gone.png"), (5, 1, "d.svg")]
    files = spark.createDataFrame([("g.png", grey), ("r.png", red), ("d.svg", b"<svg><rect fill='#00aa00'/></svg>")], "url string, content binary")
    got = {tuple(r) for r in logo_colours(spark.createDataFrame(ranked, "page_id long, rank int, url string"), files).collect()}
    assert got == {(1, "#1155cc"), (2, "#f01010"), (5, "#00aa00")}


def test_proposals_are_merged():
    base = {"fields": [{"name": "Unit price", "sample": "1", "source": "meta"}], "recordType": "single", "itemCount": None}
    got = FD.merge_proposed(base, {"fields": [{"name": "unit_price"}, {"name": "Colour", "sample": "Réd"}, {"name": "size", "sample": "9"}, {"name": "@x"}], "recordType": "listing", "itemCount": 3.7}, "it is RED")
    assert [(f["name"], f["sample"]) for f in got["fields"][1:]] == [("Colour", "Réd"), ("size", "")]
    assert got["recordType"] == "listing" and got["itemCount"] == 3
    assert FD.merge_proposed(base, None, "") == base


def test_lenient_pdf():
    assert lenient_pdf_text(rb"BT (Hello \(a\)) Tj (B\101) ' ET") == "Hello (a) BA"
    assert lenient_pdf_text(b"[(ab)-20(cd)] TJ") == "abcd" and lenient_pdf_text(b"") == ""


def test_pdf_and_docx():
    data = b"%PDF-1.4\n1 0 obj<</Type /Page>>stream\n" + zlib.compress(b"BT (Packed) Tj ET") + b"\nendstream\n/Title (T)"
    assert read_pdf(data) == {"text": "Packed", "pages": 1, "metadata": [("Title", "T")]}
    assert read_pdf(b"no") is None and read_docx(b"no") is None and read_docx(None) is None
    w = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
    body = f'<w:document {w}><w:body><w:p><w:pPr><w:pStyle w:val="Heading1"/></w:pPr><w:r><w:t>Head</w:t></w:r></w:p><w:p><w:r><w:rPr><w:b/></w:rPr><w:t>bold</w:t></w:r></w:p></w:body></w:document>'
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("word/document.xml", body)
    assert read_docx(out.getvalue()) == {"text": "Head\n\nbold", "markdown": "# Head\n\n**bold**"}


def test_lru_cache():
    c = LruCache(2, 10)
    c.put("a", 1, 0)
    c.put("b", 2, 1)
    assert c.get("a", 10) == 1  # still there at the exact end, and now used last
    c.put("c", 3, 2)
    assert c.get("b", 3) is None and c.get("a", 10.1) is None and c.get("c", 3) == 3


COLOURS = {
    "#abc": "#aabbcc", "#AABBCC80": "#aabbcc", "rgb(1, 2,3)": "#010203", "rgb(100% 0% 50% / .5)": "#ff0080", "rgba(1,2,3,0.05)": None, "hsl(120, 100%, 25%)": "#008000", "hsl(-60deg 100% 50%)": "#ff00ff", "Teal !important": "#008080",
    "transparent": None, "currentColor": None, "var(--x)": None, "linear-gradient(red, blue)": None, "#12": None, "": None,
}


def test_colours(spark):
    df = spark.createDataFrame(list(COLOURS.items()), "c string, want string")
    assert [r for r in df.select("c", "want", K.normalise(F.col("c")).alias("got")).collect() if r.want != r.got] == []
