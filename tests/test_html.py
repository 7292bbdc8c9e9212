"""The HTML reader, selectors, Markdown and the parse step on hand-written pages."""

import pytest

from tessella.functions.html import parse, selector_of, tokens
from tessella.functions.markdown import html_to_markdown
from tessella.operators.parse import json_ld_logos, parse_page, safe_svg
from tessella.schema import PARSED_FIELDS, CrawlOptions

PAGE = """<!doctype html><html lang="en"><head><title>A &amp; B</title><link rel=canonical href="/c"><meta name="theme-color" content="#123"></head>
<body><nav>menu</nav><main><h1>Head</h1><p class="keep">Kept <b>text</b></p><p class="drop">Gone</p></main><footer>foot</footer></body></html>"""


def get(html, *fields, **options):
    p = parse_page(html, "https://x.example/dir/page", fields, CrawlOptions(**options))
    return p[fields[0]] if len(fields) == 1 else p


def test_raw_text_hides_tags():
    assert get('<body><script>var a="</p><b>"</script>x<style>p{}</style>y<!-- <b>z</b> --></body>', "text") == "xy"


def test_unclosed_input_is_read_to_its_end():
    assert get("<body><p>one<p>two <a href='x", "text") == "onetwo"
    assert get("<p>tail", "text") == "tail"
    assert get(None, "text") == "" and get("", "title") is None


def test_references_are_decoded_once():
    assert get("<body>&amp;amp; &copy; &#x41;</body>", "text") == "&amp; © A"


def test_titles_are_joined():
    assert get("<title>One</title><body><svg><title>Two</title></svg></body>", "title") == "OneTwo"


def test_content_controls():
    assert get(PAGE, "text") == "menu HeadKept textGone foot".replace(" H", "H").replace(" foot", "foot")
    assert get(PAGE, "text", onlyMainContent=True) == "HeadKept textGone"
    assert get(PAGE, "text", excludeTags=(".drop", "nav", "footer")) == "HeadKept text"
    assert get(PAGE, "text", includeTags=("h1",)) == "Head"
    assert get(PAGE, "text", excludeTags=("p[",)) == get(PAGE, "text")
    page = get(PAGE, "title", "canonicalUrl", "language", onlyMainContent=True)
    assert page == {"title": "A & B", "canonicalUrl": "/c", "language": "en"}


def test_without_main_boilerplate_goes():
    html = '<body><header>h</header><div class="sidebar">s</div><p>text</p><div id="cookie-notice">c</div></body>'
    assert get(html, "text", onlyMainContent=True) == "text"


def test_markdown():
    md = html_to_markdown('<h2>T</h2><p>a <em>b</em> <strong>c</strong> <a href="/u">d</a><a href="/e"></a></p><ul><li>x<li>y</ul><ol start=3><li>z</ol><pre><code class="language-js">f()\n</code></pre><blockquote><p>q</p></blockquote><hr><p>1 * 2</p>')
    assert md == "## T\n\na *b* **c** [d](/u)\n\n-   x\n-   y\n\n3.  z\n\n```js\nf()\n```\n\n> q\n\n* * *\n\n1 \\* 2"


def test_markdown_table():
    assert html_to_markdown("<table><tr><th>a<th>b<tr><td>1|2<td>3</table>") == "| a | b |\n| --- | --- |\n| 1\\|2 | 3 |"


def test_nested_tables_appear_again():
    t = get("<table><tr><td>a<table><tr><td>b</table></table>", "tables")
    assert [x["rows"] for x in t] == [[["ab", "b"], ["b"]], [["b"]]]


def test_forms():
    f = get('<form action="/s" method="post"><input name="a"><input type="email" name="b" required><select name="c"></select><textarea name="d"></textarea><input></form>', "forms")
    assert f == [{"action": "/s", "method": "POST", "fields": [{"name": "a", "type": "text", "required": False}, {"name": "b", "type": "email", "required": True}, {"name": "c", "type": "select", "required": False}, {"name": "d", "type": "textarea", "required": False}]}]


def test_lazy_images_and_links():
    p = get('<base href="/no"><img data-src="l.png" loading=lazy><img><a href="?q=1" rel=nofollow> t </a><a href="mailto:a@b"></a><a href="//other.example/é">e</a>', "images", "links")
    assert p["images"] == [{"src": "https://x.example/dir/l.png", "alt": "", "width": None, "height": None, "dataSrc": "https://x.example/dir/l.png", "loading": "lazy"}]
    assert [(x["href"], x["text"], x["isExternal"], x["rel"]) for x in p["links"]] == [("https://x.example/dir/page?q=1", "t", False, "nofollow"), ("https://other.example/%C3%A9", "e", True, None)]


def test_microdata_parents_hold_nested_properties():
    m = get('<div itemscope itemtype="T"><b itemprop="n">1</b><div itemscope><i itemprop="n" content="2">x</i></div></div>', "microdata")
    assert m == [{"type": "T", "properties": [("n", "2")]}, {"type": "", "properties": [("n", "2")]}]


def test_bad_json_ld_is_skipped():
    assert get('<script type="application/ld+json">{bad</script><script type="application/ld+json">[{"a":1}]</script>', "structuredData") == ['[{"a": 1}]']


def test_every_field_of_an_empty_page():
    p = parse_page("", "", tuple(PARSED_FIELDS), CrawlOptions(chunkSize=10, cssSelector="p"))
    assert p["links"] == [] and p["selectedContent"] is None and p["markdown"] == ""


@pytest.mark.parametrize(("selector", "n"), [("p", 2), (".keep", 1), ("main > p", None), ("nav, footer", 2), ('p[class*="ee"]', 1), ("p:not(.keep)", 1), ("body main h1", 1), ('[class="DROP" i]', 1), ("*", None)])
def test_selectors(selector, n):
    doc = parse(PAGE)
    if selector == "main > p":
        with pytest.raises(ValueError):
            doc.all(selector)
    else:
        assert n is None or len(doc.all(selector)) == n
    assert selector_of is not None


def test_logos():
    html = '<header><a href="/"><img src="/acme.png" alt="Acme"></a></header><link rel="icon" href="/i.ico"><link rel="apple-touch-icon" href="/t.png"><meta property="og:image" content="/o.jpg"><script type="application/ld+json">{"@graph":[{"publisher":{"logo":{"url":"/l.svg"}}}]}</script>'
    got = {x["source"]: (x["url"].rsplit("/", 1)[1], x["confidence"]) for x in get(html, "logoCandidates")}
    assert got == {"json-ld": ("l.svg", 0.9), "home-link-img": ("acme.png", 0.82), "icon": ("i.ico", 0.65), "apple-touch-icon": ("t.png", 0.7), "favicon-default": ("favicon.ico", 0.4), "og:image": ("o.jpg", 0.3)}
    assert json_ld_logos([{"logo": ["x"]}, {"logo": [{"url": "y"}]}]) == ["y"]


def test_svg_is_cleaned():
    s = safe_svg('<svg onload="x()"><script>bad()</script><use href="http://e/x"/><a xlink:href="#in" href="javascript:1"><path/></a></svg>')
    assert s == '<svg><a xlink:href="#in"><path></path></a></svg>'
    assert safe_svg("<div/>") is None and safe_svg("<svg>" + "x" * 25_000 + "</svg>") is None


def test_long_input_is_linear():
    assert len(list(tokens("<" * 50_000))) >= 1
    assert get("<p>" * 20_000 + "x", "text") == "x"
