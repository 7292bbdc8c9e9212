"""The pure functions under SQL names, and table functions for chunks and links."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from tessella.functions.text import chunk_text
from tessella.functions.urls import resolve
from tessella.schema import CrawlOptions


@F.udtf(returnType="index int, text string, section string, char_count int, hash string", useArrow=True)
class Chunks:
    def eval(self, text: str, size: int, overlap: int) -> Iterator[tuple]:
        for c in chunk_text(text, size, overlap):
            yield c["index"], c["text"], c["section"], c["charCount"], c["hash"]


@F.udtf(returnType="pos int, href string, text string, is_external boolean, rel string", useArrow=False)
class Links:
    def eval(self, html: str, url: str) -> Iterator[tuple]:
        from tessella.operators.parse import parse_page

        for i, x in enumerate(parse_page(html, url, ("links",), CrawlOptions())["links"]):
            yield i, x["href"], x["text"], x["isExternal"], x["rel"]


def register(spark: SparkSession) -> None:
    """page_chunks(text, size, overlap), page_links(html, url), url_resolve(href, base), text_normalise(t), is_grounded(value, text), html_markdown(html)."""
    import pandas as pd

    from tessella.functions.markdown import html_to_markdown
    from tessella.operators.ground import grounded_text, normalised

    @F.pandas_udf("string")
    def url_resolve(href, base):  # noqa: ANN001, ANN202
        return pd.Series([None if h is None or b is None else resolve(h, b) for h, b in zip(href, base, strict=True)], dtype=object)

    @F.pandas_udf("string")
    def html_markdown(html):  # noqa: ANN001, ANN202
        return html.map(lambda h: None if h is None else html_to_markdown(h))

    spark.udtf.register("page_chunks", Chunks)
    spark.udtf.register("page_links", Links)
    for name, f in (("url_resolve", url_resolve), ("html_markdown", html_markdown), ("text_normalise", normalised), ("is_grounded", grounded_text)):
        spark.udf.register(name, f)
