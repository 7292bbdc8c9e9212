"""Page columns that are plain expressions: from the HTML text, or from parsed fields."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessella.functions import errors
from tessella.functions.text import collapse
from tessella.functions.urls import SOCIAL_DOMAINS, host
from tessella.schema import CAPS, PAGE_FIELDS

# Patterns of mail addresses and phone numbers in a page's source.
EMAIL = r"[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}"
PHONE = r"(?:\+?\d{1,3}[-.\s]?)?\(?\d{2,4}\)?[-.\s]?\d{3,4}[-.\s]?\d{3,4}"
# Trackers in order of report, with what tells them.
TRACKERS = (
    ("Google Analytics (GA4)", r"gtag\(|google-analytics\.com/g/|googletagmanager\.com.*gtag"),
    ("Google Analytics (Universal)", r"google-analytics\.com/analytics\.js|ga\(\s*['\"]create"),
    ("Google Tag Manager", r"googletagmanager\.com/gtm\.js"),
    ("Facebook Pixel", r"connect\.facebook\.net/.*/fbevents\.js|fbq\(\s*['\"]init"),
    ("Hotjar", r"static\.hotjar\.com|hj\(\s*['\"]init"),
    ("Segment", r"cdn\.segment\.com/analytics\.js"),
    ("Mixpanel", r"cdn\.mxpnl\.com|mixpanel\.init"),
    ("Amplitude", r"cdn\.amplitude\.com|amplitude\.getInstance"),
    ("Heap", r"heap-\d+\.js|heap\.load"),
    ("Plausible", r"plausible\.io/js"),
    ("Matomo", r"matomo\.js|piwik\.js"),
    ("Microsoft Clarity", r"clarity\.ms/tag"),
    ("LinkedIn Insight", r"snap\.licdn\.com/li\.lms-analytics"),
    ("Twitter Pixel", r"static\.ads-twitter\.com/uwt\.js"),
    ("Pinterest Tag", r"pintrk\(|s\.pinimg\.com/ct/core\.js"),
    ("TikTok Pixel", r"analytics\.tiktok\.com"),
)


def all_matches(c: Column, pattern: str) -> Column:
    return F.regexp_extract_all(c, F.lit(pattern), F.lit(0))


def title(html: Column) -> Column:
    """EX1, fast path: the first title's text, for pages with one title and plain text in it."""
    return F.nullif(F.trim(F.regexp_extract(html, r"(?is)<title[^>]*>(.*?)</title>", 1)), F.lit(""))


def language(html: Column) -> Column:
    """EX2, fast path."""
    return F.nullif(F.regexp_extract(html, r"""(?i)<html[^>]*\blang=["']?([^"'\s>]+)""", 1), F.lit(""))


def raw_html(html: Column) -> Column:
    """EX13."""
    return F.substring(html, 1, CAPS["rawHtml"])


def page_size(html: Column) -> Column:
    """EX14."""
    return F.octet_length(html)


def emails(html: Column) -> Column:
    """EX20."""
    return F.slice(F.array_distinct(all_matches(html, EMAIL)), 1, CAPS["emails"])


def phones(html: Column) -> Column:
    """EX21."""
    found = F.filter(all_matches(html, PHONE), lambda p: F.length(F.regexp_replace(p, r"\D", "")) >= 7)
    return F.slice(F.array_distinct(found), 1, CAPS["phones"])


def trackers(html: Column) -> Column:
    """EX27: names of the trackers in a page's source, in the fixed order."""
    return F.array_compact(F.array(*(F.when(html.rlike("(?i)" + p), F.lit(n)) for n, p in TRACKERS)))


def without_scripts(html: Column) -> Column:
    """The source as it is once the text was taken: scripts, styles and noscript parts are gone."""
    return F.regexp_replace(html, r"(?is)<(script|style|noscript)\b.*?</\1\s*>", "")


def robots(meta: Column, header: Column) -> Column:
    """EX4: the meta tag's and the response header's directives."""
    return F.nullif(F.concat_ws(", ", F.nullif(meta, F.lit("")), F.nullif(header, F.lit(""))), F.lit(""))


def prefixed(meta: Column, prefix: str) -> Column:
    """EX5: the entries under a prefix, without it."""
    return F.transform_keys(F.map_filter(meta, lambda k, v: k.startswith(prefix)), lambda k, v: F.substring(k, len(prefix) + 1, 1_000_000))


def description(meta: Column) -> Column:
    """EX6."""
    return F.coalesce(F.nullif(F.try_element_at(meta, F.lit("description")), F.lit("")), F.nullif(F.try_element_at(meta, F.lit("og:description")), F.lit("")))


def social_links(links: Column) -> Column:
    """EX17: links whose host has a social domain anywhere in it."""
    def social(link: Column) -> Column:
        name = F.regexp_replace(host(link.href), r"^(.*?)www\.", "$1")
        return errors.any_of(F.coalesce(name, F.lit("")), SOCIAL_DOMAINS)

    return F.array_distinct(F.transform(F.filter(links, social), lambda x: x.href))


def _text(v: Column, path: str) -> Column:
    return F.try_variant_get(v, path, "string")


def _given(v: Column, path: str) -> Column:
    return F.nullif(_text(v, path), F.lit(""))


def commerce(structured: Column) -> Column:
    """EX25: products among the top-level JSON-LD values, read as variants."""
    values = F.transform(structured, lambda s: F.try_parse_json(s))

    def product(v: Column) -> Column:
        many = F.try_variant_get(v, "$['@type']", "array<string>")
        return F.coalesce(_text(v, "$['@type']") == "Product", F.lit(False)) | F.coalesce(F.array_contains(many, "Product"), F.lit(False))

    def record(v: Column) -> Column:
        def offer(name: str) -> Column:
            at = [f"$.{w}{i}.{name}" for w in ("offers", "offer") for i in ("[0]", "")]
            return F.coalesce(*(_text(v, p) for p in at))

        def offer_given(name: str) -> Column:
            return F.nullif(offer(name), F.lit(""))

        brand = F.coalesce(_given(v, "$.brand.name"), F.when(F.schema_of_variant(F.try_variant_get(v, "$.brand", "variant")) == "STRING", _given(v, "$.brand")))
        return F.struct(
            _given(v, "$.name").alias("name"), F.coalesce(offer("price"), offer("lowPrice")).alias("price"), offer_given("priceCurrency").alias("currency"),
            offer_given("availability").alias("availability"), _text(v, "$.aggregateRating.ratingValue").alias("rating"), _text(v, "$.aggregateRating.reviewCount").alias("reviewCount"),
            brand.alias("brand"), _given(v, "$.sku").alias("sku"),
        )

    return F.transform(F.filter(values, product), record)


def compact_text(title: Column, description: Column, markdown: Column, text: Column, headings: Column) -> Column:
    """ST8: all texts of a page in one line."""
    parts = [F.nullif(c, F.lit("")) for c in (title, description, markdown, text, F.array_join(F.transform(headings, lambda h: h.text), " "))]
    return collapse(F.concat_ws(" ", *parts))


def redirects(asked: Column, loaded: Column) -> Column:
    """EX30: one hop if the page came from another address than the one asked for."""
    hop = F.array(F.struct(asked.alias("url"), F.lit(301).alias("statusCode")))
    return F.when(loaded.isNotNull() & (loaded != asked), hop).otherwise(F.array().cast("array<struct<url:string,statusCode:int>>"))


def default(name: str) -> Column:
    """EX32: the value of a field that wasn't computed."""
    kind = PAGE_FIELDS[name]
    fixed = {"status": F.lit("error"), "errorRetryable": F.lit(False), "fromCache": F.lit(False), "engine": F.lit("static"), "usedPlaywright": F.lit(False), "statusCode": F.lit(0)}
    if name in fixed:
        return fixed[name].cast(kind)
    if name == "chunks":
        return F.lit(None).cast(kind)
    if kind.typeName() == "array":
        return F.array().cast(kind)
    if kind.typeName() == "map":
        return F.create_map().cast(kind)
    return F.lit(None).cast(kind)


def full_record(df: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """Every field of the page record, behind ``keys``: what ``df`` has, the defaults of the rest."""
    return df.select(*keys, *(F.col(n).cast(t).alias(n) if n in df.columns else default(n).alias(n) for n, t in PAGE_FIELDS.items()))


# Formats a scrape may ask for, the fields that each adds, and those that any has.
FORMATS = {
    "markdown": ("markdown",), "text": ("text",), "html": ("html",), "rawHtml": ("rawHtml",),
    "metadata": ("title", "description", "language", "canonicalUrl", "robotsDirectives", "meta", "openGraph", "twitterCard", "headings", "hreflangTags", "paginationLinks", "redirectChain"),
    "links": ("links",), "images": ("images",), "structuredData": ("structuredData",), "commerceData": ("commerceData",), "tables": ("tables",), "forms": ("forms",),
    "analytics": ("analyticsDetected",), "emails": ("emails",), "phones": ("phones",), "socialLinks": ("socialLinks",), "chunks": ("chunks",),
}
ALWAYS = ("url", "status", "statusCode", "contentType", "responseTimeMs", "scrapedAt")


def scrape_formats(df: DataFrame, formats: list[str] | None = None) -> DataFrame:
    """EX33: the fixed fields and those of the formats asked for; unknown names are an error that lists them (SO4)."""
    if formats is not None and (not isinstance(formats, list) or not all(isinstance(f, str) for f in formats)):
        raise TypeError("formats is a list of names")
    asked = formats or ["markdown", "metadata"]
    unknown = [f for f in asked if f not in FORMATS]
    if unknown:
        raise ValueError(f"unknown formats: {', '.join(unknown)}")
    names = [*ALWAYS, *dict.fromkeys(n for f in asked for n in FORMATS[f])]
    return df.select(*names)
