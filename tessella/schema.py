"""The page record and the options that decide what is computed."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import types as T

S, I, D, B = T.StringType(), T.IntegerType(), T.DoubleType(), T.BooleanType()


def struct(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(k, v) for k, v in fields.items()])


STRINGS = T.ArrayType(S)
TEXT_MAP = T.MapType(S, S)
HEADING = struct(level=I, text=S)
LINK = struct(href=S, text=S, isExternal=B, rel=S)
IMAGE = struct(src=S, alt=S, width=S, height=S, dataSrc=S, loading=S)
TABLE = struct(headers=STRINGS, rows=T.ArrayType(STRINGS))
CHUNK = struct(text=S, index=I, section=S, charCount=I, hash=S)
MICRODATA = struct(type=S, properties=TEXT_MAP)
COMMERCE = struct(name=S, price=S, currency=S, availability=S, rating=S, reviewCount=S, brand=S, sku=S)
FORM_FIELD = struct(name=S, type=S, required=B)
FORM = struct(action=S, method=S, fields=T.ArrayType(FORM_FIELD))
LOGO = struct(url=S, source=S, type=S, confidence=D)
PALETTE = struct(hex=S, role=S, source=S, weight=D)
COLOUR_HIT = struct(value=S, source=S, weight=D)
ORGANISATION = struct(name=S, description=S, logo=S, socialLinks=STRINGS)
PDF = struct(text=S, pages=I, metadata=TEXT_MAP)

#: The record of a page: fields by group. structuredData holds JSON texts (parse_json makes variants of them).
PAGE_FIELDS: dict[str, T.DataType] = {
    "url": S, "canonicalUrl": S, "language": S, "title": S, "description": S, "robotsDirectives": S,
    "text": S, "headings": T.ArrayType(HEADING), "links": T.ArrayType(LINK), "images": T.ArrayType(IMAGE),
    "meta": TEXT_MAP, "openGraph": TEXT_MAP, "twitterCard": TEXT_MAP, "tables": T.ArrayType(TABLE), "structuredData": STRINGS,
    "emails": STRINGS, "phones": STRINGS, "socialLinks": STRINGS, "markdown": S, "chunks": T.ArrayType(CHUNK), "selectedContent": S,
    "statusCode": I, "contentType": S, "responseTimeMs": I, "pageSizeBytes": I, "responseHeaders": TEXT_MAP, "pdf": PDF, "screenshots": STRINGS,
    "redirectChain": T.ArrayType(struct(url=S, statusCode=I)), "hreflangTags": T.ArrayType(struct(lang=S, href=S)), "paginationLinks": T.ArrayType(struct(rel=S, href=S)),
    "microdata": T.ArrayType(MICRODATA), "commerceData": T.ArrayType(COMMERCE), "forms": T.ArrayType(FORM), "analyticsDetected": STRINGS,
    "scrapedAt": T.TimestampType(), "status": S, "error": S, "errorType": S, "errorRetryable": B, "fromCache": B, "engine": S, "usedPlaywright": B,
    "themeColor": S, "palette": T.ArrayType(PALETTE), "logo": T.ArrayType(LOGO), "brandOrg": ORGANISATION, "html": S, "rawHtml": S,
}
PAGE_SCHEMA = struct(**PAGE_FIELDS)

#: What the parse step can compute in its one pass, beyond the record's own fields.
PARSED_FIELDS: dict[str, T.DataType] = {k: PAGE_FIELDS[k] for k in (
    "canonicalUrl", "language", "title", "text", "markdown", "html", "selectedContent", "headings", "links", "images", "meta", "tables", "structuredData",
    "hreflangTags", "paginationLinks", "microdata", "forms", "chunks")} | {
    "robotsMeta": S, "css": S, "themeColorRaw": S, "manifestHref": S, "stylesheets": STRINGS, "logoCandidates": T.ArrayType(LOGO),
}

# Caps of the record.
CAPS = {"text": 50_000, "markdown": 100_000, "html": 200_000, "rawHtml": 500_000, "label": 200, "rows": 100, "emails": 50, "phones": 20, "microdata": 50, "property": 500, "forms": 20, "fields": 50, "follow": 50}


@dataclass(frozen=True)
class CrawlOptions:
    """Options of a run; only those a table of pages can answer are used, the rest go to a fetcher."""

    urls: tuple[str, ...] = ()
    searchQuery: str | None = None
    searchLimit: int = 10
    sitemapUrl: str | None = None
    extractText: bool = True
    extractLinks: bool = True
    extractImages: bool = True
    extractMeta: bool = True
    extractHeadings: bool = True
    extractTables: bool = True
    extractStructuredData: bool = True
    stripBoilerplate: bool = True
    extractEmails: bool = False
    extractPhones: bool = False
    extractBrand: bool = False
    extractMarkdown: bool = False
    extractHtml: bool = False
    extractRawHtml: bool = False
    onlyMainContent: bool = False
    includeTags: tuple[str, ...] = ()
    excludeTags: tuple[str, ...] = ()
    cssSelector: str | None = None
    chunkSize: int = 0
    chunkOverlap: int = 200
    maxDepth: int = 0
    maxPages: int = 100
    includeGlobs: tuple[str, ...] = ()
    excludeGlobs: tuple[str, ...] = ()
    adaptiveCrawling: bool = False
    waitForSelector: str | None = None
    waitForMs: int = 0
    customHeaders: dict[str, str] = field(default_factory=dict)
    requestRetries: int = 3
    requestTimeoutSecs: int = 30
    #: Where trackers, mail addresses and phone numbers are looked for: the page as it came, or what is left when the text was taken.
    scanScope: str = "raw"

    def parsed(self) -> tuple[str, ...]:
        """Fields of the parse step that these options need."""
        want = ["canonicalUrl", "language", "title", "robotsMeta", "hreflangTags", "paginationLinks", "microdata", "forms", "text"]
        for on, names in (
            (self.extractLinks, ("links",)), (self.extractImages, ("images",)), (self.extractMeta, ("meta",)), (self.extractHeadings, ("headings",)),
            (self.extractTables, ("tables",)), (self.extractStructuredData, ("structuredData",)), (self.extractMarkdown, ("markdown",)), (self.extractHtml, ("html",)),
            (self.cssSelector, ("selectedContent",)), (self.extractMarkdown and self.chunkSize > 0, ("chunks",)),
            (self.extractBrand, ("css", "themeColorRaw", "manifestHref", "stylesheets", "logoCandidates", "structuredData")),
        ):
            if on:
                want += [n for n in names if n not in want]
        return tuple(want)


#: Presets of the API surfaces.
PRESETS = {
    "crawl": CrawlOptions(),
    "markdown": CrawlOptions(extractMarkdown=True, extractText=False, extractLinks=False, extractImages=False, extractMeta=False, extractHeadings=False, extractTables=False, extractStructuredData=False, maxPages=1),
    "map": CrawlOptions(extractText=False, extractImages=False, extractMeta=False, extractHeadings=False, extractTables=False, extractStructuredData=False, maxPages=1),
    "search": CrawlOptions(searchLimit=5),
    "sitemap": CrawlOptions(maxPages=10),
    "diagnose": CrawlOptions(extractMarkdown=True, adaptiveCrawling=True, maxPages=10),
}
