"""Page records from a table of pages: parse step, expressions, errors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessella.functions import errors
from tessella.operators import columns as C
from tessella.operators.parse import parse_pages
from tessella.schema import CrawlOptions

ADVICE = " — blocked by an access check: rendering may pass lighter ones; others need another address"
CHALLENGE_ERROR = "Access-control or challenge page detected."


def error_message(message: Column, kind: Column) -> Column:
    """CL2: blocked pages say what may help."""
    return F.when(kind == "blocked-bot", F.concat(message, F.lit(ADVICE))).otherwise(message)


def records(pages: DataFrame, options: CrawlOptions | None = None) -> DataFrame:
    """The page record of each row of ``pages`` (url, html; optional: statusCode, responseHeaders, error, loadedUrl).

    Challenge pages become errors. Only the fields that ``options`` ask for are computed; the rest have
    their defaults. One Arrow stage, no shuffle.
    """
    o = options or CrawlOptions()
    df = parse_pages(pages, options=o)
    have = df.columns
    status = F.col("statusCode").cast("int") if "statusCode" in have else F.lit(200)
    failed = F.col("error").isNotNull() if "error" in have else F.lit(False)
    header = F.try_element_at("responseHeaders", F.lit("x-robots-tag")) if "responseHeaders" in have else F.lit(None).cast("string")
    p = {f.name: F.col(f"page.{f.name}") for f in df.schema["page"].dataType.fields}
    out = {n: p[n] for n in p if n not in ("robotsMeta", "css", "themeColorRaw", "manifestHref", "stylesheets", "logoCandidates")}
    if not o.extractText:
        out.pop("text")
    out |= {"url": F.col("loadedUrl") if "loadedUrl" in have else F.col("url"), "pageSizeBytes": C.page_size(F.col("html")), "robotsDirectives": C.robots(p["robotsMeta"], header)}
    scope = F.col("html") if o.scanScope == "raw" else C.without_scripts(F.col("html"))
    out["analyticsDetected"] = C.trackers(scope)
    if o.extractEmails:
        out["emails"] = C.emails(scope)
    if o.extractPhones:
        out["phones"] = C.phones(scope)
    if o.extractRawHtml:
        out["rawHtml"] = C.raw_html(F.col("html"))
    if "meta" in p:
        out |= {"openGraph": C.prefixed(p["meta"], "og:"), "twitterCard": C.prefixed(p["meta"], "twitter:"), "description": C.description(p["meta"])}
    if "links" in p:
        out["socialLinks"] = C.social_links(p["links"])
    if o.extractStructuredData and "structuredData" in p:
        out["commerceData"] = C.commerce(p["structuredData"])
    if "loadedUrl" in have:
        out["redirectChain"] = C.redirects(F.col("url"), F.col("loadedUrl"))
    blocked = errors.challenge(status, p["text"])
    kind = errors.error_type(F.col("error"), status) if "error" in have else F.lit("unknown")
    message = error_message(F.col("error"), kind) if "error" in have else F.lit(None).cast("string")
    out |= {
        "statusCode": status, "status": F.when(failed | blocked, "error").otherwise("success"), "error": F.when(failed, message).when(blocked, CHALLENGE_ERROR),
        "errorType": F.when(failed, kind).when(blocked, "blocked-bot"), "errorRetryable": F.when(failed, kind.isin(*errors.RETRYABLE)).otherwise(F.lit(False)),
    }
    if "responseHeaders" in have:
        out["responseHeaders"] = F.col("responseHeaders")
    keys = [c for c in ("page_id",) if c in have]
    made = df.select(*keys, *(v.alias(k) for k, v in out.items()))
    if keys:
        full = C.full_record(made)
        return made.select(*keys, *(F.col(n) if n in made.columns else C.default(n).alias(n) for n in full.columns))
    return C.full_record(made)
