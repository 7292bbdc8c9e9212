"""Classes of crawl and model errors, and readiness rules on text, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Words that tell an error's class, looked for in the lower-case message.
RATE_LIMIT = ("429", "too many requests")
BLOCKED = ("403", "request blocked", "blocked", "cloudflare", "access denied", "attention required", "akamai", "perimeterx", "datadome", "captcha")
DNS = ("enotfound", "dns")
TIMEOUT = ("timeout", "etimedout")
NETWORK = ("econnreset", "econnrefused", "ehostunreach", "socket", "network", "no page result emitted", "skipped by the crawl queue")
PARSE = ("parse", "invalid", "malformed")
CHALLENGE = ("attention required", "access denied", "cloudflare ray id", "checking your browser")
RETRYABLE = ("rate-limit", "http-5xx", "timeout", "network")
#: Ids of elements in which script applications draw themselves.
APP_ROOTS = ("root", "app", "__next", "__nuxt", "__svelte")


def any_of(text: Column, words: tuple[str, ...]) -> Column:
    out = F.lit(False)
    for w in words:
        out = out | text.contains(w)
    return out


def error_type(message: Column, status: Column) -> Column:
    """CL1: the first class that fits."""
    m = F.lower(F.coalesce(message, F.lit("")))
    s = F.coalesce(status, F.lit(0))
    return (
        F.when((s == 429) | any_of(m, RATE_LIMIT), "rate-limit").when(s.between(500, 599), "http-5xx").when((s == 403) | any_of(m, BLOCKED), "blocked-bot")
        .when(s.between(400, 499), "http-4xx").when(any_of(m, DNS), "dns").when(any_of(m, TIMEOUT), "timeout").when(any_of(m, NETWORK), "network")
        .when(any_of(m, PARSE), "parse").otherwise("unknown")
    )


def error_class(message: Column, status: Column) -> Column:
    """CL1: struct(type, retryable)."""
    kind = error_type(message, status)
    return F.struct(kind.alias("type"), kind.isin(*RETRYABLE).alias("retryable"))


def llm_error(message: Column) -> Column:
    """CL3."""
    m = F.lower(F.coalesce(message, F.lit("")))
    return F.when(m.contains("aborted") | m.contains("timeout"), "llm-timeout").when(m.contains("http "), "llm-http-error").otherwise("llm-network")


def challenge(status: Column, text: Column) -> Column:
    """EX28: a page that answers 200 but is an access check."""
    return F.coalesce((status == 200) & (text != "") & any_of(F.lower(text), CHALLENGE), F.lit(False))


def needs_render(text: Column, html: Column) -> Column:
    """EX29: too little text for a page without a browser."""
    n = F.length(F.coalesce(text, F.lit("")))
    root = html.rlike(r"""(?i)<div[^>]*\bid=["']?(""" + "|".join(APP_ROOTS) + r""")["'\s>]""")
    return (n < 200) | ((n < 500) & F.coalesce(root, F.lit(False)))
