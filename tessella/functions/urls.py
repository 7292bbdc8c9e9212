"""URLs and hosts: resolving, globs, and which hosts may be read."""

from __future__ import annotations

import re
from urllib.parse import quote, urljoin, urlsplit, urlunsplit

from pyspark.sql import Column
from pyspark.sql import functions as F

# Suffixes of two labels under which names are registered.
TWO_LEVEL_SUFFIXES = (
    "co.uk", "org.uk", "gov.uk", "ac.uk", "me.uk", "ltd.uk", "plc.uk", "com.au", "net.au", "org.au", "edu.au", "gov.au", "co.nz", "org.nz", "co.in", "net.in", "org.in",
    "co.jp", "or.jp", "ne.jp", "com.br", "net.br", "com.cn", "net.cn", "org.cn", "co.za", "org.za", "com.sg", "com.mx", "co.kr", "or.kr", "com.tr", "com.hk", "com.tw",
)
# Domains of social links, matched anywhere in a host; and exact hosts of an organisation's profiles.
SOCIAL_DOMAINS = ("facebook.com", "twitter.com", "x.com", "linkedin.com", "instagram.com", "youtube.com", "tiktok.com", "github.com", "pinterest.com")
ORG_SOCIAL_HOSTS = ("twitter.com", "x.com", "linkedin.com", "facebook.com", "instagram.com", "youtube.com", "youtu.be", "github.com", "tiktok.com", "threads.net", "bsky.app")

_PORTS = {"http": "80", "https": "443"}
_SCHEME = re.compile(r"[a-zA-Z][a-zA-Z0-9+.-]*:")
# Plain parts of addresses: nothing in them is changed by resolving (no dots in front, no escapes, no ports).
_NAME = r"[A-Za-z0-9_~-][A-Za-z0-9._~-]*"
_PLAIN_BASE = re.compile(rf"(https?://[a-z0-9-]+(?:\.[a-z0-9-]+)*)((?:/{_NAME})*/)(?:{_NAME})?\Z")
_PLAIN_HREF = re.compile(rf"(?:(?P<whole>https?://[a-z0-9-]+(?:\.[a-z0-9-]+)*(?:/{_NAME})*/(?:{_NAME})?)|(?P<path>(?:/{_NAME})+/?|/)|(?P<name>{_NAME}(?:/{_NAME})*/?)|(?P<query>\?[A-Za-z0-9._~=&-]+))\Z")


def resolve(href: str, base: str) -> str | None:
    """The absolute URL, normalised as browsers do; None if it can't be resolved."""
    if (h := _PLAIN_HREF.match(href)) and (b := _PLAIN_BASE.match(base)):
        kind = h.lastgroup
        return href if kind == "whole" else b[1] + href if kind == "path" else b[1] + b[2] + href if kind == "name" else base + href
    return _resolved(href, base)


def _resolved(href: str, base: str) -> str | None:
    href = re.sub(r"[\t\n\r]", "", href.strip("\x00\x01\x02\x03\x04\x05\x06\x07\x08\x0b\x0c\x0e\x0f \t\n\r"))
    try:
        full = href if _SCHEME.match(href) and not re.match(r"https?:(?!//)", href, re.I) else urljoin(base, href)
        parts = urlsplit(full)
        scheme = parts.scheme.lower()
        if scheme not in _PORTS:
            return full if scheme else None
        if not parts.hostname or re.search(r"[\s<>^|%\\]", parts.hostname):
            return None
        host = parts.hostname.lower()
        host = f"[{host}]" if ":" in host else host if host.isascii() else host.encode("idna").decode()
        port = f":{parts.port}" if parts.port is not None and str(parts.port) != _PORTS[scheme] else ""
    except ValueError:
        return None
    user = parts.netloc.rpartition("@")[0]
    path = _dots(parts.path.replace("\\", "/")) or "/"
    path = quote(path, safe="/%:@!$&'()*+,;=-._~[]|^")
    query = quote(parts.query, safe="/%:@!$&()*+,;=-._~?[]|^`{}\\") if parts.query else ""
    mark = quote(parts.fragment, safe="/%:@!$&'()*+,;=-._~?[]|^{}\\#") if parts.fragment else ""
    return urlunsplit((scheme, f"{user}@{host}{port}" if user else host + port, path, query, mark))


def _dots(path: str) -> str:
    out: list[str] = []
    parts = path.split("/")
    for i, p in enumerate(parts):
        if p in (".", "%2e", "%2E"):
            if i == len(parts) - 1:
                out.append("")
        elif p.lower() in ("..", ".%2e", "%2e.", "%2e%2e"):
            if len(out) > 1:
                out.pop()
            if i == len(parts) - 1:
                out.append("")
        else:
            out.append(p)
    return "/".join(out)


def origin_of(url: str) -> str | None:
    """scheme://host[:port], None if there is none."""
    p = urlsplit(url)
    return f"{p.scheme}://{p.netloc.rpartition('@')[2]}" if p.scheme and p.netloc else None


def with_scheme(url: Column) -> Column:
    """SRC1: https:// in front of what doesn't start with http."""
    return F.when(url.startswith("http"), url).otherwise(F.concat(F.lit("https://"), url))


def host(url: Column) -> Column:
    """Lower-case host of an absolute http(s) URL, null if there is none."""
    got = F.regexp_extract(url, r"(?i)^https?://(?:[^/?#@]*@)?(\[[^\]]*\]|[^/?#:]*)", 1)
    return F.nullif(F.lower(got), F.lit(""))


def origin(url: Column) -> Column:
    return F.nullif(F.lower(F.regexp_extract(url, r"(?i)^(https?://[^/?#]+)", 1)), F.lit(""))


def glob_regex(pattern: str) -> str:
    """PR1: * is any run, ? any character; other regular-expression characters stay live."""
    return "(?i)^" + pattern.replace("*", ".*").replace("?", ".") + "$"


def glob_passes(url: Column, include: list[str], exclude: list[str]) -> Column:
    """PR1: no exclude glob matches, and an include glob does if there are any."""
    ok = F.lit(True)
    for g in exclude:
        ok = ok & ~url.rlike(glob_regex(g))
    if include:
        hit = F.lit(False)
        for g in include:
            hit = hit | url.rlike(glob_regex(g))
        ok = ok & hit
    return ok


def _bound(value: Column, use) -> Column:  # noqa: ANN001
    """``use`` of a value that is worked out once, however often it occurs there."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def private_ip(name: Column) -> Column:
    """PR6: a private, reserved or malformed address literal."""

    def first_two(p: Column) -> Column:
        a, b = F.get(p, F.lit(0)), F.get(p, F.lit(1))
        return (
            F.exists(p, lambda x: x > 255) | a.isin(0, 10, 127) | ((a == 169) & (b == 254)) | ((a == 172) & b.between(16, 31)) | ((a == 192) & b.isin(0, 168))
            | ((a == 100) & b.between(64, 127)) | ((a == 198) & b.isin(18, 19)) | (a >= 224)
        )

    def mapped(h: Column) -> Column:
        """The dotted address inside an IPv6 one (::ffff:), written with dots or as two hexadecimal numbers."""
        halves = F.transform(F.array(*(F.regexp_extract(h, "^::ffff:([0-9a-f]{1,4}):([0-9a-f]{1,4})$", i) for i in (1, 2))), lambda x: F.conv(x, 16, 10).try_cast("int"))
        dotted = F.array_join(F.flatten(F.transform(halves, lambda x: F.array(F.floor(x / 256).cast("string"), (x % 256).cast("string")))), ".")
        return F.when(h.rlike(r"^::ffff:\d{1,3}(\.\d{1,3}){3}$"), F.substring(h, 8, 15)).when(h.rlike("^::ffff:[0-9a-f]{1,4}:[0-9a-f]{1,4}$"), dotted).otherwise(h)

    def judged(h: Column) -> Column:
        v6 = h.isin("::", "::1") | h.rlike("^(fe80|fc|fd|ff|2001:db8)")
        v4 = lambda t: F.when(t.rlike(r"^\d{1,3}(\.\d{1,3}){3}$"), _bound(F.transform(F.split(t, r"\."), lambda x: x.try_cast("int")), first_two))
        return F.coalesce(_bound(mapped(h), v4), F.when(h.contains(":"), v6).otherwise(F.lit(False)))

    return _bound(F.regexp_replace(F.lower(F.trim(name)), r"^\[|\]$", ""), judged)


def blocked_host(name: Column) -> Column:
    """PR5: local and internal names, metadata names, blanks and private addresses."""

    def judged(h: Column) -> Column:
        inside = h.isin("", "localhost", "metadata", "metadata.google.internal") | h.rlike(r"\.(localhost|internal|local|lan)$")
        return F.coalesce(inside | private_ip(h), F.lit(True))

    return _bound(F.regexp_replace(F.lower(F.trim(name)), r"\.$", ""), judged)


def public_url_reason(url: Column) -> Column:
    """PR4: why a URL may not be read; null if it may."""

    def judged(u: Column) -> Column:
        scheme = F.lower(F.regexp_extract(u, r"^([a-zA-Z][a-zA-Z0-9+.-]*):", 1))
        refused = lambda h: F.when(h.isNull(), "not absolute").when(blocked_host(h), "blocked host")
        return F.when(u == "", "empty").when(scheme == "", "not absolute").when(~scheme.isin("http", "https"), "scheme").otherwise(_bound(host(u), refused))

    return _bound(F.trim(F.coalesce(url, F.lit(""))), judged)


def registrable_domain(name: Column) -> Column:
    """UR3: the last two labels, or three under a known two-label suffix."""
    labels = F.split(F.regexp_replace(F.lower(name), r"\.$", ""), r"\.")
    last = F.array_join(F.slice(labels, F.greatest(F.lit(1), F.size(labels) - 1), 2), ".")
    three = F.array_join(F.slice(labels, F.greatest(F.lit(1), F.size(labels) - 2), 3), ".")
    return F.when((F.size(labels) > 2) & last.isin(*TWO_LEVEL_SUFFIXES), three).otherwise(last)


def same_site(a: Column, b: Column) -> Column:
    """PR9."""
    return registrable_domain(a) == registrable_domain(b)


def image_type(url: Column) -> Column:
    """UR4: svg, png, jpg, webp, gif, ico or avif, else null."""
    ext = F.regexp_extract(F.lower(F.split(url, r"\?").getItem(0)), r"\.(svg|png|jpe?g|webp|gif|ico|avif)$", 1)
    return F.when(url.startswith("data:image/svg"), F.lit("svg")).when(ext == "jpeg", F.lit("jpg")).otherwise(F.nullif(ext, F.lit("")))


def clean_headers(headers: Column) -> Column:
    """PR8: headers a caller may set. Hop-by-hop, forwarding and host headers are dropped."""
    return F.map_filter(headers, lambda k, v: ~_header_blocked(k) & v.isNotNull())


# Request headers, and beginnings of their names, that callers may not set.
BLOCKED_HEADERS = ("host", ":authority", "forwarded", "connection", "content-length", "transfer-encoding", "te", "upgrade", "keep-alive", "trailer")
BLOCKED_PREFIXES = ("x-forwarded-", "proxy-")


def _header_blocked(name: Column) -> Column:
    n = F.lower(F.trim(name))
    out = n.isin(*BLOCKED_HEADERS)
    for p in BLOCKED_PREFIXES:
        out = out | n.startswith(p)
    return out


def dropped_headers(headers: Column) -> Column:
    return F.array_sort(F.transform(F.filter(F.map_keys(headers), _header_blocked), lambda k: F.lower(F.trim(k))))
