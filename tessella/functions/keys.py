"""Cache keys."""

from __future__ import annotations

import dataclasses
import hashlib
import json

from pyspark.sql import Column
from pyspark.sql import functions as F

from tessella.schema import CrawlOptions

VERSION = "1"
#: Options that only say where pages come from or how many: they don't change a page.
NOT_OUTPUT = ("urls", "searchQuery", "searchLimit", "sitemapUrl", "maxDepth", "maxPages", "includeGlobs", "excludeGlobs", "requestRetries", "requestTimeoutSecs")


def stable_json(value: object) -> str:
    """HK4: JSON with sorted keys."""
    return json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=False)


def shape(options: CrawlOptions) -> str:
    return stable_json({k: v for k, v in dataclasses.asdict(options).items() if k not in NOT_OUTPUT})


def crawl_key(url: Column, options: CrawlOptions) -> Column:
    """HK2: 16 hex digits over the version, the requested address and every option that changes the output."""
    return F.substring(F.sha2(F.concat_ws("|", F.lit(VERSION), url, F.lit(shape(options))), 256), 1, 16)


def extract_key(url: Column, options: CrawlOptions, **inputs: object) -> Column:
    """HK3: x and 23 hex digits over the schema, prompt, contract, model, grounding, limit and crawl options."""
    return F.concat(F.lit("x"), F.substring(F.sha2(F.concat_ws("|", F.lit(VERSION), url, F.lit(stable_json(inputs)), F.lit(shape(options))), 256), 1, 23))


def crawl_key_of(url: str, options: CrawlOptions) -> str:
    return hashlib.sha256("|".join((VERSION, url, shape(options))).encode()).hexdigest()[:16]
