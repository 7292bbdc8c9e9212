"""Field discovery: which fields a page offers, from its structured parts, as rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessella.functions.text import clip, field_key, field_label, normalise

# Labels of commerce fields in order, of OpenGraph names, and the meta names used.
COMMERCE = (("name", "name"), ("price", "price"), ("currency", "currency"), ("availability", "availability"), ("rating", "rating"), ("reviewCount", "review count"), ("brand", "brand"), ("sku", "sku"))
OPEN_GRAPH = {"title": "title", "description": "description", "image": "image", "site_name": "site name", "type": "type", "url": "url", "price": "price", "price:amount": "price", "price:currency": "currency"}
META = ("description", "author", "keywords")
FIELDS, READABLE, DEPTH = 24, 200, 4


def _none(kind: str) -> Column:
    return F.array().cast(f"array<{kind}>")


def _bound(value: Column, use) -> Column:  # noqa: ANN001
    """``use`` of a value that is worked out once."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def json_ld_objects(structured: Column) -> Column:
    """JS3: the JSON-LD objects (variant) of a page in order, with arrays and @graph opened up to four levels."""

    def opened(v: Column) -> Column:
        kind, graph = F.schema_of_variant(v), F.try_variant_get(v, "$['@graph']", "array<variant>")
        inner = F.when(kind.startswith("ARRAY"), F.coalesce(F.try_variant_get(v, "$", "array<variant>"), _none("variant")))
        return inner.when(kind.startswith("OBJECT") & graph.isNotNull(), graph).otherwise(F.array(v))

    level = F.filter(F.transform(F.coalesce(structured, _none("string")), lambda s: F.try_parse_json(s)), lambda v: v.isNotNull())
    for _ in range(DEPTH - 1):
        level = F.flatten(F.transform(level, opened))
    return F.filter(level, lambda v: F.schema_of_variant(v).startswith("OBJECT") & F.try_variant_get(v, "$['@graph']", "array<variant>").isNull())


def _entries(v: Column) -> Column:
    """Key and value of each field of an object."""
    return F.filter(F.map_entries(F.try_variant_get(v, "$", "map<string,variant>")), lambda e: e["value"].isNotNull())


ITEM = "name:string,key:string,sample:string,source:string"


def _item(source: str, name: Column, sample: Column) -> Column:
    return F.struct(field_label(name).alias("name"), field_key(name).alias("key"), clip(sample.cast("string")).alias("sample"), F.lit(source).alias("source"))


def _given(c: Column) -> Column:
    return F.coalesce(F.trim(c.cast("string")) != "", F.lit(False))


def candidates(page: dict[str, Column]) -> Column:
    """Candidates of every source (name, key, sample, source), those that go before others first: one array for each page."""
    pairs = lambda cells: F.filter(F.array(*(F.struct(F.lit(n).alias("n"), v.alias("v")) for n, v in cells)), lambda f: _given(f["v"]))
    told = lambda source: lambda f: _item(source, f["n"], f["v"])
    in_map = lambda m: F.filter(F.map_entries(m), lambda e: _given(e["value"]))
    sold = F.flatten(F.transform(page["commerceData"], lambda c: F.transform(pairs([(label, c[k].cast("string")) for k, label in COMMERCE]), told("commerce"))))
    text = lambda e: F.try_variant_get(e["value"], "$", "string")
    plain = lambda e: ~e["key"].startswith("@") & ~F.schema_of_variant(e["value"]).rlike("^(ARRAY|OBJECT)") & _given(text(e))
    flat = F.flatten(F.transform(json_ld_objects(page["structuredData"]), lambda v: F.transform(F.filter(_entries(v), plain), lambda e: _item("json-ld", e["key"], text(e)))))
    micro = F.flatten(F.transform(page["microdata"], lambda m: F.transform(in_map(m["properties"]), lambda e: _item("microdata", e["key"], e["value"]))))
    labels = F.create_map(*(F.lit(x) for kv in OPEN_GRAPH.items() for x in kv))
    og = F.transform(in_map(page["openGraph"]), lambda e: _item("opengraph", F.coalesce(F.try_element_at(labels, F.lower(e["key"])), e["key"]), e["value"]))
    meta = F.transform(pairs([(k, F.try_element_at(page["meta"], F.lit(k))) for k in META]), told("meta"))
    heads = lambda t: F.filter(F.transform(t["headers"], lambda h, i: F.struct(h.alias("n"), F.get(F.get(t["rows"], F.lit(0)), i).alias("v"))), lambda f: _given(f["n"]))
    tables = F.flatten(F.transform(page["tables"], lambda t: F.transform(heads(t), told("table"))))
    basic = F.transform(pairs([("title", page["title"]), ("description", page["description"])]), told("meta"))
    all_ = F.concat(*(F.coalesce(x, _none(f"struct<{ITEM}>")) for x in (sold, flat, micro, og, meta, tables, basic)))
    return F.filter(all_, lambda x: x["key"].isNotNull())


def field_list(page: dict[str, Column]) -> Column:
    """FD1: position, name, sample, source: the first writer of a name wins (W5), and a later one may fill an empty sample; 24 at most."""

    def chosen(c: Column) -> Column:
        keys = F.slice(F.array_distinct(F.transform(c, lambda x: x["key"])), 1, FIELDS)

        def one(k: Column, i: Column) -> Column:
            return _bound(F.filter(c, lambda x: x["key"] == k), lambda same: F.struct(
                i.alias("position"), F.get(same, F.lit(0))["name"].alias("name"),
                F.coalesce(F.get(F.filter(same, lambda x: x["sample"] != ""), F.lit(0))["sample"], F.lit("")).alias("sample"), F.get(same, F.lit(0))["source"].alias("source")))

        return F.transform(keys, one)

    return _bound(candidates(page), chosen)


_USED = ("commerceData", "structuredData", "microdata", "openGraph", "meta", "tables", "title", "description")


def _page(names=_USED) -> dict[str, Column]:  # noqa: ANN001
    return {n: F.col(n) for n in names}


def fields(pages: DataFrame) -> DataFrame:
    """FD1: page_id, position, name, sample, source for each field of each page; no shuffle."""
    return pages.select("page_id", F.explode(field_list(_page())).alias("f")).select("page_id", "f.*")


def listed_items(page: dict[str, Column]) -> Column:
    """AG11: the most items that a list of the page's structured parts has. Rows of tables never make a listing."""
    named = lambda e: (e["key"] == "itemListElement") | (~e["key"].startswith("@") & F.lower(e["key"]).contains("item"))
    lists = F.flatten(F.transform(json_ld_objects(page["structuredData"]), lambda v: F.filter(_entries(v), lambda e: named(e) & F.schema_of_variant(e["value"]).startswith("ARRAY"))))
    most = F.array_max(F.transform(lists, lambda e: F.size(F.try_variant_get(e["value"], "$", "array<variant>"))))
    return F.greatest(F.size(page["commerceData"]), F.size(page["microdata"]), F.coalesce(most, F.lit(0)))


def record_types(pages: DataFrame) -> DataFrame:
    """FD2: page_id, recordType, itemCount (null for single)."""
    most = F.col("most")
    df = pages.select("page_id", listed_items(_page()).alias("most"))
    return df.select("page_id", F.when(most > 1, "listing").otherwise("single").alias("recordType"), F.when(most > 1, most).alias("itemCount"))


def readable(status: Column, n_fields: Column, markdown: Column, text: Column) -> Column:
    """FD3."""
    size = F.coalesce(F.length(markdown), F.lit(0)) + F.coalesce(F.length(text), F.lit(0))
    return (status != "error") & ((F.coalesce(n_fields, F.lit(0)) > 0) | (size >= READABLE))


def discover(pages: DataFrame) -> DataFrame:
    """page_id, url, recordType, itemCount, fields, readable, note for each page record; pages are read once, without a shuffle."""
    df = pages.select("page_id", "url", "status", "error", "markdown", "text", field_list(_page()).alias("found"), listed_items(_page()).alias("most"))
    failed = F.col("status") == "error"
    ok = readable(F.col("status"), F.size("found"), F.col("markdown"), F.col("text"))
    note = F.when(failed, F.concat_ws(": ", F.lit("The page couldn't be read"), "error")).when(~ok, "The page looks empty, or needs a browser: nothing usable was found.")
    several = ~failed & (F.col("most") > 1)
    return df.select(
        "page_id", "url", F.when(several, "listing").otherwise("single").alias("recordType"), F.when(several, F.col("most")).alias("itemCount"),
        F.when(~failed & (F.size("found") > 0), F.col("found")).alias("fields"), ok.alias("readable"), note.alias("note"),
    )


def merge_proposed(base: dict, proposal: dict | None, source: str) -> dict:
    """FD4: fields a model proposes added to those found: known names are skipped, samples not on the page blanked, single may become listing only."""
    if not proposal or not isinstance(proposal.get("fields"), list):
        return base
    plain, out = normalise(source), list(base["fields"])
    seen = {normalise(f["name"].replace("_", " ")) for f in out}
    for f in proposal["fields"]:
        if len(out) >= FIELDS:
            break
        name = f.get("name") if isinstance(f, dict) else None
        if not isinstance(name, str):
            continue
        key = " ".join(name.lower().replace("_", " ").split())
        if not key or key.startswith("@") or key in seen:
            continue
        sample = " ".join(str(f.get("sample") or "").split())
        sample = sample if len(sample) <= 80 else sample[:79] + "…"
        shown = normalise(sample.removesuffix("…"))
        seen.add(key)
        out.append({"name": " ".join(name.replace("_", " ").split()), "sample": sample if shown and shown in plain else "", "source": "llm"})
    merged = dict(base, fields=out)
    if base["recordType"] == "single" and proposal.get("recordType") == "listing":
        n = proposal.get("itemCount")
        merged |= {"recordType": "listing", "itemCount": int(n) if isinstance(n, (int, float)) and n > 1 else None}
    return merged
