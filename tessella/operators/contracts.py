"""Contracts: named schemas of records with required fields, and validation against them."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessella.functions.text import ABSENT
from tessella.schema import STRINGS, D, S, struct

MONEY = struct(amount=D, currency=S, raw=S)


@dataclass(frozen=True)
class Contract:
    name: str
    domain: str
    version: str
    required: tuple[str, ...]
    schema: T.StructType


# The built-in contracts and their fields.
CONTRACTS = {c.name: c for c in (
    Contract("real-estate-listing", "real-estate", "2026-05-19", ("title", "price", "location", "sourceUrl"), struct(
        title=S, price=MONEY, location=struct(raw=S, city=S, region=S, country=S), beds=D, baths=D, area=struct(value=D, unit=S, raw=S), listingType=S, propertyType=S, description=S, images=STRINGS,
        agentOrBroker=struct(name=S, phone=S, email=S, company=S), sourceUrl=S, confidence=D, evidenceNotes=STRINGS)),
    Contract("product-page", "ecommerce", "2026-05-22", ("name", "price", "sourceUrl"), struct(
        name=S, price=MONEY, availability=S, brand=S, sku=S, rating=struct(value=D, reviewCount=D, raw=S), images=STRINGS, description=S, sourceUrl=S, confidence=D, evidenceNotes=STRINGS)),
    Contract("docs-page", "documentation", "2026-05-24", ("title", "summary", "sourceUrl"), struct(
        title=S, summary=S, sourceUrl=S, headings=STRINGS, apiEndpoints=STRINGS, codeExamples=STRINGS, productArea=S, confidence=D, evidenceNotes=STRINGS)),
    Contract("brand-context", "brand", "2026-06-28", ("brandName", "sourceUrl"), struct(
        brandName=S, tagline=S, oneLineDescription=S, whatWeDo=S, companyDescription=S, targetAudience=S, industryCategory=S, brandTone=S, voiceAdjectives=STRINGS, keyProductsOrServices=STRINGS,
        keyDifferentiators=STRINGS, socialLinks=struct(twitter=S, linkedin=S, instagram=S, facebook=S, youtube=S), sourceUrl=S, evidenceNotes=STRINGS)),
)}


def names() -> list[str]:
    """TK6."""
    return sorted(CONTRACTS)


def contract(name: str) -> Contract:
    """J7: an unknown name is an error that lists the known ones."""
    if name not in CONTRACTS:
        raise ValueError(f'unknown contract "{name}"; there are {", ".join(names())}')
    return CONTRACTS[name]


def registry(spark: SparkSession) -> DataFrame:
    """CT1: the contracts as rows."""
    rows = [(c.name, c.domain, c.version, list(c.required), c.schema.simpleString()) for c in CONTRACTS.values()]
    return spark.createDataFrame(rows, "name string, domain string, version string, required array<string>, schema string")


def meaningful(c: Column, kind: T.DataType) -> Column:
    """PR10: false for nulls, blanks, NaN, empty arrays, and structs of nothing else; any boolean, 0 too, is a value."""
    if isinstance(kind, T.StringType):
        return F.coalesce(F.regexp_replace(c, r"(?U)\s+", "") != "", F.lit(False))
    if isinstance(kind, (T.DoubleType, T.FloatType)):
        return c.isNotNull() & ~F.isnan(c) & ~c.isin(float("inf"), float("-inf"))
    if isinstance(kind, T.ArrayType):
        return c.isNotNull() & (F.size(c) > 0)
    if isinstance(kind, T.StructType):
        out = F.lit(False)
        for f in kind.fields:
            out = out | meaningful(c[f.name], f.dataType)
        return c.isNotNull() & out
    return c.isNotNull()


def validation(data: Column, c: Contract) -> Column:
    """CT2: struct(valid, missingRequiredFields, requiredFields); a null record misses all."""
    missing = F.array_compact(F.array(*(F.when(~meaningful(data[n], c.schema[n].dataType), F.lit(n)) for n in c.required)))
    return F.struct((F.size(missing) == 0).alias("valid"), missing.alias("missingRequiredFields"), F.array(*map(F.lit, c.required)).alias("requiredFields"))


def typed(data: Column, c: Contract) -> Column:
    """A record's JSON text read by the contract's schema; other keys are dropped."""
    return F.from_json(data, c.schema)


def attach_validation(results: DataFrame, name: str) -> DataFrame:
    """CT3: results (status, data as JSON text) with the contract and its validation, null where the extraction failed."""
    c = contract(name)
    data = F.coalesce(typed(F.col("data"), c), F.from_json(F.lit("{}"), c.schema))
    about = F.struct(F.lit(c.name).alias("name"), F.lit(c.domain).alias("domain"), F.lit(c.version).alias("version"))
    return results.withColumn("contract", about).withColumn("validation", F.when(F.col("status") == "success", validation(data, c)))


def json_schema(kind: T.DataType) -> dict:
    """The JSON schema of a Spark type, every leaf nullable."""
    if isinstance(kind, T.StructType):
        return {"type": "object", "additionalProperties": False, "required": kind.names, "properties": {f.name: json_schema(f.dataType) for f in kind.fields}}
    if isinstance(kind, T.ArrayType):
        return {"type": "array", "items": {"type": "string"}}
    return {"type": ["number" if isinstance(kind, T.DoubleType) else "string", "null"]}


def spark_type(schema: dict) -> T.DataType:
    """The Spark type of a JSON schema: objects, arrays, scalars; VARIANT where it doesn't say."""
    kind = schema.get("type")
    kind = next((k for k in kind if k != "null"), None) if isinstance(kind, list) else kind
    if kind == "object" and schema.get("properties"):
        return T.StructType([T.StructField(k, spark_type(v)) for k, v in schema["properties"].items()])
    if kind == "array":
        return T.ArrayType(spark_type(schema.get("items", {})))
    return {"string": T.StringType(), "number": T.DoubleType(), "integer": T.LongType(), "boolean": T.BooleanType()}.get(kind, T.VariantType())


UNSAFE_KEYS = frozenset(("__proto__", "prototype", "constructor"))
DEPTH = 50


def nullable_schema(schema: object, depth: int = 0) -> object:
    """JS5: a copy in which each declared property may also be null. Enumerations, constants and unions stay as they are."""
    if depth > DEPTH or not isinstance(schema, (dict, list)):
        return schema
    if isinstance(schema, list):
        return [nullable_schema(x, depth + 1) for x in schema]

    def widened(s: object) -> object:
        s = nullable_schema(s, depth + 1)
        if not isinstance(s, dict) or "type" not in s or {"enum", "const", "anyOf", "oneOf"} & s.keys():
            return s
        kinds = s["type"] if isinstance(s["type"], list) else [s["type"]]
        return s if "null" in kinds else s | {"type": [*kinds, "null"]}

    out = {k: v for k, v in schema.items() if k not in UNSAFE_KEYS}
    for group in ("properties", "$defs", "definitions"):
        if isinstance(out.get(group), dict):
            out[group] = {k: widened(v) for k, v in out[group].items() if k not in UNSAFE_KEYS}
    if out.get("items"):
        out["items"] = nullable_schema(out["items"], depth + 1)
    if isinstance(out.get("additionalProperties"), dict):
        out["additionalProperties"] = widened(out["additionalProperties"])
    return out


def without_absent(value: object, depth: int = 0) -> object:
    """ST11, JS6: strings that say "absent" become null, at any depth up to the limit; unsafe keys go (JS7)."""
    if depth > DEPTH:
        return value
    if isinstance(value, str):
        return None if value.strip().lower() in ABSENT else value
    if isinstance(value, list):
        return [without_absent(x, depth + 1) for x in value]
    if isinstance(value, dict):
        return {k: without_absent(v, depth + 1) for k, v in value.items() if k not in UNSAFE_KEYS}
    return value
