"""Grounding: values of a record that the source text doesn't bear out become null."""

from __future__ import annotations

import functools
import json
import re
from collections.abc import Callable, Iterator
from functools import lru_cache
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessella.functions.text import canonical_number, normalise
from tessella.operators.contracts import DEPTH, UNSAFE_KEYS
from tessella.schema import STRINGS, S, struct

_TOKEN = re.compile(r"[^\W_]{3,}")
_RUN = re.compile(r"[0-9][0-9,]*(?:\.[0-9]+)?")
_NUMBER = re.compile(r"[0-9]+(?:\.[0-9]+)?")
#: Share of a long value's words that the source must have; share of digits in a value taken as a number.
WORDS, DIGITS = 0.6, 0.6


def number_of(value: object) -> str:
    """ST5: canonical digits of a value; whole doubles are written without decimals."""
    if isinstance(value, float) and value.is_integer() and abs(value) < 1e21:
        value = int(value)
    m = _NUMBER.search(str(value).replace(",", ""))
    return m[0] if m else ""


@dataclass(frozen=True)
class Source:
    """G1: what grounding looks values up in."""

    text: str
    words: frozenset[str]
    numbers: frozenset[str]

    @classmethod
    def of(cls, text: str) -> Source:
        plain = normalise(text)
        return cls(plain, frozenset(_TOKEN.findall(plain)), frozenset(x.replace(",", "") for x in _RUN.findall(text)))


@dataclass(frozen=True)
class Value:
    """What G2 asks of a value, the same for all sources: its text (none for numbers), its number if that decides, its words."""

    plain: str | None
    number: str | None
    words: frozenset[str]

    @classmethod
    def of(cls, value: object) -> Value:
        if isinstance(value, (int, float)):
            return cls(None, number_of(value), frozenset())
        plain = normalise(value)
        letters = sum(c.isalnum() for c in plain)
        digits = sum("0" <= c <= "9" for c in plain)
        return cls(plain, number_of(plain) if digits >= 2 and digits / letters >= DIGITS else None, frozenset(_TOKEN.findall(plain)))

    def within(self, source: Source) -> bool:
        if self.plain is not None and self.plain in source.text:
            return True
        if self.number is not None:
            return self.number in source.numbers
        return len(self.words) > 3 and len(self.words & source.words) / len(self.words) >= WORDS


_value = functools.lru_cache(1 << 14, typed=True)(Value.of)


def grounded(value: object, source: Source) -> bool:
    """G2."""
    return _value(value).within(source)


def ground(value: object, source: Source, path: str = "", nulled: list[str] | None = None, depth: int = 0) -> tuple[object, list[str]]:
    """G3, AG13: the value with ungrounded leaves null, and their paths. Booleans stay."""
    nulled = [] if nulled is None else nulled
    if depth > DEPTH or value is None or isinstance(value, bool):
        return value, nulled
    if isinstance(value, (str, int, float)):
        if grounded(value, source):
            return value, nulled
        nulled.append(path or "(root)")
        return None, nulled
    if isinstance(value, list):
        return [ground(x, source, f"{path}[{i}]", nulled, depth + 1)[0] for i, x in enumerate(value)], nulled
    return {k: ground(x, source, f"{path}.{k}" if path else k, nulled, depth + 1)[0] for k, x in value.items() if k not in UNSAFE_KEYS}, nulled


GROUNDED = struct(data=S, nulledFields=STRINGS)


@F.pandas_udf(GROUNDED)
def ground_json(data, text):  # noqa: ANN001, ANN201
    """struct(data, nulledFields) of records as JSON texts and their source texts."""
    import pandas as pd

    out, of = [], lru_cache(maxsize=64)(Source.of)
    for d, t in zip(data, text, strict=True):
        value, paths = ground(json.loads(d), of(t or "")) if d else (None, [])
        out.append({"data": json.dumps(value, ensure_ascii=False), "nulledFields": paths})
    return pd.DataFrame(out, columns=["data", "nulledFields"])


@F.pandas_udf(T.BooleanType())
def grounded_text(value, text):  # noqa: ANN001, ANN201
    """G2 for text columns."""
    import pandas as pd

    of = lru_cache(maxsize=64)(Source.of)  # many values share a page's text
    return pd.Series([v is None or grounded(v, of(t or "")) for v, t in zip(value, text, strict=True)], dtype=bool)


@F.pandas_udf(T.StringType())
def normalised(text):  # noqa: ANN001, ANN201
    """ST4 as a column function."""
    return text.map(lambda t: None if t is None else normalise(t))


def flat(c: Column) -> Column:
    """Lower case, white space collapsed."""
    return F.trim(F.regexp_replace(F.lower(c), r"\s+", " "))


def contains_value(value: Column, text: Column) -> Column:
    """G2's first rule on plain texts, in the JVM: lower case, white space collapsed."""
    return flat(text).contains(flat(value))


def source_tokens(text: Column) -> Column:
    """AG12: distinct words of three letters or digits and more, lower case."""
    return F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit(r"[\p{L}\p{N}]{3,}"), F.lit(0)))


def source_numbers(text: Column) -> Column:
    """AG12: distinct digit runs, commas removed."""
    runs = F.regexp_extract_all(text, F.lit(r"\d[\d,]*(?:\.\d+)?"), F.lit(0))
    return F.array_distinct(F.transform(runs, lambda x: F.replace(x, F.lit(","), F.lit(""))))


def number_grounded(value: Column, text: Column) -> Column:
    """G2's number rule in the JVM."""
    c = canonical_number(value)
    return (c != "") & F.array_contains(source_numbers(text), c)


def token_share(value: Column, text: Column) -> Column:
    """J8: share of a value's words that the source has."""
    mine = source_tokens(value)
    return F.size(F.array_intersect(mine, source_tokens(text))) / F.nullif(F.size(mine), F.lit(0))


#: Rows of pairs that a task gives at a time.
PAIR_ROWS = 8192


def _pairs(docs: DataFrame, items: DataFrame, fields: str, make: Callable) -> DataFrame:
    """doc_id, item_id and ``fields`` for pairs of documents and items, each two columns (id, content).

    Items are a bounded block: they are collected and broadcast. ``make`` takes their contents and gives
    a function from a document's content to item positions and lists of the fields.
    """
    rows = items.collect()
    held = docs.sparkSession.sparkContext.broadcast(([r[0] for r in rows], [r[1] for r in rows]))
    kinds = [df.schema[0].dataType for df in (docs, items)]
    schema = f"doc_id {kinds[0].simpleString()}, item_id {kinds[1].simpleString()}, {fields}".rstrip(", ")
    names = T.StructType.fromDDL(schema).names
    item_kind = pa.int64() if isinstance(kinds[1], T.LongType) else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, contents = held.value
        ids, f = pa.array(ids, item_kind), make(contents)
        for b in batches:
            at, hit, more = [], [], [[] for _ in names[2:]]
            for i in range(len(b)):
                found, *columns = f(b.column(1)[i].as_py())
                at.append(np.full(len(found), i))
                hit.append(np.asarray(found, np.int64))
                for m, c in zip(more, columns, strict=True):
                    m.extend(c)
                if i == len(b) - 1 or sum(map(len, hit)) >= PAIR_ROWS:
                    yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(np.concatenate(at))), ids.take(pa.array(np.concatenate(hit))), *(pa.array(m) for m in more)], names=names)
                    at, hit, more = [], [], [[] for _ in names[2:]]

    return docs.mapInArrow(run, schema)


def grounded_pairs(docs: DataFrame, items: DataFrame) -> DataFrame:
    """G2: doc_id, item_id of all pairs (id, text), (id, value) where the document bears the value out. A null value is."""

    def make(values: list) -> Callable:
        values = [None if v is None else Value.of(v) for v in values]

        def of(text: str | None) -> tuple:
            source = Source.of(text or "")
            return ([i for i, v in enumerate(values) if v is None or v.within(source)],)

        return of

    return _pairs(docs, items, "", make)


def ground_pairs(docs: DataFrame, items: DataFrame) -> DataFrame:
    """G3: doc_id, item_id, data, nulled for each pair of a document (id, text) and a record (id, JSON)."""

    def make(records: list) -> Callable:
        records, said = [None if r is None else json.loads(r) for r in records], {}

        def of(text: str | None) -> tuple:
            source, data, nulled = Source.of(text or ""), [], []
            for i, r in enumerate(records):
                value, paths = (None, []) if r is None else ground(r, source)
                key = (i, *paths)  # the same leaves are null: the same text
                if key not in said:
                    said[key] = json.dumps(value, ensure_ascii=False), ",".join(paths)
                data.append(said[key][0])
                nulled.append(said[key][1])
            return range(len(records)), data, nulled

        return of

    return _pairs(docs, items, "data string, nulled string", make)


def token_shares(docs: DataFrame, items: DataFrame) -> DataFrame:
    """J8: doc_id, item_id, share for each pair of a document (id, words) and an item (id, words); null without words."""

    def make(words: list) -> Callable:
        size = np.array([len(w or ()) for w in words], np.float64)
        where: dict[str, list] = {}
        for i, ws in enumerate(words):
            for w in ws or ():
                where.setdefault(w, []).append(i)
        where = {w: np.array(at, np.int64) for w, at in where.items()}

        def of(mine: list | None) -> tuple:
            if mine is None:
                return range(len(size)), [None] * len(size)
            hits = [where[w] for w in mine if w in where]
            n = np.bincount(np.concatenate(hits), minlength=len(size)) if hits else np.zeros(len(size))
            return range(len(size)), [a / b if b else None for a, b in zip(n.tolist(), size.tolist(), strict=True)]

        return of

    return _pairs(docs, items, "share double", make)
