"""Personal data: base patterns, and information-theoretic sanitisation of what gives them away.

Four kinds of entities are found by pattern. A term (a run of letters) near an entity may disclose it:
over the whole corpus, p(kind) is the share of words that lie near an entity of the kind, and
p(kind | term) that share among the term's own occurrences, with PRIOR occurrences added of which as
many lie near the kind as among all words: a term that is rarely seen is judged too, but needs more to
be removed. PMI(term; kind) = log2 p(kind | term) / p(kind) says how much the term tells, and the kind's
information content, IC = -log2 p(kind), how much there is to tell. A term near an entity with PMI >=
REMOVE * IC is removed, one with PMI >= GENERALISE * IC is generalised to its kind.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.llm.common import bit_field, hits, small_batches, word_hashes, written

KINDS = ("email", "ip", "card", "phone")
#: Words looked at on each side of an entity, and characters they lie in at most.
NEAR_WORDS = 5
NEAR_CHARS = 120
PRIOR = 4.0
GENERALISE, REMOVE = 0.5, 0.8
#: Disclosing terms (20 bytes each) that are broadcast at most; more are joined by salted keys, SALTS for each.
BROADCAST_ROWS = 500_000
SALTS = 16

_LOCAL = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-"
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_DOTTED = re.compile(r"[0-9]++(?:\.[0-9]++)*+")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_NOT_DIGIT = re.compile(r"[^0-9]+")
_TERM = re.compile("[A-Za-z\x80-\U0010ffff]+")
#: Lower-cases A-Z and turns what is no letter (or other than ASCII) into a blank.
_FOLD = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or 97 <= c <= 122 else 32 for c in range(256))


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        x = int(d) * (1 + i % 2)
        total += x - 9 if x > 9 else x
    return total % 10 == 0


def emails(text: str) -> list[tuple[int, int]]:
    """Leftmost matches, from each "@" outwards: no work is done twice on long runs."""
    out, done, at = [], 0, text.find("@")
    while at >= 0:
        start = done + len(text[done:at].rstrip(_LOCAL))
        m = _DOMAIN.match(text, at + 1) if start < at else None
        done = at + 1
        if m:
            out.append((start, m.end()))
            done = m.end()
        at = text.find("@", done)
    return out


def ips(text: str) -> list[tuple[int, int]]:
    """Each four successive numbers of a dotted run are a match; those with a part over 255 are dropped."""
    out = []
    for m in _DOTTED.finditer(text):
        if m[0].count(".") < 3:
            continue
        parts, at = m[0].split("."), m.start()
        for i in range(0, len(parts) - 3, 4):
            four = parts[i : i + 4]
            size = sum(map(len, four)) + 3
            if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in four):
                out.append((at, at + size))
            at += size + 1
    return out


def cards(text: str) -> list[tuple[int, int]]:
    out = []
    for m in _CARD.finditer(text):
        if 13 <= m.end() - m.start() <= 40:
            d = _NOT_DIGIT.sub("", m[0])
            if 13 <= len(d) <= 19 and luhn(d):
                out.append(m.span())
    return out


def phones(text: str) -> list[tuple[int, int]]:
    return [m.span() for m in _PHONE.finditer(text) if 9 <= len(_NOT_DIGIT.sub("", m[0])) <= 15]


def entities(text: str) -> list[list[tuple[int, int]]]:
    """Spans of each kind, in order."""
    return [emails(text) if "@" in text else [], ips(text), cards(text), phones(text) if "+" in text else []]


def near_terms(text: str, found: list[list[tuple[int, int]]]) -> list[tuple[int, int, int]]:
    """(kind, start, end) of the terms near each entity that touch no entity."""
    taken = sorted(s for kind in found for s in kind)
    starts = np.array([a for a, _ in taken])
    ends = np.maximum.accumulate([b for _, b in taken]) if taken else starts
    out = set()
    for kind, spans in enumerate(found):
        for a, b in spans:
            low, high = max(0, a - NEAR_CHARS), min(len(text), b + NEAR_CHARS)
            before = [m.span() for m in _TERM.finditer(text, low, a) if m.start() > low or low == 0][-NEAR_WORDS:]
            after = [m.span() for m in _TERM.finditer(text, b, high) if m.end() < high or high == len(text)][:NEAR_WORDS]
            for s, e in before + after:
                i = int(np.searchsorted(starts, e)) - 1
                if i < 0 or ends[i] <= s:
                    out.add((kind, s, e))
    return sorted(out)


def term_hashes(terms: list[str]) -> list[int]:
    return word_hashes([t.encode("utf-8", "surrogatepass").lower() for t in terms]).view(np.int64).tolist()


_NEAR = pa.list_(pa.struct([("term", pa.int64()), ("kind", pa.int32()), ("s", pa.int64()), ("e", pa.int64())]))


def scan(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """doc_id, row (hash of id and text), counts by kind, base digest, base spans and near terms."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            counts, bases, nears = [], [], []
            for t in b.column("text"):
                text = t.as_py()
                found = entities(text)
                counts.append([len(x) for x in found])
                bases.append(",".join(f"{KINDS[k]}:{s}:{e}" for k, spans in enumerate(found) for s, e in spans))
                near = near_terms(text, found) if bases[-1] else []
                nears.append([{"term": h, "kind": k, "s": s, "e": e} for h, (k, s, e) in zip(term_hashes([text[s:e] for _, s, e in near]), near, strict=True)])
            cols = [pa.array([c[k] for c in counts], pa.int64()) for k in range(4)]
            sha = pa.array([hashlib.sha256(x.encode()).hexdigest() for x in bases], pa.string())
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("row"), *cols, sha, pa.array(bases, pa.string()), pa.array(nears, _NEAR)], names=["doc_id", "row", *(f"n_{k}" for k in KINDS), "base_sha256", "base", "near"])

    rows = small_batches(docs).select(F.col(id_col).alias("doc_id"), F.xxhash64(id_col, text_col).alias("row"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(run, f"doc_id {kind}, row long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, base string, near array<struct<term:long,kind:int,s:long,e:long>>")


def disclosing(docs: DataFrame, scanned: DataFrame, text_col: str = "text", prior: float = PRIOR, generalise: float = GENERALISE, remove: float = REMOVE) -> DataFrame:
    """term (hash), kind, action (1 generalise, 2 remove) of the terms that disclose a kind, from the whole corpus."""
    near = scanned.filter(F.size("near") > 0).select(F.explode("near").alias("x")).groupBy("x.term", "x.kind").agg(F.count("*").alias("n"))
    near = written(near, "near")
    held = docs.sparkSession.sparkContext.broadcast(bit_field(near.select("term").distinct(), "term"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f, words = held.value, 0
        for b in batches:
            terms: list[np.ndarray] = []
            for t in b.column(0):
                w = word_hashes(t.as_py().translate(_FOLD).split())
                words += len(w)
                terms.append(w[hits(f, w.view(np.int64))])
            u, n = np.unique(np.concatenate(terms) if terms else np.empty(0, np.uint64), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(u.view(np.int64)), pa.array(n, pa.int64())], names=["term", "n"])
        yield pa.RecordBatch.from_arrays([pa.nulls(1, pa.int64()), pa.array([words])], names=["term", "n"])

    texts = docs.select(F.coalesce(F.col(text_col), F.lit("")).cast("binary"))
    totals = written(texts.mapInArrow(count, "term long, n long").groupBy("term").agg(F.sum("n").alias("all")), "totals")
    words = totals.filter("term is null").select(F.col("all").alias("words"))
    kinds = near.groupBy("kind").agg(F.sum("n").alias("kind_n")).crossJoin(words)  # a row for each kind
    p_kind = F.col("kind_n") / F.greatest(F.col("words"), F.col("kind_n"))
    kinds = F.broadcast(kinds.select("kind", p_kind.alias("p")))
    told = near.join(totals, "term").join(kinds, "kind")
    given = (F.col("n") + prior * F.col("p")) / (F.greatest("all", "n") + prior)
    share = F.log2(given / F.col("p")) / F.greatest(-F.log2("p"), F.lit(1e-9))
    return told.select("term", "kind", F.when(share >= remove, 2).when(share >= generalise, 1).alias("action")).filter("action is not null")


def find_personal(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **limits) -> DataFrame:
    """doc_id, row, n_email, n_ip, n_card, n_phone, base_sha256, spans, terms for each row of ``docs``.

    terms: (s, e, kind, action) of disclosing terms near an entity of the document. A null text is an
    empty one; texts are taken whole, however long. Base spans always stay; a document without them gets
    no terms. Repeated rows give a row each, an empty table none. Other columns aren't read. Texts are
    read twice; what is shuffled is near terms and counts.
    """
    found = written(scan(docs, id_col, text_col), "entities")
    tell = written(disclosing(docs, found, text_col, **limits), "tell")
    near = found.filter(F.size("near") > 0).select("row", F.explode("near").alias("x")).select("row", "x.*")
    if tell.count() <= BROADCAST_ROWS:
        both = near.join(F.broadcast(tell), ["term", "kind"])
    else:  # a usual word may lie near millions of addresses
        salt = F.pmod(F.xxhash64("row", "s"), F.lit(SALTS)).cast("int")
        both = near.withColumn("salt", salt).join(tell.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))), ["term", "kind", "salt"])
    told = both.groupBy("row", "s", "e").agg(F.max(F.struct("action", "kind")).alias("a"))
    told = told.groupBy("row").agg(F.array_sort(F.collect_list(F.struct("s", "e", "a.kind", "a.action"))).alias("terms"))
    out = found.drop("near").join(told, "row", "left")
    named = F.transform("terms", lambda t: F.concat_ws(":", F.lit("term"), t.s.cast("string"), t.e.cast("string")))
    spans = F.concat_ws(",", F.when(F.col("base") != "", F.col("base")), F.when(F.size("terms") > 0, F.concat_ws(",", named)))
    return out.select("doc_id", "row", *(f"n_{k}" for k in KINDS), "base_sha256", spans.alias("spans"), "terms")


def clean(text: str, spans: str, terms: list[dict]) -> str:
    """The text with entities replaced by their kind, and terms generalised or removed. Overlapping entities merge."""
    marks = []
    for x in spans.split(",") if spans else []:
        kind, s, e = x.split(":")
        if kind != "term":
            marks.append((int(s), int(e), f"<{kind.upper()}>"))
    marks += [(t["s"], t["e"], "" if t["action"] == 2 else f"<{KINDS[t['kind']].upper()}-TERM>") for t in terms or []]
    out, at = [], 0
    for s, e, mark in sorted(marks):
        if s >= at:
            out += [text[at:s], mark]
        at = max(at, e)
    return "".join([*out, text[at:]])


def sanitise(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **limits) -> DataFrame:
    """Every column of ``docs``, with the text sanitised.

    A null text stays null, an empty one empty; texts are taken whole. Repeated rows give a row each, an
    empty table none. Other columns pass as they are, whatever their names.
    """
    found = find_personal(docs, id_col, text_col, **limits).filter("spans <> ''").select(F.col("row").alias("__row"), F.col("spans").alias("__spans"), F.col("terms").alias("__terms")).dropDuplicates(["__row"])
    both = docs.withColumn("__row", F.xxhash64(id_col, text_col)).join(found, "__row", "left").drop("__row")
    keep = docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at = b.schema.names.index(text_col)
            texts = [t if t is None or not s else clean(t, s, x) for t, s, x in zip(b.column(at).to_pylist(), b.column("__spans").to_pylist(), b.column("__terms").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_pydict({n: pa.array(texts, pa.string()) if n == text_col else b.column(n) for n in keep})

    return both.mapInArrow(run, docs.schema)


def op5_pii(spark, sf_dir: str) -> DataFrame:
    found = find_personal(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return found.select("doc_id", *(f"n_{k}" for k in KINDS), "base_sha256", "spans")
