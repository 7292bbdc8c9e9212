"""Benchmark decontamination by Wu-Manber multi-pattern search over words.

The symbols are words. The windows of all items with the same number of words, m, share one pair of
tables: the shift table (a byte for each slot of a hash of two words) tells how far the search may move
on, and the bucket of the two words that end a window, sorted by the hash of the whole window, holds the
windows to compare directly. Tables are flat arrays over the items' text, some five times its size.
Workers build them from the items, which are broadcast in blocks of bounded size; one block holds any
usual benchmark, and of a larger one each block is searched in a pass of its own.
"""

from __future__ import annotations

import hashlib
from array import array
from bisect import bisect_left, bisect_right
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessella.llm.common import small_batches, text_bytes, written

#: Words of a window.
WINDOW = 10
#: Bytes of item text in one block: what is collected, broadcast and made into tables at once.
BLOCK_BYTES = 16_000_000
#: Lower-cases A-Z and turns what is no word character into a blank.
FOLD = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256))


def item_words(text: bytes) -> list[bytes]:
    return text.translate(FOLD).split()


class WuManber:
    """Windows of m words of ``items`` (number, words)."""

    def __init__(self, m: int, items: list[tuple[int, list[bytes]]]):
        self.m, self.block = m, min(2, m)
        self.skip = m - self.block + 1
        total = sum(len(w) for _, w in items)
        self.mask = (1 << max(10, (4 * total).bit_length())) - 1
        self.shift = bytearray([self.skip]) * (self.mask + 1)
        self.text = text = b" ".join(b" ".join(w) for _, w in items)
        first, last, suffix, whole, owner = (array("q") for _ in range(5))
        at = 0
        for k, words in items:
            ends, starts = array("q"), array("q")
            for w in words:
                starts.append(at)
                at += len(w) + 1
                ends.append(at - 1)
            for j in range(len(words) - self.block + 1):
                h = hash(text[starts[j] : ends[j + self.block - 1]])
                far = max(0, m - j - self.block)  # from here to the end of the first window that holds the block
                i = h & self.mask
                if far < self.shift[i]:
                    self.shift[i] = far
                if not far:
                    s = j + self.block - m
                    first.append(starts[s])
                    last.append(ends[s + m - 1])
                    suffix.append(h)
                    whole.append(hash(text[starts[s] : ends[s + m - 1]]))
                    owner.append(k)
        a, b, c, d, e = (np.frombuffer(x, np.int64) if len(x) else np.empty(0, np.int64) for x in (suffix, whole, owner, first, last))
        order = np.lexsort((c, b, a))
        # A window that several items share, or one item has twice, is compared once: rows of one window lie together.
        fresh = np.ones(len(order), bool)
        fresh[1:] = (a[order][1:] != a[order][:-1]) | (b[order][1:] != b[order][:-1])
        self.suffix, self.whole = array("q", a[order][fresh].tobytes()), array("q", b[order][fresh].tobytes())
        self.first, self.last = array("q", d[order][fresh].tobytes()), array("q", e[order][fresh].tobytes())
        self.edge, self.owner = array("q", np.append(np.flatnonzero(fresh), len(order)).tobytes()), array("q", c[order].tobytes())

    def search(self, words: list[bytes]) -> Iterator[tuple[int, int]]:
        """(first word, number of the window) of each occurrence."""
        m, n, mask, shift, size = self.m, len(words), self.mask, self.shift, self.block
        i = m
        while i <= n:
            b = words[i - 1] if size == 1 else words[i - 2] + b" " + words[i - 1]
            h = hash(b)
            move = shift[h & mask]
            if move:
                i += move
                continue
            low = bisect_left(self.suffix, h)
            if low < len(self.suffix) and self.suffix[low] == h:
                high = bisect_right(self.suffix, h, low)
                window = b" ".join(words[i - m : i])
                at = bisect_left(self.whole, hash(window), low, high)
                if at < high and self.text[self.first[at] : self.last[at]] == window:
                    yield i - m, at
            i += 1

    def items(self, window: int) -> list[int]:
        return self.owner[self.edge[window] : self.edge[window + 1]].tolist()


def build(items: list[tuple[object, bytes]], window: int = WINDOW) -> list[WuManber]:
    by_m: dict[int, list[tuple[int, list[bytes]]]] = defaultdict(list)
    for k, (_, text) in enumerate(items):
        words = item_words(text)
        if words:
            by_m[min(window, len(words))].append((k, words))
    return [WuManber(m, x) for m, x in sorted(by_m.items())]


def scan(words: list[bytes], tables: list[WuManber]) -> tuple[np.ndarray, set[int]]:
    """Which words are hit, and the numbers of the items that occur."""
    edge = np.zeros(len(words) + 1, np.int64)
    found: set[int] = set()
    for t in tables:
        windows = set()
        for at, window in t.search(words):
            edge[at] += 1
            edge[at + t.m] -= 1
            windows.add(window)
        for x in windows:
            found.update(t.items(x))
    return np.cumsum(edge[:-1]) > 0 if found else np.zeros(len(words), bool), found


#: The tables that a worker built last, and of which broadcast block: the next task finds them.
_BUILT: dict[str, list[WuManber]] = {}


def tables_of(name: str, items: list[tuple[str, bytes]]) -> list[WuManber]:
    if name not in _BUILT:
        _BUILT.clear()
        _BUILT[name] = build(items)
    return _BUILT[name]


class Items:
    """A benchmark in blocks of about BLOCK_BYTES, dealt by a hash of the text."""

    def __init__(self, benchmark: DataFrame, id_col: str, text_col: str):
        item = F.coalesce(F.col(id_col).cast("string"), F.lit("null"))
        self.rows = benchmark.select(item.alias("item"), text_bytes(text_col).alias("text")).filter(F.octet_length("text") > 0)
        total = self.rows.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("b")).first().b
        self.blocks = max(1, -(-total // BLOCK_BYTES))

    def block(self, k: int) -> list[tuple[str, bytes]]:
        of = F.pmod(F.xxhash64("text"), F.lit(self.blocks)) == k
        got = self.rows.filter(of).toArrow()
        return list(zip(got.column("item").to_pylist(), got.column("text").to_pylist(), strict=True))


NEW = ["n_words", "n_hit", "n_items", "items_sha256", "contaminated", "hits"]


def decontaminate(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """Every column of ``docs``, with the columns n_words, n_hit, n_items, items_sha256, contaminated and hits.

    hits holds the ids (as strings) of the items with an occurring window, sorted. A null or empty
    text has no words and isn't contaminated; the digest of no items is that of the empty string.
    Items without words have no window; a null item id counts as the text "null"; items of one id count
    once. Texts are searched whole, however long. Repeated documents get a row each. An empty table of
    documents gives no rows, an empty benchmark no hits. Columns of ``docs`` with the names above are
    replaced, others pass. One block of items takes one scan without a shuffle. Of a larger benchmark
    one block at a time is on the driver and in memory; the documents are stored once with a row
    number, each block adds a scan, and hits alone are shuffled by it before they join the documents.
    """
    spark = small_batches(docs).sparkSession
    keep = [c for c in docs.columns if c not in NEW]
    items = Items(benchmark, item_col, item_text_col)
    out = docs.select(*keep).schema.add("n_words", "long").add("n_hit", "long").add("n_items", "long").add("items_sha256", "string").add("contaminated", "boolean").add("hits", T.ArrayType(T.StringType()))
    work = docs.select(*keep, text_bytes(text_col).alias("__text"))

    def digests(n_words: list[int], n_hit: list[int], hits: list[list[str]]) -> dict[str, pa.Array]:
        sha = [hashlib.sha256(",".join(x).encode()).hexdigest() for x in hits]
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.bool_(), pa.list_(pa.string()))
        return {c: pa.array(x, k) for c, x, k in zip(NEW, (n_words, n_hit, [len(x) for x in hits], sha, [x > 0 for x in n_hit], hits), kinds, strict=True)}

    if items.blocks == 1:
        held, name = spark.sparkContext.broadcast(items.block(0)), _block_key()

        def once(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            tables, names = tables_of(name, held.value), held.value
            for b in batches:
                n_words, n_hit, hits = [], [], []
                for text in b.column("__text"):
                    words = item_words(text.as_py())
                    hit, found = scan(words, tables)
                    n_words.append(len(words))
                    n_hit.append(int(hit.sum()))
                    hits.append(sorted({names[k][0] for k in found}))
                yield pa.RecordBatch.from_pydict({n: b.column(n) for n in keep} | digests(n_words, n_hit, hits))

        return work.mapInArrow(once, out)

    work = written(work.withColumn("__row", F.monotonically_increasing_id()), "documents")
    parts = []
    for k in range(items.blocks):
        held, name = spark.sparkContext.broadcast(items.block(k)), _block_key()

        def some(batches: Iterator[pa.RecordBatch], held=held, name=name) -> Iterator[pa.RecordBatch]:
            tables, names = tables_of(name, held.value), held.value
            for b in batches:
                rows: list[tuple] = []
                for row, text in zip(b.column("__row").to_pylist(), b.column("__text"), strict=True):
                    hit, found = scan(item_words(text.as_py()), tables)
                    if found:
                        rows.append((row, np.packbits(hit).tobytes(), sorted({names[k][0] for k in found})))
                cols = [pa.array([r[i] for r in rows], kind) for i, kind in enumerate((pa.int64(), pa.binary(), pa.list_(pa.string())))]
                yield pa.RecordBatch.from_arrays(cols, names=["__row", "mask", "items"])

        parts.append(written(work.select("__row", "__text").mapInArrow(some, "__row long, mask binary, items array<string>"), "hits"))
        held.destroy()
    found = parts[0]
    for p in parts[1:]:
        found = found.union(p)
    found = found.groupBy("__row").agg(F.collect_list("mask").alias("__masks"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("__items"))  # an entry for each block
    both = work.join(found, "__row", "left").select(*keep, "__text", "__masks", "__items")

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n_words, n_hit = [], []
            for text, masks in zip(b.column("__text"), b.column("__masks").to_pylist(), strict=True):
                n_words.append(len(item_words(text.as_py())))
                bits = np.bitwise_or.reduce([np.frombuffer(m, np.uint8) for m in masks]) if masks else np.empty(0, np.uint8)
                n_hit.append(int(np.unpackbits(bits).sum()))
            yield pa.RecordBatch.from_pydict({n: b.column(n) for n in keep} | digests(n_words, n_hit, [x or [] for x in b.column("__items").to_pylist()]))

    return both.mapInArrow(merge, out)


def _block_key() -> str:
    import uuid

    return uuid.uuid4().hex


def op3_decontaminate(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    found = decontaminate(docs.select("doc_id", "text"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return found.select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")


ORACLE = r"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM documents),
b AS (
  SELECT item_id,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM benchmark),
win AS (
  SELECT DISTINCT item_id, least(10, len(w)) AS m, array_to_string(w[i:i + least(10, len(w)) - 1], ' ') AS s
  FROM (SELECT item_id, w, unnest(range(1, len(w) - least(10, len(w)) + 2)) AS i FROM b WHERE len(w) > 0)),
lens AS (SELECT DISTINCT m FROM win),
dw AS (
  SELECT r, m, i, array_to_string(w[i:i + m - 1], ' ') AS s
  FROM (SELECT r, w, m, unnest(range(1, len(w) - m + 2)) AS i FROM d, lens WHERE len(w) >= m)),
occ AS (SELECT r, dw.m, i, item_id FROM dw JOIN win ON dw.m = win.m AND dw.s = win.s),
hit AS (SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT r, unnest(range(i, i + m)) AS p FROM (SELECT DISTINCT r, i, m FROM occ)) GROUP BY r),
its AS (SELECT r, count(*) AS n_items, string_agg(k, ',' ORDER BY k) AS k FROM (SELECT DISTINCT r, CAST(item_id AS VARCHAR) AS k FROM occ) GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
       CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(k, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN hit ON d.r = hit.r LEFT JOIN its ON d.r = its.r
"""
