"""Language identification: multinomial naive Bayes over hashed character n-grams.

A text becomes lower-case code points, with every run of what isn't a letter as one blank. Its 1- to
3-grams are hashed to a table of counters, and a language's score is the sum of log probabilities of the
text's n-grams. The matrix of log probabilities (features x languages) is broadcast. Texts are hashed
and scored many at once in numpy, as rows of (text, feature) in pieces of bounded size; a long text is
read in parts that carry on from each other, so that each n-gram counts once wherever it is cut.
"""

from __future__ import annotations

import sys
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.llm.common import release, small_batches, text_bytes

#: Most and fewest counters of n-grams, and most cells of the model (counters x languages) where the fewest allow.
FEATURES, LEAST_FEATURES, CELLS = 1 << 16, 1 << 10, 1 << 24
GRAMS = (1, 2, 3)
#: Labelled rows to learn from, about, where there are more. Bounds the number of languages too.
TRAIN_ROWS = 20_000
#: Code points hashed at once, and cells scored at once.
PIECE = 1 << 19
SCORED = 1 << 21
UNKNOWN = "und"


@lru_cache(maxsize=1)
def letters() -> np.ndarray:
    """For each code point: its lower case if it's a letter (or a mark inside words), else 0."""
    table = np.zeros(sys.maxunicode + 1, np.uint32)
    for c in range(sys.maxunicode + 1):
        k = unicodedata.category(chr(c))
        if k[0] in "LM":
            low = chr(c).lower()
            table[c] = ord(low[0]) if low else c
    return table


@lru_cache(maxsize=1)
def _is_letter() -> np.ndarray:
    """True for code points of category L; marks alone are no letter."""
    return np.fromiter((unicodedata.category(chr(c))[0] == "L" for c in range(sys.maxunicode + 1)), bool, sys.maxunicode + 1)


def grams(c: np.ndarray, doc: np.ndarray, fresh: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(feature, text) of the n-grams that lie in one text and end in a fresh place; blanks alone are none."""
    features, docs = [], []
    for n in GRAMS:
        k = len(c) - n + 1
        if k < 1:
            break
        h = np.full(k, 0x51ED270B * n & 0xFFFFFFFF, np.uint32)
        for i, a in zip(range(n), (0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D), strict=False):
            h += c[i : i + k] * np.uint32(a)
        h ^= h >> np.uint32(15)
        h *= np.uint32(0x2C1B3C6D)
        h ^= h >> np.uint32(16)
        use = fresh[n - 1 :] & (doc[:k] == doc[n - 1 :])
        if n == 1:
            use &= c != 0
        features.append((h[use] & np.uint32(size - 1)).astype(np.int32))
        docs.append(doc[:k][use])
    return np.concatenate(features), np.concatenate(docs)


def folded(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Code points in lower case, 0 for what isn't a letter; and those that are letters."""
    raw = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    return letters()[raw], _is_letter()[raw]


def runs(texts: list[bytes | None], size: int = FEATURES) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(features, texts of the features, texts with a letter) of all n-grams of the texts, a bounded number at once."""
    wait: list[str] = []
    places: list[int] = []
    held = 0

    def give() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        lens = np.fromiter(map(len, wait), np.int64, len(wait)) + 2  # a blank at both ends
        c, letter = folded("\0" + "\0\0".join(wait) + "\0")
        doc = np.repeat(np.array(places, np.int32), lens)
        keep = np.ones(len(c), bool)
        keep[1:] = (c[1:] != 0) | (c[:-1] != 0) | (doc[1:] != doc[:-1])
        return *grams(c[keep], doc[keep], np.ones(int(keep.sum()), bool), size), np.unique(doc[letter])

    for i, t in enumerate(texts):
        text = (t or b"").decode("utf-8", "replace")
        if len(text) > PIECE:
            yield from _long(text, i, size)
            continue
        wait.append(text)
        places.append(i)
        held += len(text) + 2
        if held > PIECE:
            yield give()
            wait, places, held = [], [], 0
    if wait:
        yield give()


def _long(text: str, place: int, size: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """The same of one text, part by part: the last code points of a part begin the next, but n-grams that end in them count once."""
    last = np.empty(0, np.uint32)
    for s in range(0, len(text), PIECE):
        c, letter = folded(text[s : s + PIECE])
        c = np.concatenate((np.zeros(int(s == 0), np.uint32), c, np.zeros(int(s + PIECE >= len(text)), np.uint32)))
        before = np.concatenate((last[-1:], c[:-1])) if len(last) else np.concatenate((np.ones(1, np.uint32), c[:-1]))
        c = c[(c != 0) | (before != 0)]
        both = np.concatenate((last, c))
        fresh = np.arange(len(both)) >= len(last)
        yield *grams(both, np.full(len(both), place, np.int32), fresh, size), np.full(int(letter.any()), place, np.int32)
        last = both[-2:]


class Model:
    """languages, and log probabilities (features x languages) with priors."""

    def __init__(self, languages: list[str], counts: np.ndarray, docs: np.ndarray):
        self.languages = languages
        smooth = counts + 0.1
        self.log_p = np.log(smooth / smooth.sum(0)).astype(np.float32)
        self.prior = np.log(docs / docs.sum()) if len(docs) else np.empty(0)

    def predict(self, texts: list[bytes | None]) -> tuple[list[str], np.ndarray]:
        """Language and posterior probability of each text."""
        n, k = len(texts), len(self.languages)
        if not k:
            return [UNKNOWN] * n, np.zeros(n)
        total, known = np.tile(self.prior.astype(np.float64), (n, 1)), np.zeros(n, bool)
        step = max(1, SCORED // k)
        for features, docs, some in runs(texts, len(self.log_p)):
            known[some] = True
            for s in range(0, len(docs), step):
                d = docs[s : s + step]
                cut = np.flatnonzero(np.concatenate(([True], d[1:] != d[:-1])))  # texts lie together
                np.add.at(total, d[cut], np.add.reduceat(self.log_p[features[s : s + step]], cut, axis=0, dtype=np.float64))
        p = np.exp(total - total.max(axis=1, keepdims=True))
        best = p.argmax(axis=1)
        score = np.where(known, p[np.arange(n), best] / p.sum(axis=1), 0.0)
        return [self.languages[i] if said else UNKNOWN for i, said in zip(best.tolist(), known.tolist(), strict=True)], score


def train(labelled: DataFrame, rows: int = TRAIN_ROWS, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> Model:
    """Learn from about ``rows`` rows at most, taken by a hash of the id and the row's number, texts whole.

    Rows without language or text teach nothing; repeated rows count each; an empty table teaches no
    language. Other columns aren't read. There is no limit to the number of languages but the rows
    learnt from; the more there are, the fewer counters each has, so that the model stays bounded.
    Counts are added by language and feature before they reach the driver.
    """
    known = small_batches(labelled).filter(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull())
    n = known.count()
    if n > rows:
        # One id or one row may be repeated many times: the row's number tells copies apart.
        known = known.withColumn("__at", F.pmod(F.xxhash64(F.col(id_col), F.monotonically_increasing_id()), F.lit(1 << 30)))
        known = known.filter(F.col("__at") < int((1 << 30) * rows / n))
    languages = sorted(r[0] for r in known.select(lang_col).distinct().collect())  # no more than rows learnt from
    size = FEATURES
    while size > LEAST_FEATURES and size * len(languages) > CELLS:
        size //= 2

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = {x: i for i, x in enumerate(languages)}

        def rows(cell: np.ndarray, feature: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(cell, pa.int32()), pa.array(feature, pa.int32()), pa.array(n, pa.int64())], names=["lang", "feature", "n"])

        for b in batches:
            of = np.array([at[x] for x in b.column(1).to_pylist()], np.int64)
            lang, n = np.unique(of, return_counts=True)
            yield rows(lang, np.full(len(lang), size), n)
            for features, docs, _ in runs(b.column(0).to_pylist(), size):
                cell, n = np.unique(of[docs] * size + features, return_counts=True)
                yield rows(cell // size, cell % size, n)

    got = known.select(text_bytes(text_col), lang_col).mapInArrow(count, "lang int, feature int, n long").groupBy("lang", "feature").agg(F.sum("n").alias("n")).toArrow()
    counts = np.zeros((size + 1, len(languages)))
    counts[got.column("feature").to_numpy(), got.column("lang").to_numpy()] = got.column("n").to_numpy()
    return Model(languages, counts[:-1], counts[-1])


def identify(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """Every column of ``docs`` and lang_pred, lang_score (0 to 1: the posterior probability).

    Null texts and texts without a letter give ``und`` and 0. Texts are taken whole, however long. Equal
    scores go to the language that comes first by name. Repeated rows give a row each, an empty table
    none; a model without languages says ``und``. Columns of ``docs`` named lang_pred or lang_score are
    replaced, others pass.
    """
    keep = [c for c in docs.columns if c not in ("lang_pred", "lang_score")]
    held = small_batches(docs).sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = held.value
        for b in batches:
            said, score = m.predict(b.column("__text").to_pylist())
            cols = {n: b.column(n) for n in keep} | {"lang_pred": pa.array(said, pa.string()), "lang_score": pa.array(score)}
            yield pa.RecordBatch.from_pydict(cols)
        release()

    schema = docs.select(*keep).schema.add("lang_pred", "string").add("lang_score", "double")
    return docs.select(*keep, F.col(text_col).cast("binary").alias("__text")).mapInArrow(run, schema)


def fold(id_col: str = "doc_id") -> F.Column:
    """crc32 of the id as text, mod 4; a null id is in fold 0."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 4, F.lit(0))


def op10_language(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang")
    model = train(docs.filter(fold() != 2))
    said = identify(docs.select("doc_id", "text").withColumn("held_out", fold() == 2), model)
    return said.select("doc_id", "held_out", "lang_pred", F.col("lang_score").alias("score"))
