"""Quality by importance resampling.

Two generative models over hashed word n-grams (words and pairs of words): one of the target, texts
labelled good and not toxic, and one of the raw corpus. A document's log importance is the log ratio
of its likelihoods. Rows are sampled without replacement in proportion to importance by Gumbel top-k:
the k largest of log importance plus standard Gumbel noise, drawn from a hash of the row.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.llm.common import mix64, placed, slices, small_batches, text_bytes, with_rank, word_hashes, written

#: Hash table of n-grams; bounds both models.
FEATURES = 1 << 17
#: Labelled target rows to learn from, about: a sample by hash of the id where there are more.
TARGET_ROWS = 20_000
#: Counts added to what a feature has in the target and to what the raw corpus leads to expect there:
#: rare n-grams say little, whether or not a labelled text has them.
PRIOR = 10.0
#: Bytes of text whose words are hashed at once, about.
SLICE = 1_000_000
#: Rows sampled, of all rows.
SHARE = 0.8


def ngrams(texts: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(feature, place of the text) of the words and pairs of words of the texts (bytes), a bounded number at once, texts in order."""
    before: tuple[int, np.uint64] | None = None  # the last word, of a text that comes in parts
    for part, places in slices(texts, SLICE):
        words = [t.lower().split() for t in part.to_pylist()]
        h = word_hashes([w for ws in words for w in ws])
        doc = np.repeat(np.array(places, np.int64), [len(ws) for ws in words])
        features, docs = [mix64(h)], [doc]
        if before and len(h) and before[0] == doc[0]:
            h, doc = np.concatenate(([before[1]], h)), np.concatenate(([before[0]], doc))
        same = doc[1:] == doc[:-1]
        features.append(mix64(h[:-1] * np.uint64(0x9E3779B97F4A7C15) + h[1:])[same])
        docs.append(doc[1:][same])
        if len(h):
            before = int(doc[-1]), h[-1]
        yield (np.concatenate(features) & np.uint64(FEATURES - 1)).astype(np.int64), np.concatenate(docs)


def log_ratios(docs: DataFrame, target_ids: list, id_col: str = "doc_id", text_col: str = "text") -> np.ndarray:
    """log p_target - log p_raw by feature. Raw counts are over all rows; target counts over the rows of ``target_ids``."""
    held = small_batches(docs).sparkSession.sparkContext.broadcast(frozenset(target_ids))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, total = held.value, np.zeros((2, FEATURES), np.int64)
        for b in batches:
            wanted = np.array([k in ids for k in b.column("id").to_pylist()], bool)
            for f, doc in ngrams(b.column("text")):
                total[0] += np.bincount(f, minlength=FEATURES)
                if (use := wanted[doc]).any():
                    total[1] += np.bincount(f[use], minlength=FEATURES)
        f = np.flatnonzero(total[0])
        yield pa.RecordBatch.from_arrays([pa.array(f.astype(np.int32)), pa.array(total[0, f]), pa.array(total[1, f])], names=["feature", "raw", "target"])

    rows = docs.select(F.col(id_col).alias("id"), text_bytes(text_col).alias("text"))
    got = rows.mapInArrow(count, "feature int, raw long, target long").groupBy("feature").agg(F.sum("raw").alias("raw"), F.sum("target").alias("target")).toArrow()
    raw, target = np.zeros(FEATURES), np.zeros(FEATURES)
    raw[got.column("feature").to_numpy()] = got.column("raw").to_numpy()
    target[got.column("feature").to_numpy()] = got.column("target").to_numpy()
    expected = raw * (target.sum() / max(1.0, raw.sum()))
    return np.log(target + PRIOR) - np.log(expected + PRIOR)


def resample(docs: DataFrame, labels: DataFrame, share: float = SHARE, target_rows: int = TARGET_ROWS, seed: int = 7, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, log_importance, rank of the sampled rows, rank from 0 by the noisy key.

    k is ``share`` of all rows. Texts are taken whole, however long. The target is what is labelled good: quality 1 and not toxic. Without
    labels all rows weigh the same. A document with conflicting labels isn't a target. A null or
    empty text has log importance 0. Equal keys are ordered by id and a hash of the text; repeated rows
    draw the same noise and count each. Labels of ids that ``docs`` lacks teach nothing. An empty table
    gives no rows.
    """
    spark = docs.sparkSession
    good = labels.filter(F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.min(F.coalesce((F.col("quality") == 1) & (F.coalesce("toxic", F.lit(0)) == 0), F.lit(False))).alias("good"))
    ids = good.filter("good")
    n = ids.count()
    if n > target_rows:
        ids = ids.filter(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) < int((1 << 30) * target_rows / n))
    ratio = spark.sparkContext.broadcast(log_ratios(docs, [r.doc_id for r in ids.select("doc_id").collect()], id_col, text_col))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        r = ratio.value
        for b in batches:
            w = np.zeros(len(b))
            for f, doc in ngrams(b.column("text")):
                w += np.bincount(doc, r[f], len(b))
            u = (mix64(b.column("row").to_numpy().view(np.uint64)) >> np.uint64(11)).astype(np.float64) * 2.0**-53 + 2.0**-54
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("row"), pa.array(w), pa.array(w - np.log(-np.log(u)))], names=["doc_id", "row", "log_importance", "key"])

    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(F.lit(seed), id_col, text_col).alias("row"), text_bytes(text_col).alias("text"))
    scored = rows.mapInArrow(score, f"doc_id {kind}, row long, log_importance double, key double")
    scored = written(scored.withColumn("number", F.monotonically_increasing_id()), "scored")
    # Repeated rows have one key and one row hash: their number in the table tells them apart.
    rows = placed(scored, F.desc("key"), F.col("doc_id"), F.col("row"), F.col("number"))
    total = int(round(share * rows.count()))
    return with_rank(rows).filter(F.col("rank") < total).select("doc_id", "log_importance", "rank")


def op2_quality(spark, sf_dir: str) -> DataFrame:
    return resample(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
