"""Exact top-k inner products by no-random-access aggregation.

Each dimension of a block of candidates is a sorted list. For a query, a list is read from its top
where the query's component is positive and from its end where it is negative. Lists are read in
rounds, each to a greater depth. What was read of a candidate gives its lower and upper bound: the
rest of its components lie between the last value read and the list's far end. The floor is the k-th
best lower bound of the block, or the k-th best score of the blocks before. After each round the
outsiders, with an upper bound under the floor, are dropped, and the next round looks at those left
alone. When few are left, or the lists are read through, their final scores are resolved.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessella.llm.common import small_batches

#: Bytes of query vectors that one scan of the candidates takes (collected as Arrow, then broadcast).
QUERY_BYTES = 32_000_000
#: Candidates in a block, queries whose first bounds are matrix products together, and depths to which lists are read.
BLOCK_ROWS = 4096
QUERY_ROWS = 256
DEPTHS = (0.4, 0.55, 0.65, 0.75, 0.85, 0.92, 0.97)
#: Sums of products below this are exact in doubles.
EXACT = 2.0**53


def usable(vec: str) -> F.Column:
    """The vector has at least one component, none null or non-finite."""
    x = F.col(vec)
    bad = F.exists(x, lambda v: v.isNull() | F.isnan(v) | v.isin(float("inf"), float("-inf")))
    return x.isNotNull() & (F.size(x) > 0) & ~F.coalesce(bad, F.lit(False))


def _exact(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Integer inner products (Python integers where a double isn't exact; beyond a long: its limits)."""
    if np.abs(q).max(initial=0) * np.abs(x).max(initial=0) * q.shape[-1] < EXACT:
        return (q @ x.T).astype(np.int64)
    ints = np.array([[sum(int(a) * int(b) for a, b in zip(r, c, strict=True)) for c in x] for r in q], object)
    return np.clip(ints, -(1 << 63), (1 << 63) - 1).astype(np.int64)


class Best:
    """The k best (score, vec_id) for each of some queries."""

    def __init__(self, n: int, k: int):
        self.k = k
        self.score = np.full((n, k), np.iinfo(np.int64).min)
        self.vec = np.full((n, k), np.iinfo(np.int64).max)
        self.full = np.zeros(n, np.int64)

    def floor(self) -> np.ndarray:
        """Score under which nothing qualifies any more, for each query."""
        return np.where(self.full >= self.k, self.score[:, -1], -np.inf)

    def take(self, i: int, score: np.ndarray, vec: np.ndarray) -> None:
        n = self.full[i]
        s, v = np.concatenate((self.score[i, :n], score)), np.concatenate((self.vec[i, :n], vec))
        order = np.lexsort((v, -s.astype(object) if s.size and s.min() == np.iinfo(np.int64).min else -s))[: self.k]
        m = len(order)
        self.score[i, :m], self.vec[i, :m], self.full[i] = s[order], v[order], m


class Lists:
    """A block's candidates (rows of whole numbers held as doubles) as one sorted list for each dimension."""

    def __init__(self, x: np.ndarray):
        self.x, self.n = x, len(x)
        order = np.argsort(x, axis=0, kind="stable")
        self.sorted = np.take_along_axis(x, order, axis=0)
        self.rank = np.empty(x.shape, np.int32)
        np.put_along_axis(self.rank, order, np.arange(self.n, dtype=np.int32)[:, None], axis=0)

    def many(self, q: np.ndarray, d: int) -> tuple[np.ndarray, np.ndarray]:
        """Lower and upper bounds of all candidates (columns) for all queries (rows), each list read to depth d."""
        up, down = np.maximum(q, 0), np.minimum(q, 0)
        top, end = self.rank >= self.n - d, self.rank < d
        high = up @ np.where(top, self.x, self.sorted[self.n - d]).T + down @ np.where(end, self.x, self.sorted[d - 1]).T
        low = up @ np.where(top, self.x, self.sorted[0]).T + down @ np.where(end, self.x, self.sorted[-1]).T
        return low, high

    def some(self, q: np.ndarray, rows: np.ndarray, d: int) -> tuple[np.ndarray, np.ndarray]:
        """The same of some candidates for one query."""
        rank, plus = self.rank[rows], q > 0
        unread = np.where(plus, rank < self.n - d, rank >= d)
        partial = np.where(unread, 0.0, self.x[rows]) @ q
        last, far = np.where(plus, self.sorted[self.n - d], self.sorted[d - 1]), np.where(plus, self.sorted[0], self.sorted[-1])
        rest = unread @ np.stack((q * far, q * last), axis=1)
        return partial + rest[:, 0], partial + rest[:, 1]


def _kth(x: np.ndarray, k: int) -> float:
    return np.partition(x, len(x) - k)[len(x) - k] if len(x) >= k else -np.inf


def nra_block(q: np.ndarray, q_id: np.ndarray, x: np.ndarray, x_id: np.ndarray, best: Best) -> tuple[int, float]:
    """Take the block's candidates into ``best``. q and x: whole numbers held as doubles, one row a vector.

    Gives the number of pairs that no bound excludes, whose scores are resolved, and the mean depth of reading (a part of the lists).
    """
    lists, k = Lists(x), best.k
    depths = sorted({d for p in DEPTHS if (d := int(np.ceil(p * len(x)))) < len(x)})
    slack = np.abs(q).sum(1) * np.abs(x).max(initial=0) * 1e-9
    resolved, read = 0, 0
    floor = best.floor()
    for s in range(0, len(q), QUERY_ROWS):
        first = lists.many(q[s : s + QUERY_ROWS], depths[0]) if depths else None
        for i in range(s, min(s + QUERY_ROWS, len(q))):
            left, depth = np.flatnonzero(x_id != q_id[i]), 0
            for d in depths:
                low, high = (b[i - s, left] for b in first) if d == depths[0] else lists.some(q[i], left, d)
                floor[i] = max(floor[i], _kth(low, k) - slack[i])
                left, depth = left[high + slack[i] >= floor[i]], d
                if len(left) <= 2 * k:
                    break
            resolved += len(left)
            read += depth if len(left) <= 2 * k else len(x)
            if not len(left):
                continue
            score = _exact(q[i : i + 1], x[left])[0]
            if len(left) > 4 * k:
                keep = score >= _kth(score, k)
                left, score = left[keep], score[keep]
            best.take(i, score, x_id[left])
    return resolved, read / max(1, len(q) * len(x))


def exact_topk(vectors: DataFrame, queries: DataFrame, k: int = 10, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score: the k best candidates of each query by integer inner product.

    Component x counts as floor(1024 x). A vector that is null, empty or has a null or non-finite
    component takes no part. A query's own vec_id is no candidate of it. Vectors of another length
    than the query's aren't compared with it. Ties go to the smaller vec_id; a repeated row is a
    candidate of its own. No queries or candidates give no rows. Other columns aren't read. Queries are
    taken in parts of about QUERY_BYTES; each part reads all candidates once and gives k rows a query
    and task, merged by query.
    """
    spark = vectors.sparkSession

    def ready(df: DataFrame) -> DataFrame:
        return df.filter(usable(vec_col) & F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("id"), F.transform(vec_col, lambda v: F.floor(v.cast("double") * 1024).cast("double")).alias("x"))

    asked, rows = ready(queries), small_batches(ready(vectors))
    size = asked.agg(F.coalesce(F.sum(8 * F.size("x")), F.lit(0)).alias("b")).first().b
    parts = -(-size // QUERY_BYTES)
    schema = "query_id long, vec_id long, score long"
    found = None
    for p in range(parts):
        part = asked.filter(F.pmod(F.xxhash64("id"), F.lit(parts)) == p).toArrow()
        held = spark.sparkContext.broadcast({n: by_len for n, *by_len in _by_length(part.column("id").to_numpy(), part.column("x").combine_chunks())})

        def run(batches: Iterator[pa.RecordBatch], held=held) -> Iterator[pa.RecordBatch]:
            best = {n: Best(len(q_id), k) for n, (q_id, _) in held.value.items()}
            wait: dict[int, list] = {n: [] for n in best}

            def join(n: int) -> None:
                """What waits of one length, in blocks of BLOCK_ROWS."""
                ids, x = (np.concatenate(c) for c in zip(*wait[n], strict=True))
                wait[n].clear()
                q_id, q = held.value[n]
                for s in range(0, len(ids), BLOCK_ROWS):
                    nra_block(q, q_id, x[s : s + BLOCK_ROWS], ids[s : s + BLOCK_ROWS], best[n])

            for batch in batches:
                for n, ids, x in _by_length(batch.column("id").to_numpy(), batch.column("x")):
                    if n in wait:
                        wait[n].append((ids, x))
                        if sum(len(c[0]) for c in wait[n]) >= BLOCK_ROWS:
                            join(n)
            for n, t in best.items():
                if wait[n]:
                    join(n)
                have = np.arange(k)[None, :] < t.full[:, None]
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(held.value[n][0], t.full)), pa.array(t.vec[have]), pa.array(t.score[have])], names=["query_id", "vec_id", "score"])

        got = rows.mapInArrow(run, schema)
        found = got if found is None else found.union(got)
    if found is None:
        found = spark.createDataFrame([], schema)
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _by_length(ids: np.ndarray, x: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Length, ids and vectors (one row each) for each length among list values."""
    sizes, flat = np.diff(x.offsets.to_numpy()), x.flatten().to_numpy()
    starts = np.cumsum(sizes) - sizes
    for n in np.unique(sizes).tolist():
        pick = np.flatnonzero(sizes == n)
        yield n, ids[pick], flat[starts[pick][:, None] + np.arange(n)]


def op9_topk(spark, sf_dir: str) -> DataFrame:
    v = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return exact_topk(v, v.filter(F.col("vec_id") % 100 == 0), 10)


ORACLE = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS e
  FROM embeddings
  WHERE embedding IS NOT NULL AND vec_id IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT q.vec_id AS query_id, c.vec_id AS vec_id, CAST(list_sum(list_transform(list_zip(q.e, c.e), lambda z: z[1] * z[2])) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id AND len(q.e) = len(c.e)
  WHERE q.vec_id % 100 = 0),
r AS (SELECT query_id, vec_id, score, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 10
"""
