"""Whole results of operators against brute-force versions on small fixtures."""

from collections import Counter

import numpy as np
from pyspark.sql import functions as F
from test_operators import features_of

import __spark_entry__ as entry
from tessella.llm import quality as QU
from tessella.llm import topk as TK


def test_sql_that_checks_is_sql():
    assert all(isinstance(v, str) for v in entry.oracle_sql().values())


def test_quality_against_brute_force(spark, tmp_path):
    rng = np.random.default_rng(3)
    docs = [(i, " ".join(f"w{x}" for x in rng.integers(0, 12 + i % 9, 5 + i % 13))) for i in range(61)] + [(61, None), (62, ""), (7, "w1 w2 w3"), (8, "one more of id 8")]
    labels = [(i, int(i % 3 > 0), int(i % 10 == 1)) for i in range(0, 61, 2)] + [(4, 0, 0), (99, 1, 0), (None, 1, 0), (10, 1, None), (12, None, 0)]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    df.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")

    said: dict = {}
    for k, q, t in labels:
        said.setdefault(k, []).append(q == 1 and (t or 0) == 0)
    good = {k for k, v in said.items() if k is not None and all(v)}
    raw, target = Counter(), Counter()
    for k, text in docs:
        for f in features_of((text or "").encode()):
            raw[f] += 1
            target[f] += k in good
    share = sum(target.values()) / sum(raw.values())
    want = []
    for r in df.select("doc_id", "text", F.xxhash64(F.lit(7), "doc_id", "text").alias("row")).collect():
        w = sum(np.log(target[f] + QU.PRIOR) - np.log(raw[f] * share + QU.PRIOR) for f in features_of((r.text or "").encode()))
        x, m = r.row % 2**64, 2**64
        x ^= x >> 30
        x = x * 0xBF58476D1CE4E5B9 % m
        x ^= x >> 27
        x = x * 0x94D049BB133111EB % m
        x ^= x >> 31
        u = (x >> 11) * 2.0**-53 + 2.0**-54
        want.append((-(w - np.log(-np.log(u))), r.doc_id, r.row, w))
    want = sorted(want)[: round(0.8 * len(docs))]

    got = entry.queries()["op2_quality"](spark, str(tmp_path)).orderBy("rank").collect()
    assert [r["rank"] for r in got] == list(range(len(want))) and [r.doc_id for r in got] == [k for _, k, _, _ in want]
    assert np.allclose([r.log_importance for r in got], [w for *_, w in want], atol=1e-9)


def test_nra_excludes_outsiders():
    """Random vectors are the hard case: most pairs are excluded by bounds before lists are read through, and scores equal brute force."""
    rng = np.random.default_rng(5)
    x, ids = np.floor(rng.normal(size=(6000, 64)) * 1024), np.arange(6000)
    q, q_id = x[:15], ids[:15]
    best, left, depth = TK.Best(len(q), 10), [], []
    for s in range(0, 6000, 2000):
        n, d = TK.nra_block(q, q_id, x[s : s + 2000], ids[s : s + 2000], best)
        left.append(n / (len(q) * 2000))
        depth.append(d)
    assert max(left) < 0.1 and left[2] < 0.02 and depth[2] < 0.95
    score = q @ x.T
    score[q_id, q_id] = -np.inf
    for i in range(len(q)):
        want = sorted(range(len(x)), key=lambda j: (-score[i, j], j))[:10]
        assert best.vec[i].tolist() == want and best.score[i].tolist() == score[i, want].tolist()


def test_nra_stops_early_where_scores_differ():
    """Vectors with few large components: lists are read to a small part."""
    rng = np.random.default_rng(6)
    x = np.floor(rng.exponential(size=(4000, 4)) ** 3 * 1024)
    q, ids = np.array([[900.0, 0, 10, 2]]), np.arange(4000)
    best = TK.Best(1, 10)
    n, depth = TK.nra_block(q, np.array([-1]), x, ids, best)
    assert n <= 400 and depth <= 0.4
    assert best.vec[0].tolist() == sorted(range(4000), key=lambda j: (-(q[0] @ x[j]), j))[:10]
