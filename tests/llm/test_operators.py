"""The training-data operators: brute force, round trips, held-out accuracy, odd and empty input."""

import json
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tessella.llm import decontaminate as DC
from tessella.llm import language as LA
from tessella.llm import main_text as MT
from tessella.llm import mixing as MX
from tessella.llm import near_dup as ND
from tessella.llm import pii
from tessella.llm import quality as QU
from tessella.llm import sharding as SH
from tessella.llm import token_file as TF
from tessella.llm import topk as TK
from tessella.llm.common import written


def docs_of(spark, data):
    return spark.read.parquet(f"{data}/documents.parquet")


# 1 sharding


def brute_capacity(weights, n):
    def need(c):
        k, u = 1, 0
        for w in weights:
            if u + w > c:
                k, u = k + 1, 0
            u += w
        return k

    c = max(max(weights), -(-sum(weights) // n))
    while need(c) > n:
        c += 1
    return c


@pytest.mark.parametrize("n", [1, 3, 8, 50])
def test_sharding_is_minimax(spark, data, n):
    docs = docs_of(spark, data)
    r = SH.minimax_shards(docs, n).toPandas()
    groups = docs.selectExpr("xxhash64(coalesce(text, '')) k", "octet_length(coalesce(text, '')) + 1 w").groupBy("k").agg(F.sum("w").alias("w")).orderBy("k").toPandas()
    assert r.groupby("shard")["size"].sum().max() == brute_capacity(groups.w.tolist(), n)
    assert r.groupby("text_crc32").shard.nunique().max() == 1
    for _, s in r.groupby("shard").slot:
        assert sorted(s) == list(range(len(s)))


def test_blocks_converge_on_random_weights():
    rng = random.Random(3)
    for _ in range(60):
        keys = sorted(rng.sample(range(-(1 << 40), 1 << 40), 200))
        w = [rng.choice((1, 5, 400)) * rng.randint(1, 9) for _ in keys]
        n = rng.randint(2, 9)
        blocks = SH.Blocks([(k, k, x, 1, x, 0) for k, x in zip(keys, w, strict=True)])
        low, high = blocks.bounds(n)
        assert low == high == brute_capacity(w, n)
        cuts = blocks.cuts(n, high)
        sums = Counter()
        for k, x in zip(keys, w, strict=True):
            sums[sum(k >= c for c in cuts)] += x
        assert max(sums.values()) <= high


@pytest.mark.parametrize("copies", [3_000, 12_000])
def test_sharding_with_one_heavy_group(spark, copies):
    """More groups than first blocks, and one text with a fifth or half of all rows."""
    rows = spark.range(12_000).select(F.col("id").alias("doc_id"), F.concat(F.lit("t"), F.col("id").cast("string")).alias("text"))
    docs = rows.union(spark.range(copies).select((F.col("id") + 20_000).alias("doc_id"), F.lit("t17").alias("text")))
    r = SH.minimax_shards(docs, 8).toPandas()
    groups = docs.selectExpr("xxhash64(text) k", "octet_length(text) + 1 w").groupBy("k").agg(F.sum("w").alias("w")).orderBy("k").toPandas()
    sums = r.groupby("shard")["size"].sum()
    assert len(r) == 12_000 + copies and len(sums) == 8 and sums.max() == brute_capacity(groups.w.tolist(), 8)
    assert r.groupby("text_crc32").shard.nunique().max() == 1 and r.doc_id.is_unique


def test_split_rounds_stay_small():
    """With a heavy group, what is asked for again stays a small part of the blocks."""
    rng = random.Random(8)
    for share in (0.05, 0.2, 0.45):
        rows, heavy = [], 4096 * 100 * share / (1 - share)
        for i in range(4096):
            w = rng.randint(80, 120)
            rows.append((i << 52, (i << 52) + 9_000, w, 10, 15, 52))
        rows[1700] = (1700 << 52, (1700 << 52) + 9_000, int(100 + heavy), 10, int(heavy), 52)
        b = SH.Blocks(rows)
        assert b.doubtful(8, *b.bounds(8)) == [1700]
        at = 1700 << 52
        b = SH.Blocks(rows[:1700] + [(at, at, 50, 1, 50, 40), (at + 1, at + 1, int(heavy), 1, int(heavy), 40), (at + 2, at + 9_000, 50, 1, 50, 40)] + rows[1701:])
        low, high = b.bounds(8)
        assert low == high or len(b.doubtful(8, low, high)) < 200


def test_sharding_of_odd_rows(spark, odd, none):
    r = SH.minimax_shards(odd, 3).toPandas()
    assert len(r) == odd.count() and r["size"].min() == 1
    assert r[r.doc_id.isin([1, 2])].shard.nunique() == 1 and r.grown_shard.isna().all()
    assert int(r[r.doc_id == 9].text_crc32.iloc[0]) == zlib.crc32(b"x")
    assert SH.minimax_shards(none, 8).count() == 0


# 2 quality


def test_importance_separates_planted_text(spark):
    rng = random.Random(1)
    good, bad = [f"g{i}" for i in range(200)], [f"b{i}" for i in range(200)]
    rows = [(i, " ".join(rng.choices(good if i % 4 else bad, k=40))) for i in range(800)]
    labels = spark.createDataFrame([(i, int(i % 4 > 0), 0) for i in range(0, 800, 3)], "doc_id long, quality int, toxic int")
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    r = QU.resample(docs, labels, 0.75).toPandas()
    assert len(r) == 600 and sorted(r["rank"]) == list(range(600)) and (r.doc_id % 4 > 0).mean() > 0.99
    assert r.equals(QU.resample(docs, labels, 0.75).toPandas())


def features_of(text):
    return [x for f, _ in QU.ngrams(pa.array([text])) for x in f.tolist()]


def test_ngrams_of_parts(monkeypatch):
    texts = pa.array([b"a b c", b"", b"d " * 60 + b"e", b"f", b"a b c"])
    want = [sorted(features_of(t)) for t in texts.to_pylist()]
    monkeypatch.setattr(QU, "SLICE", 16)
    got = [[] for _ in want]
    for f, doc in QU.ngrams(texts):
        for x, k in zip(f.tolist(), doc.tolist(), strict=True):
            got[k].append(x)
    assert [sorted(x) for x in got] == want and len(want[2]) == 121 and len(want[0]) == 5


def test_log_ratio_against_brute_force(spark):
    docs = spark.createDataFrame([(1, "a b a"), (2, "c"), (3, None)], "doc_id long, text string")
    got = QU.log_ratios(docs, [1])
    raw, target = Counter(), Counter()
    for text, t in ((b"a b a", 1), (b"c", 0)):
        for f in features_of(text):
            raw[f] += 1
            target[f] += t
    assert len(raw) == 5
    for f in raw:
        want = np.log(target[f] + QU.PRIOR) - np.log(raw[f] * sum(target.values()) / sum(raw.values()) + QU.PRIOR)
        assert abs(got[f] - want) < 1e-12


def test_quality_of_odd_rows(spark, odd, none):
    labels = spark.createDataFrame([(1, 1, None), (2, None, 1), (99, 1, 0), (None, 1, 0), (6, 0, 0)], "doc_id long, quality int, toxic int")
    assert QU.resample(odd, labels, 1.0).count() == odd.count()
    assert QU.resample(none, labels).count() == 0 and QU.resample(odd, labels.limit(0), 0.5).count() == round(odd.count() / 2)


# 3 decontamination


def brute_hits(words, items, window=10):
    hit, found = [False] * len(words), set()
    for k, text in items:
        w = re.findall(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub(rb"[A-Z]", lambda m: m[0].lower(), text))
        m = min(window, len(w))
        for i in range(len(w) - m + 1 if m else 0):
            for j in range(len(words) - m + 1):
                if words[j : j + m] == w[i : i + m]:
                    found.add(k)
                    hit[j : j + m] = [True] * m
    return hit, found


def test_wu_manber_against_brute_force():
    rng = random.Random(5)
    for _ in range(150):
        words = [rng.choice((b"a", b"b", b"c\xc3\xa9", b"7")) for _ in range(rng.randint(0, 60))]
        items = []
        for k in range(rng.randint(1, 5)):
            n = rng.choice((0, 1, 2, 5, 10, 14))
            at = rng.randint(0, max(0, len(words) - n))
            items.append((k, b"-".join(words[at : at + n] if rng.random() < 0.6 else rng.choices((b"A", b"b"), k=n))))
        hit, found = DC.scan(words, DC.build(items))
        want, ids = brute_hits(words, items)
        assert hit.tolist() == want and {items[k][0] for k in found} == ids


def test_blocks_of_items_add_up(spark, data, monkeypatch):
    docs, bench = docs_of(spark, data), spark.read.parquet(f"{data}/benchmark.parquet")
    one = DC.decontaminate(docs, bench).orderBy("doc_id").collect()
    monkeypatch.setattr(DC, "BLOCK_BYTES", 9_000)
    assert DC.Items(bench, "item_id", "text").blocks > 1
    assert DC.decontaminate(docs, bench).orderBy("doc_id").collect() == one
    assert any(r.contaminated for r in one)


def test_tables_of_many_items_are_small():
    import tracemalloc

    rng = random.Random(2)
    words = [b"w%d" % i for i in range(30_000)]
    items = [(k, b" ".join(rng.choices(words, k=100))) for k in range(1_000)]
    size = sum(len(t) for _, t in items)
    tracemalloc.start()
    tables = DC.build(items)
    kept = tracemalloc.get_traced_memory()[0]
    tracemalloc.stop()
    assert kept < 15 * size and DC.scan(DC.item_words(b"x " + items[7][1][40:200]), tables)[1] == {7}


def test_decontamination_of_odd_rows(spark, odd, none):
    bench = spark.createDataFrame([(1, "x"), (2, None), (None, "WORD"), (3, " - "), (4, "beta-gamma delta")], "item_id long, text string")
    r = {(x.doc_id, x.n_words): x for x in DC.decontaminate(odd, bench).collect()}
    assert (r[9, 1].n_hit, r[9, 1].hits) == (1, ["1"]) and (r[6, 60_000].n_hit, r[6, 60_000].hits) == (60_000, ["null"])
    assert r[1, 10].n_hit == 3 and not r[3, 0].contaminated and not r[4, 0].contaminated
    assert DC.decontaminate(odd, bench.limit(0)).filter("contaminated").count() == 0 and DC.decontaminate(none, bench).count() == 0
    assert DC.decontaminate(odd, bench).count() == odd.count()


# 4 near duplicates


def brute_components(texts, width, num, den):
    sets = []
    for t in texts:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets.append({tuple(w[i : i + width]) for i in range(max(1, len(w) - width + 1))} if w else set())
    up = list(range(len(sets)))

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for i in range(len(sets)):
        for j in range(i):
            if sets[i] and sets[j] and den * len(sets[i] & sets[j]) >= num * len(sets[i] | sets[j]):
                a, b = find(i), find(j)
                up[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(sets))]


def planted(seed, n=60, words=90):
    """Copies, near copies at many distances, chains of near copies, and documents that share a long passage."""
    rng = random.Random(seed)
    vocab = [f"w{i}" for i in range(3000)]
    passage = rng.choices(vocab, k=60)
    out = []
    for _ in range(n):
        base = rng.choices(vocab, k=rng.randint(1, words))
        if rng.random() < 0.3:
            base = passage + base
        out.append(base)
        cur = base
        for _ in range(rng.randint(0, 5)):
            cur = list(cur)
            for _ in range(rng.choice((0, 1, 1, 2, 4))):
                at = rng.randrange(len(cur))
                cur[at : at + rng.randint(0, 1)] = rng.choices(vocab, k=rng.randint(0, 1))
            if cur:
                out.append(cur)
            cur = cur or base
    rng.shuffle(out)
    return [" ".join(x) for x in out]


@pytest.mark.parametrize(("width", "num", "den"), [(3, 9, 10), (5, 4, 5)])
def test_components_against_brute_force(spark, monkeypatch, width, num, den):
    texts = planted(width)
    monkeypatch.setattr(ND, "BLOCK_NODES", 3)  # stars of several blocks
    monkeypatch.setattr(ND, "LOCAL", 2)  # stars within tasks
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    r = ND.jaccard_components(df, width, num, den).toPandas().sort_values("doc_id")
    want = brute_components(texts, width, num, den)
    assert len(set(want)) < len(want) and r.component_id.tolist() == want


@pytest.mark.parametrize(("num", "den"), [(9, 10), (4, 5)])
def test_similar_sets_always_share_a_key(num, den):
    m, rng = ND.Measure(num, den), np.random.default_rng(7)
    for _ in range(400):
        n = int(rng.integers(2, 300))
        a = np.unique(rng.integers(0, 1 << 63, n, dtype=np.uint64))
        drop = int(rng.integers(0, m.most_apart(len(a)) + 1))
        b = np.unique(np.concatenate((rng.permutation(a)[drop:], rng.integers(0, 1 << 63, int(rng.integers(0, 3)), dtype=np.uint64))))
        if m.linked(len(np.intersect1d(a, b)), len(a), len(b)) and len(np.setxor1d(a, b)):
            assert np.intersect1d(ND.keys_of(a, m), ND.keys_of(b, m)).size


def test_tree_against_brute_force():
    m, rng = ND.Measure(4, 5), np.random.default_rng(2)
    for _ in range(40):
        base = np.unique(rng.integers(0, 1 << 60, 60, dtype=np.uint64))
        sets = [np.unique(np.concatenate((rng.permutation(base)[int(rng.integers(0, 12)) :], rng.integers(0, 1 << 60, int(rng.integers(0, 9)), dtype=np.uint64)))) for _ in range(12)]
        pairs = {(i, j) for i in range(12) for j in range(i) if m.linked(len(np.intersect1d(sets[i], sets[j])), len(sets[i]), len(sets[j]))}
        side = [int(x) for x in rng.integers(0, 2, 12)]
        for s, want in ((None, pairs), (side, {(i, j) for i, j in pairs if side[i] != side[j]})):
            got = ND.tree_links(sets, m, s)
            assert {(max(p), min(p)) for p in got} <= want

            def parts(edges):
                up = list(range(12))
                for i, j in edges:
                    old, new = up[i], up[j]
                    up = [new if x == old else x for x in up]
                return len(set(up))

            assert parts(got) == parts(want)
            stay = set(ND.tree_survivors([len(x) for x in sets], [ND.signature(x) for x in sets], m, s))
            assert {i for p in want for i in p} <= stay


def test_packed_rows_round_trip():
    rng = np.random.default_rng(1)
    k = np.sort(rng.integers(0, 1 << 48, 5000, dtype=np.uint64))
    fps, place = ND.ranked(rng.integers(0, 3, (5000, 2), dtype=np.uint64))
    assert len(fps) == 9 and (fps[:-1, 0] <= fps[1:, 0]).all()
    a, b, c = ND.unpack_keys(ND.pack_keys(k, place, fps))
    assert (a == k).all() and (c[b] == fps[place]).all()
    rows = [{"node": -5 + i, "n": i, "comp": 7, "copy": 2 * i, "id": i if i % 2 else None, "sig": bytes(i)} for i in range(4)]
    assert ND.unpack_block(ND.pack_block(rows)) == rows
    assert sorted(ND.connected([(0, 1), (2, 1), (4, 5)], [9, 8, 7, 6, 5, 5])) == [(2, 0), (2, 1)]


def test_least_reached():
    rng = np.random.default_rng(3)
    for _ in range(50):
        n = int(rng.integers(1, 40))
        a, b = rng.integers(0, n, (2, int(rng.integers(0, 30))))
        up = list(range(n))
        for _ in range(n):
            for x, y in zip(a.tolist(), b.tolist(), strict=True):
                up[x] = up[y] = min(up[x], up[y])
        assert ND._least_reached(n, a, b).tolist() == up


def test_nodes_of_equal_first_half_stay_apart(spark, monkeypatch):
    """Fingerprints cut to few bits in their first half: their sets aren't taken for one."""
    texts = planted(11, n=25, words=30)
    whole = ND.fingerprint
    monkeypatch.setattr(ND, "fingerprint", lambda s: bytes(7) + bytes([whole(s)[7] % 16]) + whole(s)[8:] if len(s) else bytes(16))
    monkeypatch.setattr(ND, "LOCAL", 2)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(2)
    found = ND.NearDuplicates(docs, ND.blank_words, 3, ND.Measure(4, 5))
    assert found.clashes is not None
    r = found.classes().toPandas().sort_values("doc_id")
    assert r.component_id.tolist() == brute_components(texts, 3, 4, 5)


def test_one_group_with_stragglers(spark, monkeypatch):
    """A large group of near copies and documents at the edge of it, in blocks of few: components are whole."""
    monkeypatch.setattr(ND, "BLOCK_NODES", 6)
    rng = random.Random(4)
    base = [f"b{i}" for i in range(60)]
    texts = [" ".join(base)]
    for i in range(90):
        w = list(base)
        for _ in range(rng.choice((1, 1, 2, 3, 4))):
            w[rng.randrange(60)] = f"x{i}"
        texts.append(" ".join(w))
    rng.shuffle(texts)
    r = ND.jaccard_components(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4), 3, 4, 5).toPandas().sort_values("doc_id")
    want = brute_components(texts, 3, 4, 5)
    assert 1 < len(set(want)) < len(want) and r.component_id.tolist() == want


@pytest.mark.parametrize("keys", [40, 3000])
def test_spread_broadcasts_no_salted_table(spark, monkeypatch, keys):
    """Few rows are broadcast as they are, more aren't at all: the driver never holds a row SALTS times."""
    monkeypatch.setattr(ND, "LOOKUP", 1000, raising=False)
    sizes = written(spark.range(keys).select(F.xxhash64("id").alias("centre"), (F.col("id") * 7).alias("all")), "sizes")
    rows = written(spark.range(20_000).select(F.xxhash64(F.when(F.col("id") % 2 == 0, 5).otherwise(F.col("id"))).alias("centre"), F.col("id").alias("node")), "rows")
    got = ND.spread(rows, ["centre"], sizes)
    assert {r.node: r.all for r in got.collect()} == {i: 35 if i % 2 == 0 else 7 * i if i < keys else None for i in range(20_000)}
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert ("BroadcastExchange" in plan, "Generate" in plan) == ((True, False) if keys < 1000 else (False, True))


def test_rows_are_told_apart_by_id_and_text(spark):
    a, b = "alpha beta gamma delta epsilon zeta", "one two three four five six"
    rows = [(1, a, "x"), (5, a, "x"), (5, b, "x"), (7, b, "z"), (7, b, "y"), (None, a, "n"), (None, "of its own and nobody else", "n"), (8, None, "e"), (8, "", "e"), (9, "twice the very same row here", "r"), (9, "twice the very same row here", "q")]
    got = ND.one_of_each(spark.createDataFrame(rows, "doc_id long, text string, copy string")).collect()
    assert sorted((tuple(r) for r in got), key=str) == sorted([rows[0], rows[2], rows[6], rows[7], rows[8], rows[10]], key=str)


def test_near_duplicates_of_odd_rows(spark, odd, none):
    r = ND.jaccard_components(odd, 5, 4, 5).toPandas()
    assert len(r) == odd.count()
    got = {(a, n): c for a, n, c in zip(r.doc_id.fillna(-1), r.n_shingles, r.component_id.fillna(-1), strict=True)}
    assert got[1, 6] == got[2, 6] == 1 and got[3, 0] == 3 and got[4, 0] == 4 and got[5, 0] == 5 and got[6, 1] == 6 and got[-1, 1] == -1
    assert ND.jaccard_components(none).count() == 0


# 5 personal data

BASE = {
    "email": re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), "ip": re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
    "card": re.compile(r"[0-9]([\x20-]?[0-9])+"), "phone": re.compile(r"\+[0-9][\x20().0-9-]+[0-9]"),
}


def brute_entities(text):
    out = []
    for kind, p in BASE.items():
        for m in p.finditer(text):
            d = re.sub("[^0-9]", "", m[0])
            if kind == "ip" and any(int(x) > 255 for x in m[0].split(".")) or kind == "card" and not (13 <= len(d) <= 19 and pii.luhn(d)) or kind == "phone" and not 9 <= len(d) <= 15:
                continue
            out.append((kind, *m.span()))
    return out


def test_entities_against_plain_patterns():
    rng = random.Random(2)
    for _ in range(4000):
        t = "".join(rng.choice("ab@@..-+ 1123499(),%é\n") for _ in range(rng.randint(0, 60)))
        assert [(pii.KINDS[k], *s) for k, x in enumerate(pii.entities(t)) for s in x] == brute_entities(t), t


def test_disclosing_terms(spark):
    rows = [(i, f"noise{i % 7} words here contact person{i}@mail.example.org thanks noise{i % 5}") for i in range(40)] + [(100 + i, f"noise{i % 7} words here and there noise{i % 5} nothing") for i in range(400)]
    r = {x.doc_id: x for x in pii.find_personal(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    terms = {rows[3][1][t.s : t.e] for t in r[3].terms}
    assert {"contact", "thanks"} <= terms and "words" not in terms and r[100].terms is None and r[100].spans == ""
    assert r[3].spans.startswith("email:") and "term:" in r[3].spans
    clean = {x.doc_id: x.text for x in pii.sanitise(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert "<EMAIL>" in clean[3] and "contact" not in clean[3] and clean[100] == rows[40][1]


def brute_terms(texts):
    """The terms that disclose, by counting words in plain Python: {(document, start, end): action}."""
    word = re.compile("[A-Za-z\x80-\U0010ffff]+")
    near, all_, words = Counter(), Counter(), 0
    there = defaultdict(set)
    for k, t in enumerate(texts):
        spans = brute_entities(t)
        for m in word.finditer(t):
            all_[m[0].lower()] += 1
            words += 1
        for kind, a, b in spans:
            before = [m.span() for m in word.finditer(t) if m.end() <= a and m.start() > a - 120][-5:]
            after = [m.span() for m in word.finditer(t) if m.start() >= b and m.end() < b + 120][:5]
            for s, e in before + after:
                if not any(x < e and s < y for _, x, y in spans):
                    there[k].add((kind, s, e))
        for kind, s, e in there[k]:
            near[t[s:e].lower(), kind] += 1
    p = {kind: sum(n for (_, k), n in near.items() if k == kind) / words for kind in BASE}
    out = {}
    for k, found in there.items():
        for kind, s, e in found:
            w = texts[k][s:e].lower()
            given = (near[w, kind] + 4 * p[kind]) / (all_[w] + 4)
            share = np.log2(given / p[kind]) / -np.log2(p[kind])
            action = 2 if share >= 0.8 else 1 if share >= 0.5 else 0
            if action:
                out[k, s, e] = max(action, out.get((k, s, e), 0))
    return out


@pytest.mark.parametrize("most", [500_000, 0])
def test_terms_against_brute_force(spark, monkeypatch, most):
    monkeypatch.setattr(pii, "BROADCAST_ROWS", most)  # 0: the salted join
    rng = random.Random(6)
    vocab = [f"noise{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(60)]
    texts = []
    for i in range(260):
        w = rng.choices(vocab, k=rng.randint(4, 40))
        if i % 4 == 0:
            w.insert(rng.randrange(len(w)), f"write to x{i}@mail.example.org soon")
        if i % 13 == 0:
            w.insert(rng.randrange(len(w)), f"once{chr(97 + i % 26)} 10.0.{i % 200}.7")
        w += ["soon"] * 2
        texts.append(" ".join(w))
    got = {(r.doc_id, t.s, t.e): t.action for r in pii.find_personal(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)).collect() for t in r.terms or []}
    assert got == brute_terms(texts) and 2 in got.values()


def test_personal_data_of_odd_rows(spark, odd, none):
    more = odd.select("doc_id", "text").union(spark.createDataFrame([(50, "4" * 30_000 + " a@b.co " + "@" * 20_000)], "doc_id long, text string"))
    r = pii.find_personal(more).toPandas()
    assert len(r) == more.count() and r.n_email.sum() == 1
    assert pii.find_personal(none).count() == 0 and pii.sanitise(odd).count() == odd.count()
    assert pii.find_personal(odd).count() == odd.count() and pii.sanitise(odd).columns == odd.columns and pii.sanitise(none).count() == 0


# 6 token files


def test_files_round_trip():
    rng = np.random.default_rng(3)
    for sizes in ([], [0], [1, 0, 5], rng.integers(0, 90_000, 5).tolist()):
        ids = [rng.integers(0, 1 << int(rng.integers(1, 20)), n).astype(np.uint32) for n in sizes]
        file = TF.write_file(np.concatenate(ids) if ids else np.empty(0, np.uint32), np.array(sizes, np.int64))
        assert [x.tolist() for x in TF.read_documents(file)] == [x.tolist() for x in ids]
    with pytest.raises(ValueError):
        next(TF.read_chunks(b"x" * 100))


def test_encoder_equals_the_tokenizer():
    from tokenizers import Tokenizer

    enc, tok, rng = TF.Encoder(TF.vocabulary_path()), Tokenizer.from_file(TF.vocabulary_path()), random.Random(4)
    parts = ["a", "B", "É", "́", "J̌", "Don't", "'s", " ", "\n", "\x1c", " ", ".", ",", "!?", "<|endoftext|>", "<|ENDOFTEXT|>", "9", "İ", "ΑΣ", "ß", "日本", "🙂", "-", "'", "\x00", "THE", "क़", "ŉ", "ﬁ", "ÿ", "é"]
    for _ in range(3000):
        texts = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 12))) for _ in range(3)]
        ids, counts = enc.encode(pa.array([t.encode() for t in texts]))
        assert [x.tolist() for x in np.split(ids, np.cumsum(counts)[:-1])] == [tok.encode(t, add_special_tokens=False).ids for t in texts], texts


def test_long_texts_come_in_parts():
    rng = random.Random(9)
    texts = [bytes(rng.choice(b"ab \n") for _ in range(n)) for n in (0, 3, 40, 200, 0)] + [b"x" * 100, b"y" * 90 + b" z"]
    parts, places = [], []
    for some, where in TF.slices(pa.array(texts), 16):
        parts += some.to_pylist()
        places += where
    assert places == sorted(places) and [b"".join(p for p, k in zip(parts, places, strict=True) if k == i) for i in range(7)] == texts
    assert all(p[-1:] in (b" ", b"\n") for p, k, after in zip(parts, places, places[1:], strict=False) if k == after) and len(parts) > 10


def test_other_tokenizers_encode_whole_texts():
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    enc, tok = TF.Encoder(path), Tokenizer.from_file(path)
    assert not enc.by_piece and TF.Encoder(TF.vocabulary_path()).by_piece
    texts = [" Two  words,\n and more", "", "Ünï"]
    ids, counts = enc.encode(pa.array([t.encode() for t in texts]))
    assert [x.tolist() for x in np.split(ids, np.cumsum(counts)[:-1])] == [tok.encode(t, add_special_tokens=False).ids for t in texts]


def test_one_id_with_most_rows_is_spread(spark):
    docs = spark.range(4000).select(F.when(F.col("id") % 3 > 0, 7).otherwise(F.col("id")).alias("doc_id"), F.concat(F.lit("word "), F.col("id").cast("string")).alias("text"))
    files = TF.write_tokens(docs, TF.vocabulary_path(), 1)
    assert files.select(F.max(F.size("doc_ids"))).first()[0] < 2000
    r = TF.read_tokens(files).orderBy("start").toPandas()
    assert r.doc_id.is_monotonic_increasing and len(r) == 4000 and (r.start == r.n_tokens.cumsum() - r.n_tokens).all()


def test_token_digest(spark, data, monkeypatch):
    from tokenizers import Tokenizer

    monkeypatch.setattr(TF, "FILE_IDS", 5_000)
    tok, at = Tokenizer.from_file(TF.vocabulary_path()), 0
    got = TF.token_digest(docs_of(spark, data)).orderBy("doc_id").collect()
    for r, d in zip(got, docs_of(spark, data).orderBy("doc_id").collect(), strict=True):
        ids = np.array([*tok.encode(d.text, add_special_tokens=False).ids, 1], "<u4")
        assert tuple(r) == (d.doc_id, at, len(ids), zlib.crc32(ids.tobytes()))
        at += len(ids)


def test_tokens_of_odd_rows(spark, odd, none):
    r = TF.token_digest(odd).orderBy("start").toPandas()
    assert len(r) == odd.count() and (r.start == r.n_tokens.cumsum() - r.n_tokens).all()
    assert r[r.doc_id.isin([3, 4, 5])].n_tokens.tolist() == [1, 1, 1] and np.isnan(r.doc_id[0])
    assert TF.token_digest(none).count() == 0


# 7 mixing


def brute_targets(sizes, weights, total, most=3):
    out, open_ = [0.0] * len(sizes), list(range(len(sizes)))
    left = total
    while open_:
        w = sum(weights[i] for i in open_)
        over = [i for i in open_ if left * weights[i] / w > most * sizes[i]]
        if not over:
            for i in open_:
                out[i] = left * weights[i] / w
            break
        for i in over:
            out[i] = most * sizes[i]
            open_.remove(i)
        left = total - sum(out)
    return out


@pytest.mark.parametrize("sizes", [[10, 10, 10], [1, 10, 10], [0, 5], [1, 2, 4, 8, 16, 500], [7] * 40 + [0, 900]])
def test_targets(spark, sizes):
    weights = [float((5, 2, 1)[i % 3]) for i in range(len(sizes))]
    df = spark.createDataFrame(list(zip(range(len(sizes)), sizes, weights, strict=True)), "k int, size long, weight double")
    got = [r.target for r in MX.targets(df, float(sum(sizes))).orderBy("k").collect()]
    assert np.allclose(got, brute_targets(sizes, weights, sum(sizes)))


def test_targets_of_nothing(spark):
    assert MX.targets(spark.createDataFrame([], "size long, weight double"), 0.0).count() == 0


def brute_plan(rows, tilt=0.5):
    """taken and positions of (order, source, size) rows: documents laid out pass after pass, places found by bisection."""
    names = sorted({s for _, s, _ in rows if s is not None}) + ([None] if any(s is None for _, s, _ in rows) else [])
    words = {s: sum(n for _, t, n in rows if t == s) for s in names}
    goal = brute_targets([words[s] for s in names], [(5, 2, 1)[i % 3] for i in range(len(names))], sum(words.values()))
    out = {}
    for i, s in enumerate(names):
        want, slope, at = round(goal[i]), tilt if i % 2 else -tilt, 0
        for k in range(3):
            for key, _, n in sorted(r for r in rows if r[1] == s):
                part = max(0, min(n, want - at))
                if part:
                    middle, low, high = at + part / 2, 0.0, 1.0
                    for _ in range(60):
                        t = (low + high) / 2
                        low, high = (t, high) if goal[i] * (t * (1 + slope) - slope * t * t) < middle else (low, t)
                    out.setdefault(key, []).append((part, low))
                at += n
    return out


def test_plan_against_brute_force(spark):
    rng = random.Random(3)
    docs = spark.createDataFrame([(i, " ".join(["w"] * rng.randint(0, 30)), rng.choice("aaaaab") if i % 7 else None) for i in range(150)], "doc_id long, text string, source string").repartition(3)
    plan = MX.plan_mix(docs).collect()
    keys = {r.doc_id: (r.mixed, r.mixed2) for r in plan}
    want = brute_plan([((*keys[r.doc_id], r.doc_id), r.source, r.size) for r in plan])
    for r in plan:
        mine = want.get((*keys[r.doc_id], r.doc_id), [])
        assert [p.words for p in r.passes] == [n for n, _ in mine] and r.taken == sum(n for n, _ in mine)
        assert np.allclose([p.position for p in r.passes], [t for _, t in mine], atol=1e-6)


def test_many_sources_and_one_row_many_times(spark):
    docs = spark.range(3000).select(F.when(F.col("id") % 3 == 0, 7).otherwise(F.col("id")).alias("doc_id"), F.lit("two words").alias("text"), F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("s"), F.col("id"))).alias("source"))
    p = MX.plan_mix(docs).toPandas()
    assert len(p) == 3000 and p.target.groupby(p.source).first().sum() == pytest.approx(6000) and (p.taken <= 6).all()
    m = MX.mix(docs).toPandas()
    want = sum(sum(2 * x.words >= s for x in ps) for ps, s in zip(p.passes, p["size"], strict=True))
    assert len(m) == want and (m.source == "hot").sum() == sum(sum(2 * x.words >= s for x in ps) for ps, s, n in zip(p.passes, p["size"], p.source, strict=True) if n == "hot")


def test_mix_meets_targets(spark, data):
    docs = docs_of(spark, data)
    p = MX.plan_mix(docs).toPandas()
    words = {r.doc_id: len(r.text.encode().split()) for r in docs.collect()}
    assert (p["size"] == p.doc_id.map(words)).all() and (p.taken <= 3 * p["size"]).all()
    for _, g in p.groupby("source"):
        assert abs(g.taken.sum() - g.target.iloc[0]) < 1
    assert abs(p.groupby("source").target.first().sum() - p["size"].sum()) < 1e-6
    assert p.sort_values("doc_id").taken.tolist() == MX.plan_mix(docs).toPandas().sort_values("doc_id").taken.tolist()


def test_curriculum_moves(spark, data):
    m = MX.mix(docs_of(spark, data)).toPandas()
    assert m.position.is_monotonic_increasing and m.position.between(0, 1).all()
    names = sorted(m.source.unique())
    early = [m[(m.source == n) & (m.position < 0.5)].pass_words.sum() / m[m.source == n].pass_words.sum() for n in names]
    assert np.mean(early[1::2]) > 0.55 > 0.45 > np.mean(early[::2])


def test_schedule_decides_what_op7_returns(spark, data, monkeypatch):
    p = MX.op7_mixing(spark, data).toPandas()
    assert (p.first_position.isna() == (p.taken == 0)).all() and (p.first_position.dropna() <= p.last_position.dropna()).all()
    assert p.first_position.dropna().between(0, 1).all() and p.last_position.dropna().between(0, 1).all()
    whole = MX.demand  # a schedule that ends in the middle: 0.5 - 0.25 * 0.5 of a late source's target, 0.5 + 0.25 * 0.5 of an early one's
    monkeypatch.setattr(MX, "demand", lambda t, target, tilt: whole(F.least(t, F.lit(0.5)), target, tilt))
    half = MX.op7_mixing(spark, data).toPandas()
    said = half.doc_id.map({r.doc_id: r.source for r in docs_of(spark, data).collect()})
    for i, name in enumerate(sorted(said.dropna().unique())):
        g = half[said == name]
        assert abs(g.taken.sum() - (0.625 if i % 2 else 0.375) * g.target.iloc[0]) < 1


def test_steepest_schedules_take_the_same_words(spark, data):
    docs = docs_of(spark, data)
    flat, steep = ({r.doc_id: (r.taken, [p.position for p in r.passes]) for r in MX.plan_mix(docs, tilt=t).collect()} for t in (0.0, 1.0))
    assert {k: n for k, (n, _) in flat.items()} == {k: n for k, (n, _) in steep.items()} and flat != steep


def test_demand_is_inverted(spark):
    df = spark.range(101).select((F.col("id") / 100).alias("t"), F.lit(1000.0).alias("g"))
    for tilt in (-0.5, 0.0, 0.5):
        worst = df.select(F.max(F.abs(MX.position(MX.demand(F.col("t"), F.col("g"), F.lit(tilt)), F.col("g"), F.lit(tilt)) - F.col("t"))).alias("d")).first().d
        assert worst < 1e-9


def test_mixing_of_odd_rows(spark, odd, none):
    p = MX.plan_mix(odd).toPandas()
    assert len(p) == odd.count() and p[p.doc_id.isin([3, 4, 5])].taken.tolist() == [0, 0, 0]
    assert p[p.doc_id == 6]["size"].iloc[0] == 60_000 and p[p.source.isna()].source_size.max() == 6
    assert MX.plan_mix(none).count() == 0 and MX.mix(none).count() == 0
    mixed = MX.mix(odd).toPandas()
    assert set(mixed.columns) == {*odd.columns, "pass_words"} and len(mixed) > 0
    p = MX.plan_mix(odd, hashed=[c for c in odd.columns if c != "position"]).toPandas()
    same = p[p.doc_id == 2]
    assert len(mixed[mixed.doc_id == 2]) == sum(sum(2 * x.words >= s for x in ps) for ps, s in zip(same.passes, same["size"], strict=True))


# 8 main text


def test_main_text_of_test_pages(spark, data):
    import html

    for r in MT.extract_main_text(spark.read.parquet(f"{data}/pages.parquet")).collect():
        inner = re.search(r"(?s)<article>(.*?)(</article>|$)", r.html)[1]
        assert r.main_text == " ".join(html.unescape(re.sub("<[^>]+>", " ", inner)).split()) and r.main_chars == len(r.main_text)


PAGE = """<html><head><title>x</title></head><body><header><h1>Site</h1><a href=/>home</a></header><div class="cookie-notice">We use cookies. <a href=#>ok</a></div><nav><ul><li><a>a</a></ul></nav>
<main><h1>Title here</h1><p>First &amp; more\n text.</p><div class="ad">Buy now the best things you can.</div><p>Second <a href=x>link</a><script>var a="</p>"</script>.</p><ul><li>one<li>two</ul>
<section id="comments"><p>Great article, I really liked it very much indeed.</p></section></main><aside><p>Side text long enough to be a sentence of its own.</p></aside><form><label>Name</label><textarea>zz</textarea></form><footer>Copyright.</footer>"""


def test_frame_parts_are_left_out():
    assert MT.main_text(PAGE, MT.default_tree()) == "Title here First & more text. Second link. one two"


def test_pages_without_an_article():
    long = "This paragraph has plenty of words, so that nobody would take it for a menu entry or a caption, and it ends well."
    html = f"<body><div><a href=/>Home</a></div><div><a href=/a>Shop</a></div><div>{long}</div><div>{long}</div><div><a href=/b>Terms</a></div></body>"
    assert MT.main_text(html, MT.default_tree()) == f"{long} {long}"


LONG = "This paragraph has plenty of words, so that nobody would take it for a menu entry or a caption, and it ends well."
MORE = "A second one follows it with about as many words as the first had, and some more of them to be safe."


@pytest.mark.parametrize(("html", "want"), [
    (f'<body><div class="market-share-report"><p>{LONG}</p><p>{MORE}</p></div></body>', f"{LONG} {MORE}"),
    (f"<body><article><nav><ul><li><a href=/a>Home</a><li><a href=/b>Shop</a></ul><h1>The title</h1><p>{LONG}</p><p>{MORE}</p></article></body>", f"The title {LONG} {MORE}"),
    (f'<body><svg><path d="M0"/><text>icon</text><div><h1>The title</h1><p>{LONG}</p><p>{MORE}</p></div></body>', f"The title {LONG} {MORE}"),
    (f"<body><div><a href=/>Home</a></div><p>{LONG}</p><pre>x = 1\ny = f(x)  and so on</pre><p>A paragraph without a full stop that goes on for some words</p><div><a href=/t>Terms</a></div>", f"{LONG} x = 1 y = f(x) and so on A paragraph without a full stop that goes on for some words"),
    (f"<body><article><p>{LONG}</p><div>Buy the best shoes now</div><p>{MORE}</p></article></body>", f"{LONG} {MORE}"),
    (f"<body><svg><svg></svg>in</svg><p>{LONG}</p>", LONG),
    ("<nav><a href=/>a</a></nav><footer>All rights are reserved here.</footer>", ""),
])
def test_awkward_pages(html, want):
    assert MT.main_text(html, MT.default_tree()) == want


def test_tree_learns_its_table():
    t = MT.default_tree()
    assert all(t.predict(f) == v for row, said in MT.labelled() for f, v in zip(MT.features(row), said, strict=True))
    assert t.used() & {"words_before", "words_after", "links_before", "links_after"}


def held_out_pages():
    """Pages that the tree hasn't seen: blocks of main text and others, some without article, class, id or closed tags."""
    rng = random.Random(12)

    def say(n, stop="."):
        return " ".join(rng.choice(("market", "river", "of", "the", "stone", "light", "answer", "and", "window", "paper")) for _ in range(n)) + stop

    for k in range(120):
        marked, named, close = k % 3 == 0, k % 3 == 1, rng.random() < 0.7
        main, other, html = [], [], []

        def add(store, text, tag, extra="", link=False, html=html, close=close):
            store.append(text)
            html.append(f"<{tag}{extra}>" + (f"<a href=/x>{text}</a>" if link else text) + (f"</{tag}>" if close or tag == "div" else ""))

        html.append("<nav><ul>" if marked or named else "<div><ul>")
        for _ in range(rng.randint(2, 6)):
            add(other, say(rng.randint(1, 2), ""), "li", link=True)
        html.append("</ul></nav>" if marked or named else "</ul></div>")
        if marked or named:
            add(other, say(rng.randint(4, 12)), "div", rng.choice((' class="ad"', ' class="cookie-notice"', ' id="promo"')))
        html.append("<article>" if marked else '<div class="story">' if named else "<div>")
        add(main, say(rng.randint(3, 9), ""), "h1")
        for _ in range(rng.randint(2, 7)):
            add(main, say(rng.randint(14, 90), rng.choice((".", ".", "!", ""))), "p")
        html.append("</article>" if marked else "</div>")
        if marked or named:
            add(other, say(rng.randint(5, 30)), "div", ' class="comments"')
            add(other, "Copyright " + say(rng.randint(1, 6)), "footer")
        else:
            for _ in range(2):
                add(other, say(rng.randint(1, 3), ""), "div", link=True)
        yield "<body>" + "".join(html), main, other


def test_held_out_precision_and_recall():
    right, said, there = 0, 0, 0
    for html, main, _ in held_out_pages():
        row = MT.blocks(html)
        got = {b.text for b, f in zip(row, MT.features(row), strict=True) if MT.default_tree().predict(f)}
        right += len(got & set(main))
        said += len(got)
        there += len(set(main))
    assert right / said > 0.97 and right / there > 0.97, (right / said, right / there)


def test_main_text_of_odd_pages(spark):
    rows = [(1, None, None), (2, "u", ""), (3, "u", "<p"), (4, "u", "<article>" + "<b>x " * 30_000), (4, "u", "<article>y"), (5, "u", "plain text only")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumns({"main_text": F.lit(1), "text": F.lit("t")})
    r = MT.extract_main_text(df).toPandas()
    assert len(r) == 6 and r.main_chars.tolist()[:3] == [0, 0, 0] and r.main_chars[3] == 59_999
    assert MT.extract_main_text(df.limit(0)).count() == 0


# 9 top-k


def test_topk_against_brute_force(spark, monkeypatch):
    monkeypatch.setattr(TK, "BLOCK_ROWS", 37)
    monkeypatch.setattr(TK, "QUERY_BYTES", 100)
    monkeypatch.setattr(TK, "QUERY_ROWS", 2)
    rng = np.random.default_rng(9)
    rows = [(i, (np.round(rng.normal(size=6), 1)).tolist()) for i in range(300)]
    rows += [(300, None), (301, []), (302, [1.0, None, 0.0, 0.0, 0.0, 0.0]), (303, [float("nan")] * 6), (304, [float("inf")] * 6), (305, [1.0, 2.0]), (400, [1.0, 2.0]), (306, [0.0] * 6), (7, rows[8][1])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumns({"score": F.lit(1), "rank": F.lit(2)}).repartition(3)
    got = defaultdict(list)
    for r in TK.exact_topk(df, df.filter("vec_id % 100 = 0"), 10).orderBy("query_id", "rank").collect():
        got[r.query_id].append((r.score, r.vec_id))
    vec = [(i, np.floor(1024 * np.array(v, np.float32).astype(float)).astype(np.int64)) for i, v in rows if v and not any(x is None or not np.isfinite(x) for x in v)]
    want = {q: sorted(((int(a @ b), i) for i, b in vec if i != q and len(a) == len(b)), key=lambda x: (-x[0], x[1]))[:10] for q, a in vec if q % 100 == 0}
    assert dict(got) == {q: w for q, w in want.items() if w}


def test_large_values_stay_exact(spark):
    big = [(100, [1e6, 3.0]), (1, [1e6, 1e6]), (2, [1e6, -1e6])]
    df = spark.createDataFrame(big, "vec_id long, embedding array<double>")
    r = TK.exact_topk(df, df.filter("vec_id = 100"), 10).orderBy("rank").collect()
    assert [x.score for x in r] == [1024**2 * (10**12 + 3 * 10**6), 1024**2 * (10**12 - 3 * 10**6)]
    assert TK.exact_topk(df.limit(0), df.limit(0)).count() == 0


# 10 language


def test_held_out_accuracy(spark, data):
    r = LA.op10_language(spark, data).join(docs_of(spark, data).select("doc_id", "lang"), "doc_id").toPandas()
    held = r[r.held_out]
    assert (held.lang == held.lang_pred).mean() > 0.97 and r.score.between(0, 1).all()
    assert (r.held_out == r.doc_id.map(lambda k: zlib.crc32(str(k).encode()) % 4 == 2)).all()


def brute_grams(text):
    """n-grams of a text as tuples, by the definition."""
    import unicodedata

    c = [0]
    for x in text:
        k = ord(x.lower()[0]) if unicodedata.category(x)[0] in "LM" else 0
        if k or c[-1]:
            c.append(k)
    if c[-1]:
        c.append(0)
    return [tuple(c[i : i + n]) for n in (1, 2, 3) for i in range(len(c) - n + 1) if n > 1 or c[i]]


def gram_counts(texts, **options):
    out = [Counter() for _ in texts]
    for f, doc, _ in LA.runs([t.encode() for t in texts], **options):
        for x, k in zip(f.tolist(), doc.tolist(), strict=True):
            out[k][x] += 1
    return out


def test_each_gram_counts_once(monkeypatch):
    texts = ["Abc, abd!", "", "  ", "ünïcode wide  " * 30, "x", "zz9zz" * 50, "İ"]
    whole = gram_counts(texts)
    for c, t in zip(whole, texts, strict=True):
        assert sorted(c.values()) == sorted(Counter(brute_grams(t)).values())
    for piece in (7, 40, 200):
        monkeypatch.setattr(LA, "PIECE", piece)
        assert gram_counts(texts) == whole


def test_language_scores_against_brute_force(spark):
    rows = [(1, "aba Abc", "x"), (2, "zz zy", "y"), (3, "ab", "x")]
    m = LA.train(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    assert m.languages == ["x", "y"]
    counts = {k: sum((Counter(brute_grams(t)) for _, t, g in rows if g == k), Counter()) for k in "xy"}
    logs = []
    for k, docs in (("x", 2), ("y", 1)):
        total = sum(counts[k].values()) + 0.1 * LA.FEATURES
        logs.append(np.log(docs / 3) + sum(np.log((counts[k][x] + 0.1) / total) for x in brute_grams("abz!")))
    said, score = m.predict([b"abz!", None, b"?", b"zzz"])
    assert said == ["xy"[int(np.argmax(logs))], "und", "und", "y"] and score[1] == score[2] == 0
    assert abs(score[0] - 1 / (1 + np.exp(-abs(logs[0] - logs[1])))) < 1e-4


def test_many_languages(spark, monkeypatch):
    """More languages than any list of them: none is dropped, the model stays bounded."""
    monkeypatch.setattr(LA, "CELLS", 1 << 22)
    word = lambda k: "".join(chr(97 + (k // 26**i * (7 + 2 * i) + 3 * k) % 26) for i in range(9))
    docs = spark.createDataFrame([(k, f"{word(k)} {word(k)}", f"l{k:03d}") for k in range(600)], "doc_id long, text string, lang string")
    m = LA.train(docs)
    assert len(m.languages) == 600 and m.log_p.size <= 1 << 22
    r = LA.identify(docs, m).toPandas()
    assert (r.lang == r.lang_pred).mean() > 0.95


def test_training_rows_are_bounded_whatever_the_ids(spark):
    docs = spark.range(6000).select(F.lit(5).alias("doc_id"), F.lit("same text").alias("text"), F.when(F.col("id") % 2 > 0, "a").otherwise("b").alias("lang"))
    n = np.exp(LA.train(docs, 500).prior)
    assert len(n) == 2 and abs(n[0] - 0.5) < 0.15


def test_language_of_odd_rows(spark, odd, none):
    m = LA.train(odd)
    r = LA.identify(odd, m).toPandas()
    assert len(r) == odd.count() and set(r.columns) == {*odd.columns, "lang_score"}
    assert set(r[r.doc_id.isin([3, 4, 5, 8])].lang_pred) == {"und"} and (r[r.doc_id == 3].lang_score == 0).all()
    empty = LA.train(none)
    assert LA.identify(odd, empty).filter("lang_pred <> 'und'").count() == 0 and LA.identify(none, m).count() == 0


def test_queries_are_registered():
    from tessella.llm.queries import ORACLE_SQL, QUERIES

    assert [int(re.match(r"op(\d+)_", k)[1]) for k in QUERIES] == list(range(1, 11)) and set(ORACLE_SQL) <= set(QUERIES)
    assert json.dumps(list(QUERIES))
