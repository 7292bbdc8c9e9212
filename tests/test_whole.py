"""Queries over whole tables, against brute-force versions."""

import json

import pytest
from pyspark.sql import functions as F

from tessella.operators import ground as G
from tessella.plans import expression_queries as XQ
from tessella.plans import registry


@pytest.fixture(scope="module")
def grounds(spark, tmp_path_factory):
    """Documents that hold items of any id, more and fewer items than documents."""
    d = str(tmp_path_factory.mktemp("grounds"))
    items = [(i, f"Passage number {i} tells of thing{i} and place{i}", ) for i in range(60)] + [(60, None), (61, ""), (62, "12,500.5")]
    docs = [(i, f"Before.  PASSAGE number {j}\ntells of thing{j} and place{j} after") for i, j in enumerate((59, 41, 3, 40, 7))] + [(5, None), (6, ""), (7, "thing8 place8 tells passage 12500.5")]
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(f"{d}/documents.parquet")
    return d, docs, items


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


@pytest.mark.parametrize("block", [4096, 10])
def test_every_document_meets_every_item(spark, grounds, monkeypatch, block):
    monkeypatch.setattr(XQ, "ITEMS", block)
    d, docs, items = grounds
    plain = lambda t: " ".join(t.lower().split())
    pairs = [(i, j, t, v) for i, t in docs for j, v in items]
    want = [(i, j) for i, j, t, v in pairs if t is not None and v is not None and plain(v) in plain(t)]
    assert {(0, 59), (1, 41), (3, 40)} <= set(want)
    assert rows(registry.QUERIES["g2_contains"](spark, d)) == sorted(want, key=repr)
    want = [(i, j) for i, j, t, v in pairs if v is None or G.grounded(v, G.Source.of(t or ""))]
    assert (7, 62) in want and rows(registry.QUERIES["g2_grounded"](spark, d)) == sorted(want, key=repr)
    got = registry.QUERIES["g3_ground_records"](spark, d).collect()
    assert len(got) == len(pairs)
    text, value = dict(docs), dict(items)
    for r in got:
        rec = {"title": value[r.item_id][:40]} if value[r.item_id] is not None else {}
        data, nulled = G.ground(rec | {"price": {"amount": 19.9, "ok": True}}, G.Source.of(text[r.doc_id] or ""))
        assert (json.loads(r.data), r.nulled) == (data, ",".join(nulled))
    old = spark.createDataFrame(pairs, "doc_id long, item_id long, text string, value string")
    want = old.select("doc_id", "item_id", F.round(G.token_share(F.col("value"), F.col("text")), 6))
    assert rows(registry.QUERIES["j8_token_share"](spark, d)) == rows(want)


def test_workflow_verdict_of_all_events(spark, tmp_path):
    d = str(tmp_path)
    # Numbers 70 and 90 are ready, 20 and 40 blocked, 4 and 24 failed, 1 and 2 need a review.
    groups = {"ready-1": (70, 90), "blocked-2": (20, 40), "failed-3": (4, 24), "mixed-4": (70, 4, 1), "review-5": (1, 2, 20), "again-6": (4, 4)}
    rows_ = [(k, int(g[-1]), g[:-2]) for g, ks in groups.items() for k in ks]
    spark.createDataFrame(rows_, "event_id long, user_id long, event_type string").write.parquet(f"{d}/events.parquet")
    got = {r.contract: (r.n, r.workflow, r.action) for r in registry.QUERIES["dg7_workflow_verdict"](spark, d).collect()}
    assert got == {
        "ready-1": (2, "ready", "run-contract-extraction"), "blocked-2": (2, "blocked", "fix-access-first"), "failed-3": (2, "failed", "do-not-automate"),
        "mixed-4": (3, "mixed", "extract-ready-subset"), "review-5": (3, "needs-review", "manual-review"), "again-6": (2, "failed", "do-not-automate"),
    }


def test_workflow_verdict_counts_every_event(spark):
    d = "/root/testdata/sf0.001"
    got = registry.QUERIES["dg7_workflow_verdict"](spark, d).agg(F.sum("n")).first()[0]
    assert got == spark.read.parquet(f"{d}/events.parquet").count()


def test_normalise_all_documents(spark, tmp_path):
    import unicodedata

    d = str(tmp_path)
    cases = {
        "\ufb01ne \u2460 \uff21\uff22": "fine 1 ab", "\u00c5ngstr\u00f6m \u212b": "angstrom a", "Stra\u00dfe \u00d8re": "stra\u00dfe \u00f8re", "\u0130x": "ix", "e\u0301\u0323": "e",
        "\u0e01\u0e34": "\u0e01", "a\u00a0\t\n b\u3000": "a b", "x\u00b2 \u00bd": "x2 1\u20442", "": "",
    }
    langs = ["en", "de", "fr", "es", None, "xx"]
    docs = [(i, t, langs[i % 6]) for i, t in enumerate(cases)] + [(99, None, "en")]
    spark.createDataFrame(docs, "doc_id long, text string, lang string").write.parquet(f"{d}/documents.parquet")
    got = {r.doc_id: r.plain for r in registry.QUERIES["st4_normalise"](spark, d).collect()}
    assert got == {**dict(enumerate(cases.values())), 99: None}

    d = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{d}/documents.parquet").collect()
    got = {r.doc_id: r.plain for r in registry.QUERIES["st4_normalise"](spark, d).collect()}
    brute = lambda t: " ".join("".join(c for c in unicodedata.normalize("NFKD", t) if not unicodedata.category(c).startswith("M")).lower().split())
    assert got == {r.doc_id: brute(r.text) for r in docs} and len({r.lang for r in docs}) > 2


def test_phones_of_documents_with_many(spark, tmp_path):
    d = str(tmp_path)
    many = [f"555-{100 + i}-{9000 - i}" for i in range(30)]
    docs = [(1, " ; ".join([many[0], *many])), (2, " ; ".join(many[:20])), (3, many[5]), (4, "none"), (5, None)]
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(f"{d}/documents.parquet")
    got = {r.doc_id: r.phones.split("|") for r in registry.QUERIES["ex21_phones"](spark, d).collect()}
    assert got == {1: sorted(many[:20]), 2: sorted(many[:20]), 3: [many[5]]}
