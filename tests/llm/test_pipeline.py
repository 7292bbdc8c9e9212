"""Each stage of the pipeline against a brute-force version on its own input, and the whole run."""

import numpy as np
import zlib

import corpus_pipeline as CP
from pyspark.sql import functions as F
from test_operators import brute_components, brute_hits
from tokenizers import Tokenizer

from tessella.llm import decontaminate as DC
from tessella.llm import mixing as MX
from tessella.llm import token_file as TF
from tessella.llm.common import written


def test_stages(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet")
    names = [n for n, _ in CP.STAGES]
    assert names == ["language", "near_duplicates", "decontamination", "mixing", "tokens"]
    stage, bench = dict(CP.STAGES), spark.read.parquet(f"{data}/benchmark.parquet").collect()

    kept = written(stage["language"](spark, docs, data), "t")
    assert kept.columns == docs.columns and kept.count() == docs.count()

    rows = kept.orderBy("doc_id").collect()
    first = {rows[i].doc_id for i in brute_components([r.text for r in rows], 5, 4, 5)}
    kept = written(stage["near_duplicates"](spark, kept, data), "t")
    assert {r.doc_id for r in kept.collect()} == first and kept.count() == len(first) < len(rows)

    items = [(b.item_id, b.text.encode()) for b in bench]
    clean = {r.doc_id for r in kept.collect() if not DC.scan(DC.item_words(r.text.encode()), DC.build(items))[1]}
    some = kept.limit(20).collect()
    assert all(bool(brute_hits(DC.item_words(r.text.encode()), items)[1]) == (r.doc_id not in clean) for r in some)
    kept = written(stage["decontamination"](spark, kept, data), "t")
    assert {r.doc_id for r in kept.collect()} == clean < first

    plan = MX.plan_mix(kept, hashed=kept.columns).collect()
    want = {r.doc_id: sum(2 * p.words >= r.size for p in r.passes) for r in plan}
    mixed = written(stage["mixing"](spark, kept, data), "t")
    got = dict.fromkeys(want, 0)
    for r in mixed.collect():
        got[r.doc_id] += 1
    assert got == want and mixed.columns == docs.columns

    out = written(stage["tokens"](spark, mixed, data), "t").toPandas().sort_values("start")
    tok, texts = Tokenizer.from_file(TF.vocabulary_path()), {r.doc_id: r.text for r in mixed.collect()}
    at = 0
    for k, start, n, crc in out.itertuples(index=False):
        ids = np.array([*tok.encode(texts[k], add_special_tokens=False).ids, 1], "<u4").tobytes()
        assert (start, n, crc) == (at, len(ids) // 4, zlib.crc32(ids))
        at += n
    assert out.doc_id.is_monotonic_increasing and len(out) == mixed.count()


def test_run(spark, data):
    r = CP.run(spark, data)
    assert r.columns == ["doc_id", "start", "n_tokens", "ids_crc32"] and r.count() > 0


def test_language_stage_names_what_has_no_language(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet").withColumn("lang_pred", F.lit("own"))
    some = docs.withColumn("lang", F.when(F.col("doc_id") % 4 > 0, F.col("lang")))
    got = {r.doc_id: r for r in CP.language_stage(spark, some, data).collect()}
    said = {r.doc_id: r.lang for r in docs.collect()}
    assert all(r.lang_pred == "own" for r in got.values())
    right = [r.lang == said[k] for k, r in got.items() if said[k] is not None]
    assert sum(right) / len(right) > 0.98 and all(r.lang == said[k] for k, r in got.items() if k % 4 and said[k] is not None)


def test_stages_of_odd_and_empty_rows(spark, odd, none, data):
    for docs in (odd.select("doc_id", "text", "lang", "source", "n_chars"), none):
        for name, stage in CP.STAGES:
            docs = written(stage(spark, docs, data), f"odd-{name}")
        assert docs.columns == ["doc_id", "start", "n_tokens", "ids_crc32"]
