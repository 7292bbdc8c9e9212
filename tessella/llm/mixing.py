"""Mixing sources to target weights by a time-varying curriculum.

Training runs over positions t in [0, 1). Source s has a weight schedule w_s(t), which is never
negative and linear: its share moves from (1 + tilt) to (1 - tilt) of its mean, or the other way.
The integral of the schedule up to t, times the mix's words, is the source's cumulative token demand
D_s(t), and D_s(1) is its target. The source's documents, in an order by hash, are laid out one after
another, pass after pass. A document's middle token m gets the position where the demand reaches it:
the t with D_s(t) = m. The mix is range-sorted by position. A pass of a document holds the part of the
mix between the positions of its first and last token, and gives the words that the schedule asks for
there, its integral over that part: a document that the last pass reaches only in part gives the words up
to the demand's end.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessella.llm.common import bit_field, in_field, placed, shuffle_parts, with_rank, written

#: Weights of sources in order of name, repeating; most passes over a source; words of the mix, of all words.
WEIGHTS = (5, 2, 1)
MOST = 3
SHARE = 1.0
#: Slope of the schedules: sources in odd places of the order come early, the others late.
TILT = 0.5


def word_count(text: Column) -> Column:
    """Number of runs of what isn't ASCII white space; null: 0."""
    return F.coalesce(F.length(F.regexp_replace(F.regexp_replace(text, r"[^\x20\x09-\x0D]+", "\x01"), r"[\x20\x09-\x0D]+", "")), F.lit(0)).cast("long")


def targets(sources: DataFrame, total: float, most: float = MOST) -> DataFrame:
    """``sources`` (size, weight) with target: shares of ``total`` by weight; none above ``most`` times its size, the excess shared again by weight.

    Targets are the lesser of a source's bound and level * weight; each round takes the sources that the
    last level has brought to their bound out of the sharing. The driver sees sums alone.
    """
    all_ = sources.agg(F.sum("weight").alias("w")).first().w
    level, closed = total / all_ if all_ else 0.0, -1
    while True:
        bound = F.col("size") * F.lit(float(most)) < F.col("weight") * F.lit(level)
        r = sources.agg(F.coalesce(F.sum(F.when(bound, F.col("size"))), F.lit(0)).alias("size"), F.coalesce(F.sum(F.when(~bound, F.col("weight"))), F.lit(0.0)).alias("weight"), F.count_if(bound).alias("n")).first()
        if r.n == closed or not r.weight:
            return sources.withColumn("target", F.when(bound, F.col("size") * F.lit(float(most))).otherwise(F.col("weight") * F.lit(level)))
        level, closed = max(0.0, total - most * r["size"]) / r.weight, r.n


def demand(t: Column, target: Column, tilt: Column) -> Column:
    """Words of the source that the mix has asked for up to position t."""
    return target * (t * (1 + tilt) - tilt * t * t)


def position(words: Column, target: Column, tilt: Column) -> Column:
    """The t at which the demand reaches ``words``: the inverse of ``demand`` on [0, 1]."""
    u = words / target
    root = F.sqrt(F.greatest(F.lit(0.0), (1 + tilt) * (1 + tilt) - 4 * tilt * u))
    return F.when(u > 0, F.least(F.lit(1.0), 2 * u / (1 + tilt + root))).otherwise(F.lit(0.0))


def _running(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of sorted partitions (pid, idx) -> the words of the same source in the partition up to the row."""
    last, sums = (None, None), 0
    for b in batches:
        size = b.column("size").to_numpy()
        names = b.column("source").to_pylist()
        parts = b.column("pid").to_numpy()
        out = np.empty(len(size), np.int64)
        s = 0
        while s < len(size):
            e = s + 1
            here = (parts[s], names[s])
            while e < len(size) and names[e] == names[s] and parts[e] == parts[s]:
                e += 1
            base = sums if here == last else 0
            out[s:e] = base + np.cumsum(size[s:e]) - size[s:e]
            sums, last, s = int(out[e - 1] + size[e - 1]), here, e
        yield pa.RecordBatch.from_pydict({n: b.column(n) for n in b.schema.names} | {"before": pa.array(out)})


def plan_mix(docs: DataFrame, weights=WEIGHTS, share: float = SHARE, most: float = MOST, tilt: float = TILT, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", hashed: list[str] | None = None) -> DataFrame:
    """doc_id, source, size, source_size, target, taken, passes (array of words, position) for each row.

    Sources are ordered by code point, null last (null is a source of its own), and take ``weights`` in
    turn. Their targets share ``share`` of all words; none goes above ``most`` times its source. A null
    or empty text has size 0 and no passes, and so has a source without words. Rows of a source are
    ordered by a hash of the columns ``hashed`` (id, text and source), so that reruns agree; repeated rows
    are rows of their own. Texts are taken whole. An empty table gives no rows. Other columns aren't read.
    There may be any number of sources: their table is never on the driver. The sort moves narrow rows
    only, and a source or a repeated row that holds most rows is spread over partitions.
    """
    spark = docs.sparkSession
    hashed = [id_col, text_col, source_col] if hashed is None else hashed
    rows = docs.select(
        F.col(id_col).cast("long").alias("doc_id"), F.col(source_col).cast("string").alias("source"), word_count(F.col(text_col)).alias("size"),
        F.xxhash64(*hashed).alias("mixed"), F.xxhash64(F.lit(1), *hashed).alias("mixed2"), F.monotonically_increasing_id().alias("row"),
    )
    # Ordered by hash first: each partition has a part of every source, whatever their sizes. Equal rows are told apart by number.
    rows = placed(written(rows, "sizes"), F.col("mixed"), F.col("mixed2"), F.col("row"))
    by_part = rows.repartition(shuffle_parts(spark), "pid").sortWithinPartitions("pid", "source", "idx")
    laid = by_part.mapInArrow(_running, rows.schema.add("before", "long"))
    sums = written(rows.groupBy("source", "pid").agg(F.sum("size").alias("words")), "sums")
    shift = sums.withColumn("shift", F.sum("words").over(Window.partitionBy("source").orderBy("pid")) - F.col("words")).select("source", "pid", "shift")

    sources = sums.groupBy("source").agg(F.sum("words").alias("size"))
    sources = with_rank(placed(sources, F.col("source").isNull(), F.col("source")))
    turn = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("rank") % len(weights) + 1).cast("int"))
    sources = written(sources.select("source", "size", turn.alias("weight"), F.when(F.col("rank") % 2 == 1, tilt).otherwise(-tilt).alias("tilt")), "sources")
    total = sources.agg(F.coalesce(F.sum("size"), F.lit(0)).alias("n")).first().n
    table = targets(sources, share * total, most).withColumnRenamed("size", "source_size")

    # A row for each source and partition; small beside the documents, and joined by both.
    offsets = shift.join(table, shift.source.eqNullSafe(table.source)).select(shift.source.alias("s"), F.col("pid").alias("p"), "shift", "source_size", "target", "tilt")
    all_ = laid.join(offsets, laid.source.eqNullSafe(F.col("s")) & (laid.pid == F.col("p")))
    start, curve = F.col("before") + F.col("shift"), (F.col("target"), F.col("tilt"))

    # A place is bound once by each transform, as expressions in them are evaluated as often as they are written.
    def part(k: Column) -> Column:
        at = k * F.col("source_size") + start
        return F.struct(at.alias("at"), position(at, *curve).alias("low"), position(at + F.col("size"), *curve).alias("high"))

    def asked(p: Column) -> Column:
        return F.struct(p["at"].alias("at"), (F.round(demand(p["high"], *curve)) - F.round(demand(p["low"], *curve))).cast("long").alias("words"))

    def one(p: Column) -> Column:
        return F.struct(p.words.alias("words"), position(p["at"] + p.words / 2, *curve).alias("position"))

    parts = F.transform(F.sequence(F.lit(0), F.lit(int(np.ceil(most)) - 1)), part)
    passes = F.transform(F.filter(F.transform(parts, asked), lambda p: p.words > 0), one)
    passes = F.when(F.col("size") > 0, passes).otherwise(F.array().cast("array<struct<words:bigint,position:double>>"))
    out = all_.select("doc_id", "source", "size", "source_size", "target", "mixed", "mixed2", passes.alias("passes"))
    return out.withColumn("taken", F.aggregate("passes", F.lit(0).cast("long"), lambda a, p: a + p.words))


def mix(docs: DataFrame, **options) -> DataFrame:
    """The mix: every column of ``docs`` for each pass of a document, with pass_words and position, range-sorted by position.

    Columns of ``docs`` with these names are replaced, others pass. Texts are whole. A pass of which the
    demand reaches less than half of the words is left out, and so is a document without words (null or
    empty text). Rows meet their plan by 128 bits of a hash of all columns (but maps); rows that are equal in all
    of them have a plan each, and one of them stands for all their passes. An empty table gives no rows.
    """
    docs = docs.drop("pass_words", "position")
    names = docs.columns
    hashed = [f.name for f in docs.schema if "map<" not in f.dataType.simpleString()]
    plan = written(plan_mix(docs, hashed=hashed, **options).select(F.col("mixed").alias("__a"), F.col("mixed2").alias("__b"), "size", "passes"), "mix")
    passes = plan.select("__a", "__b", F.explode("passes").alias("p"), "size").filter(F.col("p.words") * 2 >= F.col("size"))
    passes = passes.select("__a", "__b", F.col("p.words").alias("pass_words"), F.col("p.position").alias("position"))
    many = written(plan.groupBy("__a", "__b").agg(F.count("*").alias("n")).filter("n > 1").select("__a", "__b"), "repeated")
    marked = docs.withColumns({"__a": F.xxhash64(*hashed), "__b": F.xxhash64(F.lit(1), *hashed)})
    rows = in_field(marked, "__a", bit_field(passes.select("__a").distinct(), "__a"))
    if not many.isEmpty():
        same = ["__a", "__b"]
        rows = rows.join(many, same, "left_anti").select(marked.columns).union(rows.join(many, same, "left_semi").dropDuplicates(same).select(marked.columns))
    out = rows.join(passes, ["__a", "__b"]).select(*names, "pass_words", "position")
    return out.repartitionByRange(shuffle_parts(docs.sparkSession), "position", options.get("id_col", "doc_id")).sortWithinPartitions("position", options.get("id_col", "doc_id"))


def op7_mixing(spark, sf_dir: str) -> DataFrame:
    """The plan's rows, with the places of a document's first and last pass in the mix (null: it has none)."""
    plan = plan_mix(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    places = F.transform("passes", lambda p: p.position)
    return plan.select("doc_id", "size", "source_size", "target", "taken", F.array_min(places).alias("first_position"), F.array_max(places).alias("last_position"))
