"""Embedding requests and responses."""

from __future__ import annotations

from collections.abc import Iterator
from typing import Protocol

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessella.functions.storage import stored
from tessella.functions.text import chunk_text

BATCH = 16


class Embedder(Protocol):
    """Called on executors: one vector for each text, in order."""

    def embed(self, texts: list[str]) -> list[list[float]]: ...


def requests(texts: DataFrame, key: str, order: str, text: str, size: int = BATCH) -> DataFrame:
    """EM1, W6: key, batch, input: the texts of each key in order, ``size`` a batch.

    Rows are range-sorted by key and order, then stored with their place, so a key with most rows is
    spread over partitions; a window sees one row for each key and partition.
    """
    n = int(texts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = texts.select(F.col(key).alias("k"), F.col(order).alias("o"), F.col(text).alias("t"))
    rows = rows.repartitionByRange(n, "k", "o").sortWithinPartitions("k", "o")
    low = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    rows = stored(rows.select("*", F.spark_partition_id().alias("pid"), low.alias("at")), "texts")
    runs = rows.groupBy("k", "pid").agg(F.count("*").alias("n"), F.min("at").alias("first"))
    before = F.sum("n").over(Window.partitionBy("k").orderBy("pid")) - F.col("n") - F.col("first")
    runs = runs.select(F.col("k").alias("rk"), F.col("pid").alias("rp"), before.alias("shift"))
    placed = rows.join(runs, F.col("k").eqNullSafe(F.col("rk")) & (F.col("pid") == F.col("rp")))
    batch = F.floor((F.col("at") + F.col("shift")) / max(1, size))
    got = placed.groupBy("k", batch.alias("batch")).agg(F.transform(F.array_sort(F.collect_list(F.struct("o", "at", "t"))), lambda x: x.t).alias("input"))
    return got.select(F.col("k").alias(key), "batch", "input")


def response_vectors(response: Column) -> Column:
    """JS8, TK7: the vectors of a response's JSON text, by index, or by place where an item has none."""
    data = F.from_json(response, "struct<data:array<struct<index:int,embedding:array<double>>>>")["data"]
    placed = F.transform(data, lambda d, i: F.struct(F.coalesce(d["index"], i).alias("i"), i.alias("p"), F.coalesce(d["embedding"], F.array().cast("array<double>")).alias("v")))
    return F.coalesce(F.transform(F.array_sort(placed), lambda x: x.v), F.array().cast("array<array<double>>"))


def matched(requests: DataFrame, responses: DataFrame, key: str) -> DataFrame:
    """J9: key, batch, index, text, vector; a response with another number of vectors than inputs is an error."""
    df = requests.join(responses.select(key, "batch", response_vectors(F.col("response")).alias("vectors")), [key, "batch"])
    said = F.concat(F.lit("embedding response has "), F.size("vectors").cast("string"), F.lit(" vectors for "), F.size("input").cast("string"), F.lit(" inputs"))
    checked = F.when(F.size("vectors") == F.size("input"), F.arrays_zip("input", "vectors")).otherwise(F.raise_error(said).cast("array<struct<input:string,vectors:array<double>>>"))
    return df.select(key, "batch", F.posexplode(checked).alias("index", "x")).select(key, "batch", "index", F.col("x.input").alias("text"), F.col("x.vectors").alias("vector"))


def totals(vectors: DataFrame, vector: str) -> DataFrame:
    """AG15: dims (of the first by id order) and count."""
    return vectors.agg(F.coalesce(F.min_by(F.size(vector), "vec_id"), F.lit(0)).alias("dims"), F.count("*").alias("n"))


def embed_texts(texts: DataFrame, embedder: Embedder, text: str = "text", size: int = BATCH) -> DataFrame:
    """EM2: every column of ``texts`` and vector; a wrong number of vectors fails the run."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows, out = b.column(text).to_pylist(), []
            for s in range(0, len(rows), size):
                got = embedder.embed(rows[s : s + size])
                if len(got) != len(rows[s : s + size]):
                    raise ValueError(f"{len(got)} vectors for {len(rows[s : s + size])} texts")
                out += got
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(out, pa.list_(pa.float32()))], names=[*b.schema.names, "vector"])

    from pyspark.sql import types as T

    return texts.mapInArrow(run, T.StructType([*texts.schema.fields, T.StructField("vector", T.ArrayType(T.FloatType()))]))


CHUNKS = "array<struct<text:string,index:int,section:string,charCount:int,hash:string>>"


def chunked(size: int, overlap: int):  # noqa: ANN201
    """ST1 as a column function."""

    @F.pandas_udf(CHUNKS)
    def chunks(text):  # noqa: ANN001, ANN202
        return text.map(lambda t: chunk_text(t, size, overlap))

    return chunks


def embed_markdown(pages: DataFrame, embedder: Embedder, size: int = 1200, overlap: int = 200) -> DataFrame:
    """EM3: url, index, section, text, vector for each chunk of each page's markdown."""
    rows = pages.select("url", F.explode(chunked(size, overlap)("markdown")).alias("c")).select("url", F.col("c.index").alias("index"), F.col("c.section").alias("section"), F.col("c.text").alias("text"))
    return embed_texts(rows, embedder)
