"""Sinks: totals, JSON lines, JSON documents, chunk text, evidence, tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def run_totals(pages: DataFrame) -> DataFrame:
    """SNK1, AG1: one row: totalScraped (every page emitted), totalErrors, durationMs."""
    took = F.max("responseTimeMs") if "responseTimeMs" in pages.columns else F.lit(None).cast("int")
    return pages.agg(F.count("*").alias("totalScraped"), F.count_if(F.col("status") == "error").alias("totalErrors"), took.alias("durationMs"))


def charged(pages: DataFrame, dry_run: bool = False) -> DataFrame:
    """SNK5, AG14: successful pages to bill, none in a dry run."""
    return pages.agg(F.count_if((F.col("status") == "success") & F.lit(not dry_run)).alias("charged"))


def write_json_lines(pages: DataFrame, path: str) -> None:
    """SNK2."""
    pages.write.mode("append").json(path)


def append_table(pages: DataFrame, path: str) -> None:
    """SNK4: append-only dataset."""
    pages.write.mode("append").parquet(path)


def put_values(values: DataFrame, path: str) -> None:
    """SNK4: a store by key (key, content, contentType): what is written last under a key counts."""
    values.select("key", F.col("content").cast("binary").alias("content"), "contentType", F.current_timestamp().alias("at")).write.mode("append").parquet(path)


def get_values(spark: SparkSession, path: str) -> DataFrame:
    """key, content, contentType of the store."""
    last = F.max_by(F.struct("content", "contentType"), "at")
    return spark.read.parquet(path).groupBy("key").agg(last.alias("v")).select("key", "v.*")


def json_document(pages: DataFrame) -> DataFrame:
    """SNK3: one JSON text a page, null fields left out; a file of them is one ``write.text``."""
    return pages.select(F.to_json(F.struct("*")).alias("value"))


def chunk_text(markdown: Column, chunks: Column) -> Column:
    """SNK6: the Markdown, then a headed block for each chunk."""
    block = lambda c: F.concat(F.lit("\n\n--- chunk "), c["index"].cast("string"), F.coalesce(F.concat(F.lit(" ("), c["section"], F.lit(")")), F.lit("")), F.lit(" ---\n"), c["text"])
    return F.concat(F.coalesce(markdown, F.lit("")), F.array_join(F.coalesce(F.transform(chunks, block), F.array().cast("array<string>")), ""))


def evidence(results: DataFrame, contract: str) -> DataFrame:
    """SNK7: one JSON text a result, with the contract's name."""
    return results.select(F.to_json(F.struct(F.lit(contract).alias("contract"), F.struct("*").alias("result"))).alias("value"))
