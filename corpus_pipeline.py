"""Corpus pipeline: language, near duplicates, decontamination, mixing, token files.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; ``run`` writes each result as Parquet to
the shared folder and reads it again as the documents of the next stage. All stages but the last
return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.llm import decontaminate, language, mixing, near_dup, token_file
from tessella.llm.common import written

#: A document whose language is predicted with less than this probability is rejected.
LEAST_SCORE = 0.5


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents without a letter (null and empty texts among them), and those of no clear language.

    The model learns from the labelled rows of its input. Where no row has a language, only documents
    without a letter go. A document that stays without a language gets the one predicted. Texts are read
    whole; of equal scores the first language by name counts; repeated rows are judged each; an empty
    table stays empty; other columns pass, whatever their names.
    """
    model = language.train(docs)
    known = bool(model.languages)
    if not known:
        model = language.train(docs.withColumn("lang", F.lit("any")))
    away = {c: f"__{c}" for c in ("lang_pred", "lang_score") if c in docs.columns}  # the operator's own names
    said = language.identify(docs.withColumnsRenamed(away), model)
    said = said.filter((F.col("lang_pred") != language.UNKNOWN) & (F.col("lang_score") >= LEAST_SCORE))
    if known:
        said = said.withColumn("lang", F.coalesce("lang", "lang_pred"))
    return said.select(*(F.col(away.get(c, c)).alias(c) for c in docs.columns))


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near duplicates stays: that of the smallest id, null ids last.

    Word shingles of five words, similarity 0.8 or more, over whole texts. Rows are told apart by id and
    text: different texts of one id are judged apart, and of repeated rows one stays. Documents without
    words (null and empty texts among them) are linked with nothing and stay. An empty table stays empty;
    other columns pass as they are.
    """
    return near_dup.one_of_each(docs, 5, 4, 5)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a word in a benchmark window go.

    Null and empty texts have no words and stay, and so do texts without a whole window, however long.
    Repeated rows go or stay alike. An empty benchmark takes nothing, an empty table stays empty. Other
    columns pass, but for those named as the operator's own.
    """
    found = decontaminate.decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return found.filter(~F.col("contaminated")).select(*docs.columns)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row for each pass of a document, in order of training position.

    A pass of which the mix wants at least half stays, with its whole text; documents without words
    (null and empty texts) have none. Sources that are null are one source. Repeated rows have passes
    each. Rows of one position are in order of id. An empty table stays empty; other columns pass.
    """
    return mixing.mix(docs).select(*docs.columns)


def token_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token files of all rows in order of id, read back: doc_id, start, n_tokens, ids_crc32.

    Null ids come first; rows of one id are in the order of the table. A null or empty text is the end id
    alone; long texts are whole; repeated rows give a row each; an empty table gives none. Other columns
    aren't read.
    """
    return token_file.token_digest(docs)


STAGES = [
    ("language", language_stage),
    ("near_duplicates", near_duplicate_stage),
    ("decontamination", decontamination_stage),
    ("mixing", mixing_stage),
    ("tokens", token_stage),
]

#: No SQL here knows the tokenizer; tests hold each stage against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return written(STAGES[-1][1](spark, docs, sf_dir), f"pipeline-{STAGES[-1][0]}")
