import pytest


@pytest.fixture(scope="session")
def data():
    import os

    folder = "/root/testdata/sf0.001"
    if not os.path.isdir(folder):
        pytest.skip("no tables")
    return folder


@pytest.fixture
def odd(spark):
    """Nulls in every column, empty, blank and long texts, ties, repeated rows, and columns with clashing names."""
    from pyspark.sql import functions as F

    rows = [
        (1, "Alpha beta gamma delta epsilon zeta eta theta iota kappa", "en", "a", 10), (2, "Alpha beta gamma delta epsilon zeta eta theta iota kappa", "en", "b", 10), (2, "Alpha beta gamma delta epsilon zeta eta theta iota kappa", "en", "b", 10),
        (3, None, "en", "a", None), (4, "", None, None, 0), (5, " \n\t ", "fr", "c", 4), (6, "word " * 60_000, "en", "a", 300_000), (None, "Text without an id here", "en", None, 1), (7, "é " * 5 + "ünïcode wide", None, "c", 3), (8, "!!! 123", "en", "a", 7), (9, "x", "en", None, 1),
    ]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    clash = {c: F.lit(c) for c in ("key", "size", "shard", "slot", "node", "n", "row", "position", "hits", "n_hit", "lang_pred", "spans", "passes", "pid", "idx", "copy", "ids")}
    return df.withColumns(clash)


@pytest.fixture
def none(spark):
    return spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
