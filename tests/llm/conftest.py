import pytest
from pyspark.sql import types as T


@pytest.fixture(scope="session")
def odd(spark):
    """Documents with nulls, empty and very long texts, repeats, null ids, and columns whose names clash."""
    long_text = "word number " * 30_000
    rows = [
        (1, "Plain words of a short text.", "en"),
        (2, None, "en"),
        (3, "", None),
        (4, "   \n\t ", "en"),
        (5, "!!! ... ???", None),
        (6, long_text, "en"),
        (7, "Plain words of a short text.", "en"),
        (7, "Plain words of a short text.", "en"),
        (None, "Plain words of a short text.", "fr"),
        (8, "x", None),
        (9, "Ünïcödé 中文 ñandú \U0001f600 text", "zz"),
    ]
    schema = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()), T.StructField("TEXT", T.StringType()), T.StructField("accepted", T.StringType()), T.StructField("group_id", T.IntegerType()), T.StructField("n_tokens", T.StringType())])
    return spark.createDataFrame([(*r, "other", "mine", 5, "n") for r in rows], schema)


@pytest.fixture(scope="session")
def none(odd):
    return odd.limit(0)
