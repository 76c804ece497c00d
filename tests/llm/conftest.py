import pytest
from pyspark.sql import types as T

DOCS = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        T.StructField("text", T.StringType()),
        T.StructField("lang", T.StringType()),
        T.StructField("source", T.StringType()),
        # names that operators use for themselves
        T.StructField("uid", T.StringType()),
        T.StructField("score", T.StringType()),
        T.StructField("n", T.StringType()),
    ]
)
LONG = " ".join(f"word{k % 997} and{k % 31}" for k in range(15_000))


def rows():
    base = [
        (1, "The quick brown fox jumps over the lazy dog and runs away.", "en"),
        (2, None, "en"),
        (3, "", None),
        (4, "   \n\t ", "en"),
        (5, "one two", "fr"),
        (6, LONG, "en"),
        (7, "The quick brown fox jumps over the lazy dog and runs away.", "de"),
        (7, "The quick brown fox jumps over the lazy dog and runs away.", "de"),
        (None, "no id here, but text", None),
        (9, "é ñ 😀 日本 ﬁ  x\n\nline two\nline two", "es"),
    ]
    return [(i, t, g, "s", "u", "sc", "nn") for i, t, g in base]


@pytest.fixture(scope="session")
def docs(spark):
    return spark.createDataFrame(rows(), DOCS)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], DOCS)
