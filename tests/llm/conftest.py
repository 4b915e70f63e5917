import pytest
from pyspark.sql import types as T

LONG = "lorem ipsum dolor sit amet " * 4_000


@pytest.fixture(scope="session")
def docs(spark):
    """Nulls, empty and very long texts, ties, repeated rows and columns whose names clash with internal ones."""
    rows = [
        (1, "The quick brown fox jumps over the lazy dog near the river bank today", "en", "a"),
        (2, "The quick  brown fox\tjumps over the lazy dog near the river bank today", "en", "b"),
        (3, None, None, "c"), (4, "", "en", "d"), (5, "   \n\t ", None, None),
        (6, LONG, "la", "e"), (7, LONG, "la", "e"), (7, LONG, "la", "e"),
        (None, "a text without a key", "en", "f"), (9, "1234 !!", "en", "g"),
        (10, "The quick brown fox jumps over the lazy dog near the river bank TODAY", "en", "h"),
        (11, "Größe und Länge, ▁ sowie 日本 🙂", "de", "i"),
    ]
    schema = T.StructType([
        T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()),
        T.StructField("lang", T.StringType()), T.StructField("row", T.StringType())])
    extra = spark.createDataFrame(rows, schema)
    for name in ("key", "fp", "digest", "bucket", "number", "n", "words", "_maybe", "rec"):
        extra = extra.selectExpr("*", f"row AS {name}")
    return extra.selectExpr("*", "row AS `an odd, name`")


@pytest.fixture(scope="session")
def no_docs(docs):
    return docs.limit(0)


@pytest.fixture(scope="session")
def small_docs(spark):
    return spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
