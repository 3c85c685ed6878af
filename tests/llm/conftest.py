import pytest
from pyspark.sql import types as T

LONG = "the quick brown fox jumps over the lazy dog and then " * 2000

TEXTS = [
    (1, "The quick brown fox jumps over the lazy dog.\nA second line here.", "en", "a"), (2, None, "en", "a"), (3, "", None, None), (4, LONG, "en", "b"),
    (5, "Der schnelle braune Fuchs springt über den faulen Hund und läuft weiter.", "de", "b"), (5, "Der schnelle braune Fuchs springt über den faulen Hund und läuft weiter.", "de", "b"),
    (7, "  \t\n \x0b\x0c ", None, "a"), (8, "12345 67890 !!! ???", "en", "a"), (None, "Words without an id are words all the same here.", "en", None),
    (10, "é ü x 日本語 \U0001f600 á", "de", "a"), (11, "The quick brown fox jumps over the lazy dog.\nA second line here!", "en", "a"),
]

SCHEMA = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()), T.StructField("source", T.StringType())])


@pytest.fixture(scope="session")
def docs(spark):
    """Nulls in every column, empty and very long texts, a repeated row."""
    return spark.createDataFrame(TEXTS, SCHEMA).repartition(3).cache()


@pytest.fixture(scope="session")
def none(docs):
    return docs.limit(0)


def clash(df, *names):
    """The frame with extra columns, some named as an operator names its own."""
    from pyspark.sql import functions as F

    for n in names:
        df = df.withColumn(n, F.lit("mine"))
    return df.withColumn("extra", F.lit(7))
