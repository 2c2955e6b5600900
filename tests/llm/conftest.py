import pytest

# Documents with every odd shape: nulls, empty and long texts, ties, repeated rows, a clashing column.
ODD = [
    (1, "The cat sat on the mat and the dog ran off to the hills", "en", "a"),
    (2, "The cat sat on the mat and the dog ran off to the hills", "en", "a"),
    (2, "The cat sat on the mat and the dog ran off to the hills", "en", "a"),
    (3, None, "en", "a"),
    (4, "", "de", "b"),
    (5, "   \t\n ", None, "b"),
    (6, "word " * 9000, "en", None),
    (None, "no id here but some words to read", "en", "b"),
    (7, "12345 !!! 999", None, "c"),
    (8, "Der Hund und die Katze liefen über den Hof", "de", "c"),
]
SCHEMA = "doc_id bigint, text string, lang string, source string"


@pytest.fixture(scope="session")
def odd(spark):
    """Rows of every odd shape, with columns whose names clash with results and helpers."""
    from pyspark.sql import functions as F

    frame = spark.createDataFrame(ODD, SCHEMA).withColumn("n_chars", F.length("text").cast("bigint"))
    for name in ("id", "key", "n", "size", "shard", "slot", "score", "kept", "label", "block", "accepted", "piece", "target"):
        frame = frame.withColumn(name, F.lit("x"))
    return frame


@pytest.fixture(scope="session")
def nothing(odd):
    return odd.limit(0)


@pytest.fixture(scope="session")
def documents(spark, folder):
    return spark.read.parquet(f"{folder}/documents.parquet")
