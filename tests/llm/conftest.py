import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

DOCUMENTS = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()), T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType())])


@pytest.fixture(scope="session")
def docs(spark, data):
    return spark.read.parquet(f"{data}/documents.parquet")


@pytest.fixture(scope="session")
def make(spark):
    """Documents from texts, or from (doc_id, text, lang, source)."""

    def build(rows):
        full = [(i, r, "en", "s") if not isinstance(r, tuple) else r for i, r in enumerate(rows)]
        return spark.createDataFrame([(i, t, lang, s, len(t or "")) for i, t, lang, s in full], DOCUMENTS)

    return build


@pytest.fixture(scope="session")
def odd(make):
    """Nulls in every column, empty and white texts, a very long text, ties, repeated rows and clashing columns."""
    long_text = " ".join(f"word{i % 977} of the day," for i in range(30_000))
    rows = [
        (1, "the quick brown fox. " * 30, "en", "a"), (1, "the quick brown fox. " * 30, "en", "a"), (2, None, "en", "a"), (3, "", None, "b"), (4, " \t\n\x0b\x0c\r ", "en", None),
        (None, "a text without an id", "en", "b"), (None, None, None, None), (5, long_text, "en", "b"), (6, "der schnelle fuchs und der hund. " * 20, "de", None), (6, "another text of six", "de", "a"),
        (7, "x", "en", "b"), (8, "é ß \U0001f600 1234 !!", "de", "c"), (9, "the quick brown fox. " * 30, "en", "b"),
    ]
    clash = ["size", "shard", "slot", "unit", "bucket", "h", "fp", "idx", "start", "taken", "tie", "uid", "length", "score", "held_out", "rank", "n", "spans", "hashes", "lang_pred", "Text_Crc32", "target", "kept", "toxic"]
    return make(rows).withColumns({c: F.lit("clash") for c in clash})


@pytest.fixture(scope="session")
def none(make):
    return make([])
