import pytest
from pyspark.sql import types as T

DOCUMENTS = "doc_id bigint, text string, lang string, source string, n_chars bigint"


@pytest.fixture
def documents(spark):
    """Builds a table of documents from texts, or from (doc_id, text)."""

    def build(rows):
        rows = [(i, t) if not isinstance(t, tuple) else t for i, t in enumerate(rows)]
        return spark.createDataFrame([(d, t, "en", "src0", None if t is None else len(t)) for d, t in rows], DOCUMENTS)

    return build


@pytest.fixture
def awkward(spark):
    """Nulls in every column, empty, blank and very long texts, ties, repeated rows and columns of clashing names."""
    long_text = " ".join(f"word{i % 977} end." for i in range(60_000))
    rows = [
        (1, "one two three four five six seven eight nine ten eleven twelve thirteen.", 1, "a"),
        (1, "one two three four five six seven eight nine ten eleven twelve thirteen.", 1, "a"),
        (2, None, None, None),
        (3, "", 0, ""),
        (4, " \n\t\n ", 0, "x"),
        (None, "alpha beta gamma delta epsilon zeta eta theta.\nsecond line of a document here.", 5, None),
        (None, None, None, None),
        (5, long_text, len(long_text), "long"),
        (6, "one two three four five six seven eight nine ten eleven twelve thirteen.", 7, "copy"),
        (7, "ЁЖ ñandú 漢字 \x00 \x1f İ", 7, None),
    ]
    schema = T.StructType(
        [T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("n", T.IntegerType()), T.StructField("cell", T.StringType())]
        + [T.StructField(c, T.StringType()) for c in ("row_key", "lines_dropped", "hash", "word", "node", "label", "low_quality", "line", "shard", "words")]
    )
    return spark.createDataFrame([(*r, *["clash"] * 10) for r in rows], schema)


@pytest.fixture
def nothing(spark):
    return spark.createDataFrame([], DOCUMENTS)
