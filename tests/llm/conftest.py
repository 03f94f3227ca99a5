import pytest
from pyspark.sql import types as T

DOCS = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        T.StructField("text", T.StringType()),
        # Names that the operators use themselves: they must not clash.
        T.StructField("id", T.StringType()),
        T.StructField("text_key", T.StringType()),
        T.StructField("node", T.StringType()),
        T.StructField("state", T.StringType()),
    ]
)


@pytest.fixture(scope="session")
def make_docs(spark):
    """A documents table with further columns of awkward names."""

    def make(rows):
        return spark.createDataFrame([(i, t, "x", None, "y", "z") for i, t in rows], DOCS).repartition(3)

    return make


@pytest.fixture(scope="session")
def awkward():
    """Nulls, empty and blank texts, repeated rows, one very long text."""
    long_text = " ".join(f"word{i % 977} und{i % 31}" for i in range(40_000))
    return [(1, None), (None, "a b c"), (None, None), (2, ""), (3, "  \n \n"), (4, "one two three"), (4, "one two three"),
            (4, "another text"), (5, long_text), (6, "ünï çödé 漢字 🙂 \x00\x1f"), (7, "x" * 30_000)]
