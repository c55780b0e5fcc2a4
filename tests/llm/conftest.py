import pytest
from pyspark.sql import types as T

# Extra columns whose names the operators use themselves.
CLASHING = ("id", "key", "rep", "a", "b", "shard", "spans", "rules", "score", "same_id", "__text", "__id", "text_key", "host")
LONG = "Thonre was is anly hend and, oftionnten. " * 6000


def document_schema():
    names = [T.StructField(c, T.StringType()) for c in CLASHING]
    own = [T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType())]
    return T.StructType([*own, T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType()), *names])


@pytest.fixture(scope="session")
def frame(spark):
    """Documents from (doc_id, text) pairs, with extra columns."""

    def make(pairs):
        rest = tuple("x" for _ in CLASHING)
        rows = [(i, t, None, "s", None if t is None else len(t), *rest) for i, t in pairs]
        return spark.createDataFrame(rows, document_schema())

    return make


@pytest.fixture(scope="session")
def edge_pairs():
    """Nulls, empty, blank and very long texts, ties and repeated rows."""
    words = " ".join(f"w{i}" for i in range(40))
    return [
        (1, None), (2, ""), (3, " \t\n"), (4, "one"), (5, "one two  three"), (6, LONG), (7, words), (7, words), (8, words),
        (None, words), (None, None), (9, "é <|endoftext|> ünï\u0085x 🙂 'tis  it's"), (10, "a" * 30000), (-3, "\n\n a\n b"), (1 << 40, "ONE"),
    ]
