import pytest
from pyspark.sql import types as T

DOCUMENTS = T.StructType([
    T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()),
    T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType())])

#: Extra columns whose names clash with those that operators make.
CLASHING = ["n_words", "n_tokens", "h", "k", "row", "fp", "score", "id", "rest", "places", "u", "v", "run", "length", "kept", "x"]


@pytest.fixture(scope="session")
def make_docs(spark):
    """Rows of (doc_id, text[, lang]) as a documents table."""

    def make(rows, clashing: bool = False):
        full = [(r[0], r[1], r[2] if len(r) > 2 else "en", "s", None if r[1] is None else len(r[1])) for r in rows]
        df = spark.createDataFrame(full, DOCUMENTS)
        if clashing:
            from pyspark.sql import functions as F

            df = df.select("*", *[F.lit(7).alias(c) for c in CLASHING])
        return df

    return make


@pytest.fixture(scope="session")
def odd_rows():
    """Nulls, empty and blank texts, a long text, ties and repeated rows."""
    words = " ".join(f"word{i % 911}" for i in range(30_000))
    return [(1, None), (2, ""), (3, " \n\t "), (4, "one"), (4, "one"), (None, "no id here"), (None, None), (5, words), (6, words),
            (7, "x" * 3_000), (8, "The MIT license, é 漢字 Σ!"), (9, "a\x00b\x1fc\x85d e"), (9, "other text of the same id"), (-3, "one")]
