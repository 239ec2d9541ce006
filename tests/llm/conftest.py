import pytest
from pyspark.sql import types as T

#: Columns whose names operators use inside, too.
FIELDS = [("doc_id", T.LongType()), ("text", T.StringType()), ("lang", T.StringType()), ("source", T.StringType()), ("row", T.StringType()), ("n", T.StringType()), ("key", T.StringType())]


@pytest.fixture(scope="session")
def documents(spark):
    """Makes a table of (doc_id, text) rows with further columns."""

    def make(rows, lang="en", source="s"):
        return spark.createDataFrame([(i, t, lang, source, "r", None, "k") for i, t in rows], T.StructType([T.StructField(n, t) for n, t in FIELDS]))

    return make


#: Null and empty texts, repeated rows, a null id, a text of one kind of byte, other scripts.
ODD = [(900, None), (901, ""), (902, " \n\t "), (903, "a"), (903, "a"), (None, "b c"), (None, None), (904, "x" * 30000), (905, "日本語 テキスト 😀 İ Σς"), (906, "▁ ▁a"), (907, "q\x00\x0b\x1c r")]
