"""Small tables that the tests of the corpus operators share."""

from pyspark.sql import types as T

#: documents with extra columns whose names clash with the operators' own.
DOCUMENTS = T.StructType([
    T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()),
    T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType()), T.StructField("key", T.StringType()), T.StructField("id", T.StringType()),
    T.StructField("hash", T.IntegerType()), T.StructField("score", T.DoubleType()),
])

#: Texts that every operator must get through: null, empty, blank, one word, symbols, very long, one endless word, controls.
ODD_TEXTS = [None, "", " \t\n\x0b\x0c\r ", "word", "### $$$ %%% |||", "long text here " * 20_000, "x" * 200_000, "a\x00b     c", "café \U0001f389 漢字", "same text", "same text"]
