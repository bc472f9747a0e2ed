"""Tables and helpers the tests of this folder share."""

from pyspark.sql import types as T

DOCUMENTS = T.StructType([
    T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()),
    T.StructField("lang", T.StringType()), T.StructField("digest", T.StringType()),
    T.StructField("row", T.IntegerType()), T.StructField("rec", T.StringType())])

#: Nulls, empty and long texts, ties, repeated rows and columns named like the operators' own.
ODD_ROWS = [
    (1, "the quick brown fox jumps over the lazy dog. " * 30, "en", "a", 7, None),
    (2, "the quick brown fox jumps over the lazy dog. " * 30, None, "b", 7, "x"),
    (2, "the quick brown fox jumps over the lazy dog. " * 30, None, "b", 7, "x"),
    (3, None, "de", None, None, None), (4, "", None, None, None, None), (5, "   \n\t ", None, None, None, None),
    (None, "no id at all", "en", "c", 1, "y"), (None, None, None, None, None, None),
    (7, "é漢字🙂 " * 400, "fr", "d", 2, "z"), (8, "word " * 60_000, "en", "e", 3, "w"),
    (9, "mail a.b@c.de, host 10.0.0.255, card 4111 1111 1111 1111, call +1 (964) 555-6360", "en", "f", 4, "v"),
]


def odd(spark):
    return spark.createDataFrame(ODD_ROWS, DOCUMENTS)


def empty(spark):
    return spark.createDataFrame([], DOCUMENTS)


def docs(spark, texts):
    return spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")


def by_id(df):
    return {r["doc_id"]: r for r in df.collect()}
