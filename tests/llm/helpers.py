"""Small tables with the cases every operator must take: nulls, empty and long texts, ties, repeated rows, clashing columns."""

from pyspark.sql import types as T

DOCS = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()), T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType())])


def docs(spark, rows):
    """rows: (doc_id, text)."""
    return spark.createDataFrame([(i, t, None if t is None else "en", "src", None if t is None else len(t)) for i, t in rows], DOCS)


def clashing(df):
    """The same rows with extra columns named like the operators' own."""
    from pyspark.sql import functions as F

    names = ["ids", "decoded", "score", "spans", "leaks", "masked", "fp", "hit", "rank", "key", "uid", "shard", "size", "component_id", "found", "row"]
    return df.withColumns({c: F.lit(7) for c in names if c not in df.columns})


ODD = [(1, None), (2, ""), (3, " \n\t "), (4, "a"), (5, "Ünïcode – ‘quotes’ 漢字 🙂 x"), (6, "plain words in a row that say nothing much at all"), (6, "plain words in a row that say nothing much at all"), (None, "no key here but words enough to matter"), (7, "w" * 3000), (8, "it's we're  double  spaces   and\ttabs\n\nlines 12345 a@b.co")]
