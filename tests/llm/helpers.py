"""Small frames for the llm tests."""

from pyspark.sql import types as T

DOC = T.StructType(
    [T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("source", T.StringType())]
)
#: Input columns that clash with what operators add or use inside.
CLASHING = ("row", "id", "text_", "score", "n_lines", "spans", "component_id", "n", "size", "label_", "start")


def docs(spark, rows):
    """(doc_id, text[, source]) rows."""
    return spark.createDataFrame([(*r, None)[:3] for r in rows], DOC)


def clashing(df):
    """The frame with extra columns of awkward names."""
    from pyspark.sql import functions as F

    for c in CLASHING:
        if c not in df.columns:
            df = df.withColumn(c, F.lit("x"))
    return df.withColumn("a.b `c`", F.lit(1))


def plain(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)
