"""Rows that every operator has to take: nulls, empty and long texts, ties, repeats, clashing columns."""

from pyspark.sql import functions as F

TEXTS = [
    (1, "the quick brown fox jumps over the lazy dog near the old river bank today", "b"),
    (2, "the quick brown fox jumps over the lazy dog near the old river bank today", "a"),
    (3, "The Quick  brown fox\tjumps over the lazy dog near the old river bank today", None),
    (4, "", "a"),
    (5, None, "a"),
    (6, " \n\t\r\n ", "é"),
    (7, "word " * 30_000, "b"),
    (8, "Füße café — naïve ÀÉ日本語 ’quoted’ <|endoftext|> it's x...y. ., done.\x1c\x85\xa0end", "é"),
    (8, "Füße café — naïve ÀÉ日本語 ’quoted’ <|endoftext|> it's x...y. ., done.\x1c\x85\xa0end", "é"),
    (9, "a", None),
    (None, "no id here", "a"),
    (None, None, None),
    (10, "one\ntwo\n\n Three \nTWO\n", "b"),
]

DOCS = "doc_id long, text string, source string"


def docs(spark, rows=TEXTS):
    """With extra columns whose names operators use inside."""
    df = spark.createDataFrame(rows, DOCS).repartition(3)
    extra = {c: F.lit("x") for c in ("id", "t", "norm", "n", "row", "key", "fp", "size", "skey", "lines", "pos", "at", "prefix")}
    return df.withColumns(extra).withColumns({"lang": F.lit("en"), "n_chars": F.lit(1).cast("long")})


def empty(spark):
    return spark.createDataFrame([], DOCS)


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)
