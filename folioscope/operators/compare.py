"""Comparison of two answers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioscope.operators.ranking import ranked


def overlap(sets: DataFrame) -> DataFrame:
    """(a, b, both, either, percent): rows (entity, name) compared for every pair of entities that share a name; percent is rounded |A and B| / |A or B|."""
    one = sets.select("entity", "name").distinct()
    size = one.groupBy("entity").agg(F.count(F.lit(1)).alias("n"))
    both = one.select(F.col("entity").alias("a"), "name").join(one.select(F.col("entity").alias("b"), "name"), "name").where("a < b")
    both = both.groupBy("a", "b").agg(F.count(F.lit(1)).alias("both"))
    rows = both.join(size.select(F.col("entity").alias("a"), F.col("n").alias("na")), "a").join(size.select(F.col("entity").alias("b"), F.col("n").alias("nb")), "b")
    either = F.col("na") + F.col("nb") - F.col("both")
    return rows.select("a", "b", "both", either.alias("either"), F.round(100 * F.col("both") / either).cast("long").alias("percent"))


def shared_names(sets: DataFrame, a: int, b: int, top: int = 12) -> DataFrame:
    """(name): the first names that both have."""
    left = sets.where(F.col("entity") == a).select("name")
    right = sets.where(F.col("entity") == b).select("name")
    return left.intersect(right).orderBy("name").limit(top)


def unified(a: DataFrame, b: DataFrame) -> DataFrame:
    """(name, a, b, rank): two answers (name, n) on one axis by combined total; zeros drop out."""
    rows = a.select("name", F.col("n").alias("a")).join(b.select("name", F.col("n").alias("b")), "name", "full_outer").fillna({"a": 0, "b": 0})
    rows = rows.where(F.col("a") + F.col("b") > 0)
    return ranked(rows, [], [F.desc(F.col("a") + F.col("b")), F.col("name").asc()])


def search(rows: DataFrame, query: str, top: int = 8) -> DataFrame:
    """(item_id, title, rank): titles with a case-folded substring of two characters or more."""
    found = rows.where(F.lower("title").contains(query.lower())) if len(query) >= 2 else rows.where(F.lit(False))
    return ranked(found.select("item_id", "title"), [], [F.col("title").asc(), F.col("item_id").asc()], top)


def search_words(counts: DataFrame, prefix: str, top: int = 8) -> DataFrame:
    """(word, n, rank): words with a prefix, most frequent first."""
    return ranked(counts.where(F.col("word").startswith(prefix.lower())), [], [F.desc("n"), F.col("word").asc()], top)
