"""Order and top-k rules that all ranked answers share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folioscope.functions.columns import natural_key
from folioscope.operators.graphs import cut

#: Caps of ranked answers.
TOP_SUBJECTS, TOP_ROWS, TOP_PLACES, TOP_PHOTOS, TOP_PICKER = 200, 100, 200, 600, 400
KG_DIRECT, KG_REVERSE, KG_SHARED, KG_FALLBACK = 220, 40, 90, 60
#: Nodes whose statements are read for cross edges, and edges that they add.
KG_SCANNED, KG_CROSS = 250, 400


def by_value(value: str = "n", title: str = "title", item: str = "item_id") -> list[Column]:
    """Value descending, then title in natural order, then id: total, so that top-k is the same every time."""
    return [F.desc(value), natural_key(F.col(title)).asc(), F.col(item).asc()]


def window(keys: list[str], order: list[Column]):
    return Window.partitionBy(*keys).orderBy(*order)


def ranked(rows: DataFrame, keys: list[str], order: list[Column], top: int | None = None) -> DataFrame:
    """Adds ``rank`` from 1 within ``keys``; keeps the first ``top``."""
    out = rows.withColumn("rank", F.row_number().over(window(keys, order)).cast("long"))
    return out.where(F.col("rank") <= top) if top else out


def numbered(rows: DataFrame, keys: list[Column]) -> DataFrame:
    """Adds ``rank`` from 1 to all rows in ascending order of ``keys``, which tell all rows apart, range by range: no task holds them all."""
    names = [f"_key{i}" for i in range(len(keys))]
    dealt = rows.withColumns(dict(zip(names, keys))).repartitionByRange(*names)
    dealt = cut(dealt.withColumn("_part", F.spark_partition_id()))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # a row a range
    first = dealt.groupBy("_part").agg(F.count(F.lit(1)).alias("_n")).select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_ahead"))
    place = F.row_number().over(window(["_part"], [F.col(n) for n in names]))
    out = dealt.withColumn("_k", place).join(first, "_part")
    return out.withColumn("rank", (F.col("_k") + F.col("_ahead")).cast("long")).drop(*names, "_part", "_k", "_ahead")


def page(rank: Column, size: int = 20) -> Column:
    return (F.floor((rank - 1) / size) + 1).cast("long")


def first_link(links: DataFrame, keys: list[str], what: str = "dst") -> DataFrame:
    """The first statement in reading order per key."""
    return links.groupBy(*keys).agg(F.min_by(what, "ord").alias(what))


def last_link(links: DataFrame, keys: list[str], what: str = "dst") -> DataFrame:
    return links.groupBy(*keys).agg(F.max_by(what, "ord").alias(what))
