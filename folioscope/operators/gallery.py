"""Photo galleries and issue lists."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folioscope.operators.ranking import TOP_PHOTOS, ranked


def primary_media(items: DataFrame, media: DataFrame) -> DataFrame:
    """(item_id, media_id, storage, ext): of an item's public media the explicit primary, else the first by (position, id).

    ``items`` (item_id, primary_media_id), ``media`` (media_id, item_id,
    storage, ext, position, is_public, has_thumbnails, has_original). A
    private explicit primary gives none; only media with thumbnails are
    shown; the extension is blank without an original.
    """
    rows = media.where("is_public").join(items, "item_id").where(F.col("primary_media_id").isNull() | (F.col("primary_media_id") == F.col("media_id")))
    first = rows.groupBy("item_id").agg(F.min_by(F.struct("media_id", "storage", "ext", "has_thumbnails", "has_original"), F.struct("position", "media_id")).alias("m"))
    return first.where("m.has_thumbnails").select("item_id", "m.media_id", "m.storage", F.when(F.col("m.has_original"), F.col("m.ext")).otherwise("").alias("ext"))


def records(members: DataFrame, images: DataFrame, places: DataFrame, literals: DataFrame, cap: int | None = TOP_PHOTOS) -> DataFrame:
    """(entity, item_id, storage, place, lat, lon, total, rank): image-bearing items of each gallery; ``total`` counts those beyond the cap too.

    The place is the first linked one, with coordinates or not; a literal
    counts only without a link. ``places`` (item_id, place_title, lat, lon,
    ord), ``literals`` (item_id, value, ord).
    """
    linked = places.groupBy("item_id").agg(F.min_by(F.struct("place_title", "lat", "lon"), "ord").alias("p"))
    spelt = literals.groupBy("item_id").agg(F.min_by("value", "ord").alias("spelt"))
    rows = members.join(images, "item_id").join(linked, "item_id", "left").join(spelt, "item_id", "left")
    rows = rows.withColumn("total", F.count(F.lit(1)).over(Window.partitionBy("entity")))
    rows = rows.select("entity", "item_id", "storage", F.coalesce("p.place_title", "spelt").alias("place"), F.col("p.lat").alias("lat"), F.col("p.lon").alias("lon"), "total")
    return ranked(rows, ["entity"], [F.col("item_id").asc()], cap)


def issue_of(doi: Column) -> tuple[Column, Column]:
    """Volume and issue of v<number>i<number> in a DOI."""
    part = lambda k: F.nullif(F.regexp_extract(doi, r"v(\d+)i(\d+)", k), F.lit("")).cast("int")
    return part(1), part(2)


def first_page(pages: Column) -> Column:
    return F.nullif(F.regexp_extract(pages, r"(\d+)", 1), F.lit("")).cast("int")


def issue_contents(articles: DataFrame) -> DataFrame:
    """(volume, issue, issue_year, item_id, page, place): articles (item_id, title, doi, pages, year) by issue, in order of page, then title."""
    volume, issue = issue_of(F.col("doi"))
    rows = articles.select("item_id", "title", "year", volume.alias("volume"), issue.alias("issue"), first_page(F.col("pages")).alias("page")).where("volume is not null")
    year = rows.groupBy("volume", "issue").agg(F.min_by("year", F.when(F.col("year").isNotNull(), F.col("item_id"))).alias("issue_year"))
    order = Window.partitionBy("volume", "issue").orderBy(F.col("page").asc_nulls_last(), F.col("title"), F.col("item_id"))
    return rows.withColumn("place", F.row_number().over(order).cast("long")).join(year, ["volume", "issue"]).select("volume", "issue", "issue_year", "item_id", "page", "place")


def collection_index(members: DataFrame, images: DataFrame, issues: DataFrame | None = None, covers: int = 4) -> DataFrame:
    """(entity, items, photos, covers): how many items, how many with an image (issues, for an issue collection), the first covers' storage names."""
    rows = members.join(images.select("item_id", "storage"), "item_id", "left")
    first = ranked(rows.where("storage is not null"), ["entity"], [F.col("item_id").asc()], covers)
    shown = first.groupBy("entity").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "storage"))), lambda x: x["storage"]), ",").alias("covers"))
    counts = rows.groupBy("entity").agg(F.countDistinct("item_id").alias("items"), F.count("storage").alias("photos"))
    if issues is not None:
        per = members.join(issues, "item_id").groupBy("entity").agg(F.countDistinct("volume", "issue").alias("_issues"))
        counts = counts.join(per, "entity", "left").withColumn("photos", F.coalesce("_issues", "photos")).drop("_issues")
    return counts.join(shown, "entity", "left")


def views(rows: DataFrame) -> DataFrame:
    """(entity, has_map, has_timeline) from rows (entity, lat, year)."""
    return rows.groupBy("entity").agg((F.count("lat") > 0).alias("has_map"), (F.count("year") > 0).alias("has_timeline"))
