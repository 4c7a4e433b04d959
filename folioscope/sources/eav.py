"""Relational EAV tables as a corpus: public, site-scoped, each rule of selection one DataFrame."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioscope.corpus import Corpus
from folioscope.functions import columns as C

TABLES = ("resource", "item", "site", "item_site", "value", "property", "vocabulary", "resource_class", "resource_template", "item_item_set", "media")


def read_tables(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    return {t: spark.read.parquet(f"{path}/{t}.parquet") for t in TABLES}


#: Numeric columns that split a table where ``id`` isn't one of it.
SPLIT_BY = {"item_site": "item_id", "item_item_set": "item_id"}


def read_jdbc(spark: SparkSession, url: str, fetch_size: int = 10_000, parts: int = 16, ids_per_part: int = 50_000, tables: tuple[str, ...] = TABLES, **options: str) -> dict[str, DataFrame]:
    """The same tables from a database, by cursor, each by ranges of its ids: as many connections as it has ranges, ``parts`` at most.

    The bounds are the ids that there are; ids without an owner make a range
    smaller, not wrong. Jobs end with the tag they run under (see under_tag).
    """
    reader = lambda: spark.read.format("jdbc").option("url", url).option("fetchsize", fetch_size).options(**options)
    found = {}
    for t in tables:
        key = SPLIT_BY.get(t, "id")
        low, high = reader().option("query", f"SELECT MIN({key}) AS low, MAX({key}) AS high FROM {t}").load().first()
        n = 1 if low is None else max(1, min(parts, -(-int(high - low + 1) // ids_per_part)))
        by = {"partitionColumn": key, "lowerBound": str(low), "upperBound": str(high + 1), "numPartitions": str(n)} if n > 1 else {}
        df = reader().option("dbtable", t).options(**by).load()
        found[t] = df.toDF(*[c.lower() for c in df.columns])
    return found


@contextmanager
def under_tag(spark: SparkSession, tag: str) -> Iterator[None]:
    """Jobs that this thread starts meanwhile can be ended from another one by cancel(spark, tag)."""
    spark.sparkContext.addJobTag(tag)
    try:
        yield
    finally:
        spark.sparkContext.removeJobTag(tag)


def cancel(spark: SparkSession, tag: str) -> None:
    spark.sparkContext.cancelJobsWithTag(tag)


def in_scope(t: dict[str, DataFrame], site_id: int) -> DataFrame:
    """(item_id) of public items of a public site."""
    site = t["site"].where((F.col("id") == site_id) & (F.col("is_public") == 1)).select(F.col("id").alias("site_id"))
    inside = t["item_site"].join(F.broadcast(site), "site_id").select("item_id").distinct()  # one site
    public = t["resource"].where((F.col("is_public") == 1) & (F.col("resource_type") == "item")).select(F.col("id").alias("item_id"))
    return public.join(inside, "item_id", "left_semi")


def terms(t: dict[str, DataFrame], table: str = "property") -> DataFrame:
    """(id, term) as prefix:localName."""
    vocabulary = t["vocabulary"].select(F.col("id").alias("vocabulary_id"), "prefix")
    return t[table].join(vocabulary, "vocabulary_id").select("id", F.concat_ws(":", "prefix", "local_name").alias("term"))


def statements(t: dict[str, DataFrame], scope: DataFrame) -> DataFrame:
    """Public values of items in scope: (item_id, term, label, target, value, ord)."""
    names = terms(t).join(t["property"].select("id", "label"), "id")
    values = t["value"].where(F.col("is_public") == 1).join(scope, F.col("resource_id") == F.col("item_id"), "left_semi")
    return values.join(names.withColumnRenamed("id", "property_id"), "property_id").select(
        F.col("resource_id").alias("item_id"), "term", "label", F.col("value_resource_id").cast("long").alias("target"),
        F.coalesce("value", "uri").alias("value"), F.col("id").cast("long").alias("ord"),
    )


def titles(t: dict[str, DataFrame], stated: DataFrame, scope: DataFrame) -> DataFrame:
    """(item_id, title): the first visible value of the template's title property, else of dcterms:title, else "Item <id>"; a stored title may be private and is never used."""
    chosen = t["resource_template"].join(terms(t).select(F.col("id").alias("title_property_id"), "term"), "title_property_id", "left")
    chosen = chosen.select(F.col("id").alias("resource_template_id"), F.col("term").alias("title_term"))
    items = t["resource"].select(F.col("id").alias("item_id"), "resource_template_id").join(scope, "item_id", "left_semi")
    items = items.join(chosen, "resource_template_id", "left").select("item_id", F.coalesce("title_term", F.lit(C.TITLE)).alias("title_term"))
    literal = stated.where(F.col("value").isNotNull() & (F.trim("value") != ""))
    rows = items.join(literal, "item_id", "left")
    own = F.min_by(F.when(F.col("term") == F.col("title_term"), F.col("value")), F.when(F.col("term") == F.col("title_term"), F.col("ord")))
    plain = F.min_by(F.when(F.col("term") == C.TITLE, F.col("value")), F.when(F.col("term") == C.TITLE, F.col("ord")))
    named = rows.groupBy("item_id").agg(own.alias("own"), plain.alias("plain"))
    return named.select("item_id", F.coalesce("own", "plain", F.concat(F.lit("Item "), F.col("item_id").cast("string"))).alias("title"))


def preferred_dates(rows: DataFrame) -> DataFrame:
    """(item_id, year, date_raw) of rows (item_id, term, value, ord): by kind of date, then order of reading; without four digits in a row a value doesn't count."""
    kind = reduce(lambda w, kv: w.when(F.col("term") == kv[0], kv[1]), C.DATE_RANKS.items(), F)
    dated = rows.withColumns({"kind": kind, "y": C.first_year(F.col("value"))}).where("kind is not null and y is not null")
    best = dated.groupBy("item_id").agg(F.min_by(F.struct("y", "value"), F.struct("kind", "ord")).alias("d"))
    return best.select("item_id", F.col("d.y").cast("int").alias("year"), F.col("d.value").alias("date_raw"))


def coherent_coordinates(rows: DataFrame) -> DataFrame:
    """(item_id, lat, lon) of rows (item_id, term, value, ord): the n-th latitude goes with the n-th longitude; the first numeric pair inside the globe."""
    from pyspark.sql import Window

    nth = Window.partitionBy("item_id", "term").orderBy("ord")
    axis = rows.where(F.col("term").isin(C.LATITUDE, C.LONGITUDE)).withColumn("n", F.row_number().over(nth))
    axis = axis.select("item_id", "term", "n", F.expr("try_cast(trim(value) as double)").alias("x"))
    lat = axis.where(F.col("term") == C.LATITUDE).select("item_id", "n", F.col("x").alias("lat"))
    lon = axis.where(F.col("term") == C.LONGITUDE).select("item_id", "n", F.col("x").alias("lon"))
    pairs = lat.join(lon, ["item_id", "n"]).where("lat between -90 and 90 and lon between -180 and 180")
    best = pairs.groupBy("item_id").agg(F.min_by(F.struct("lat", "lon"), "n").alias("p"))
    return best.select("item_id", "p.lat", "p.lon")


def temporal_intervals(rows: DataFrame) -> DataFrame:
    """(item_id, start, end): the first dcterms:temporal value with exactly one slash."""
    one = rows.where((F.col("term") == C.TEMPORAL) & (F.size(F.split("value", "/")) == 2))
    first = one.groupBy("item_id").agg(F.min_by("value", "ord").alias("value"))
    parts = F.split("value", "/")
    return first.select("item_id", F.trim(parts[0]).alias("start"), F.trim(parts[1]).alias("end"))


def projected(links: DataFrame, allowed: DataFrame) -> DataFrame:
    """Links between allowed items; of equal statements the first."""
    rows = links.join(allowed.select(F.col("item_id").alias("src")), "src", "left_semi").join(allowed.select(F.col("item_id").alias("dst")), "dst", "left_semi")
    return rows.groupBy("src", "term", "dst").agg(F.min("ord").alias("ord"))


def item_sets(t: dict[str, DataFrame]) -> DataFrame:
    """(set_id, title, code, part_of): public item sets."""
    sets = t["resource"].where((F.col("is_public") == 1) & (F.col("resource_type") == "item_set")).select(F.col("id").alias("item_id"))
    stated = statements(t, sets)
    first = lambda term: F.min_by(F.when(F.col("term") == term, F.col("value")), F.when((F.col("term") == term) & F.col("value").isNotNull(), F.col("ord")))
    part = F.array_sort(F.collect_set(F.when(F.col("term") == C.IS_PART_OF, F.col("target"))))
    rows = stated.groupBy("item_id").agg(first(C.TITLE).alias("title"), F.trim(first("local:id")).alias("code"), part.alias("part_of"))
    return sets.join(rows, "item_id", "left").withColumnRenamed("item_id", "set_id")


def project_collections(sets: DataFrame, projects: DataFrame) -> DataFrame:
    """(project, set_id): sets (set_id, code, part_of) by their isPartOf link to a project (item_id, code); a project without one by equal code, among sets not linked to any."""
    linked = sets.select("set_id", F.explode("part_of").alias("project")).join(projects.select(F.col("item_id").alias("project")), "project", "left_semi")
    free_sets = sets.where("code is not null and code != ''").join(linked.select("set_id"), "set_id", "left_anti")
    free_projects = projects.where("code is not null and code != ''").join(linked.select(F.col("project").alias("item_id")), "item_id", "left_anti")
    by_code = free_projects.groupBy(F.trim("code").alias("trimmed")).agg(F.min("item_id").alias("project"))
    coded = free_sets.select("set_id", F.trim("code").alias("trimmed")).join(by_code, "trimmed").select("project", "set_id")
    return linked.select("project", "set_id").unionByName(coded).distinct()


def project_members(corpus: Corpus, collections: DataFrame) -> DataFrame:
    """(entity, item_id): children of each project and items of its collections, itself aside."""
    kids = corpus.links.where(F.col("term") == C.IS_PART_OF).join(corpus.of_class(C.PROJECT), F.col("dst") == F.col("item_id"), "left_semi")
    kids = kids.select(F.col("dst").alias("entity"), F.col("src").alias("item_id"))
    held = collections.join(corpus.memberships, "set_id").select(F.col("project").alias("entity"), "item_id")
    return kids.unionByName(held).where("entity != item_id").distinct()


def load(t: dict[str, DataFrame], site_id: int, record_template: int | None = None, local_prefix: str = "local") -> Corpus:
    """The public corpus of a site; a site without public items is an error.

    ``local_prefix`` is the prefix of the installation's own vocabulary, whose terms are called local: here.
    """
    own = F.when(F.col("prefix") == local_prefix, "local").otherwise(F.col("prefix"))
    t = t | {"vocabulary": t["vocabulary"].withColumn("prefix", own)}
    scope = in_scope(t, site_id)
    if scope.isEmpty():
        raise ValueError(f"site {site_id} has no public items")
    stated = statements(t, scope)
    links = stated.where("target is not null").select(F.col("item_id").alias("src"), "term", F.col("target").alias("dst"), "ord")
    dates = preferred_dates(stated.where("target is null"))
    classes = terms(t, "resource_class").select(F.col("id").alias("resource_class_id"), F.col("term").alias("class_term"))
    items = (
        t["resource"]
        .select(F.col("id").alias("item_id"), "resource_class_id", F.col("resource_template_id").alias("template_id"), F.to_date(F.substring("created", 1, 10)).alias("created"))
        .join(scope, "item_id", "left_semi")
        .join(classes, "resource_class_id", "left")
        .join(titles(t, stated, scope), "item_id")
        .join(dates.select("item_id", "year"), "item_id", "left")
        .select("item_id", "title", "template_id", "class_term", "created", "year")
    )
    literals = stated.where(F.col("target").isNull() & F.col("term").isin(*C.LITERAL_TERMS) & F.col("value").isNotNull()).select("item_id", "term", "value", "ord")
    public_sets = item_sets(t).select("set_id")
    memberships = (
        t["item_item_set"].select(F.col("item_set_id").alias("set_id"), "item_id").distinct().join(scope, "item_id", "left_semi").join(public_sets, "set_id", "left_semi")
    )
    records = items.where(F.col("template_id") == record_template).select("item_id") if record_template is not None else scope
    return Corpus(items, projected(links, scope), literals, memberships, coherent_coordinates(stated), temporal_intervals(stated), records)
