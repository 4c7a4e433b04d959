"""Hierarchies and flows between dimensions."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from folioscope.corpus import Corpus
from folioscope.functions import columns as C
from folioscope.operators.dist import first_per
from folioscope.operators.ranking import by_value, ranked


def _kind(corpus: Corpus, term: str, name: str, members: DataFrame | None) -> tuple[DataFrame, list[str]]:
    links, keys = corpus.scoped(members)
    titles = corpus.titles().select("dst", F.col("title").alias(name))
    return links.where(F.col("term") == term).join(titles, "dst").select(*keys, "src", name, F.col("dst").alias(f"{name}_id"), "ord"), keys


def sunburst(corpus: Corpus, members: DataFrame | None = None, per_item: int = 5, top: int = 8) -> DataFrame:
    """(type, language, subject, n): a record's first subjects under its types and languages; the top subjects of each pair."""
    types, keys = _kind(corpus, C.TYPE, "type", members)
    languages, _ = _kind(corpus, C.LANGUAGE, "language", members)
    subjects, _ = _kind(corpus, C.SUBJECT, "subject", members)
    order = Window.partitionBy(*keys, "src").orderBy("ord")
    subjects = subjects.withColumn("k", F.row_number().over(order)).where(F.col("k") <= per_item)
    on = [*keys, "src"]
    rows = types.select(*on, "type").join(languages.select(*on, "language"), on).join(subjects.select(*on, "subject"), on, "left")
    rows = rows.fillna({"subject": "(no subject)"})
    counts = rows.groupBy(*keys, "type", "language", "subject").agg(F.count(F.lit(1)).alias("n"))
    group = [*keys, "type", "language"]
    return ranked(counts, group, [F.desc("n"), C.natural_key(F.col("subject")).asc(), F.col("subject").asc()], top).drop("rank")


def treemap(corpus: Corpus) -> DataFrame:
    """(project, type, n, items): records under their first project, statements of type below; projects without a type drop out."""
    first = first_per(corpus, C.IS_PART_OF, [C.PROJECT])
    titles = corpus.titles().select(F.col("dst").alias("target"), F.col("title").alias("project"))
    home = corpus.records.join(first, "item_id", "left").join(titles, "target", "left")
    home = home.select(F.col("item_id").alias("src"), F.coalesce("project", F.lit("(unassigned)")).alias("project"))
    types, _ = _kind(corpus, C.TYPE, "type", None)
    size = home.groupBy("project").agg(F.count(F.lit(1)).alias("items"))
    counts = home.join(types, "src").groupBy("project", "type").agg(F.count(F.lit(1)).alias("n"))
    return counts.join(size, "project")


def content_sources(groups: DataFrame, most: int = 12, other: str = "Other") -> DataFrame:
    """(label, n) of rows (item_id, label): more than ``most`` labels keep the first most - 1 and fold the tail into ``other``."""
    counts = groups.groupBy("label").agg(F.countDistinct("item_id").alias("n"))
    order = [F.desc("n"), C.natural_key(F.col("label")).asc(), F.col("label").asc()]
    rows = ranked(counts, [], order).withColumn("groups", F.count(F.lit(1)).over(Window.partitionBy(F.lit(1))))
    label = F.when((F.col("rank") > most - 1) & (F.col("groups") > most), other).otherwise(F.col("label"))
    return rows.groupBy(label.alias("label")).agg(F.sum("n").alias("n"))


def sankey(corpus: Corpus, members: DataFrame | None = None, per_item: int = 3, top: int = 10) -> DataFrame:
    """(source, target, n): contributor -> project -> type over records that have all three."""
    links, keys = corpus.scoped(members)
    on = [*keys, "src"]
    titles = corpus.titles()
    people = links.where(C.is_credit(F.col("term"))).join(titles, "dst")
    order = Window.partitionBy(*on).orderBy("ord", "term")
    people = people.withColumn("k", F.row_number().over(order)).where(F.col("k") <= per_item).select(*on, F.col("title").alias("person"))
    projects = links.where(F.col("term") == C.IS_PART_OF).join(corpus.of_class(C.PROJECT), F.col("dst") == F.col("item_id"), "left_semi").join(titles, "dst")
    project = projects.groupBy(*on).agg(F.max_by("title", "ord").alias("project"))
    types = links.where(F.col("term") == C.TYPE).join(titles, "dst").select(*on, F.col("title").alias("type"))
    flows = people.join(project, on).join(types, on).groupBy(*keys, "person", "project", "type").agg(F.count(F.lit(1)).alias("n"))
    total = flows.groupBy(*keys, "person").agg(F.sum("n").alias("n"))
    best = ranked(total, keys, [F.desc("n"), C.natural_key(F.col("person")).asc(), F.col("person").asc()], top).select(*keys, "person")
    flows = flows.join(best, [*keys, "person"], "left_semi")
    first = flows.groupBy(*keys, F.col("person").alias("source"), F.col("project").alias("target")).agg(F.sum("n").alias("n"))
    second = flows.groupBy(*keys, F.col("project").alias("source"), F.col("type").alias("target")).agg(F.sum("n").alias("n"))
    return first.unionByName(second)


def geo_flows(corpus: Corpus, members: DataFrame | None = None) -> DataFrame:
    """(origin, current, n): records by geocoded origin and different geocoded current place."""
    links, keys = corpus.scoped(members)
    placed = links.join(corpus.geo.select(F.col("item_id").alias("dst")), "dst", "left_semi")
    origin = placed.where(F.col("term") == C.SPATIAL).select(*keys, "src", F.col("dst").alias("origin"))
    current = placed.where(F.col("term") == C.PROVENANCE).select(*keys, "src", F.col("dst").alias("current"))
    rows = origin.join(current, [*keys, "src"]).where("origin != current")
    return rows.groupBy(*keys, "origin", "current").agg(F.count(F.lit(1)).alias("n"))
