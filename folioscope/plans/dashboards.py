"""Dashboards: which answers each family of entities gets, for all its entities in one pass.

A dashboard is a row per chart, so a family of any size is one table; what
serves it can partition by entity.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from folioscope.corpus import Corpus
from folioscope.functions import columns as C
from folioscope.operators import dist, flows, geo, network, temporal

#: The charts that every family may have: name, builder(corpus, members, countries).
CHARTS: dict[str, Callable[[Corpus, DataFrame, DataFrame], DataFrame]] = {
    **{d: lambda c, m, _, d=d: dist.dimension(c, d, m) for d in dist.DIMENSIONS},
    "timeline": lambda c, m, _: dist.timeline(c, m),
    "heatmap": lambda c, m, _: dist.heatmap(c, m),
    "roles": lambda c, m, _: dist.roles(c, m),
    "stacked_timeline": lambda c, m, _: temporal.stacked_timeline(c, m),
    "subject_trends": lambda c, m, _: temporal.subject_trends(c, m),
    "language_timeline": lambda c, m, _: temporal.language_timeline(c, m),
    "sunburst": lambda c, m, _: flows.sunburst(c, m),
    "sankey": lambda c, m, _: flows.sankey(c, m),
    "geo_flows": lambda c, m, _: flows.geo_flows(c, m),
    "chord": lambda c, m, _: network.chord(c, C.SUBJECT, m),
    "contributor_network": lambda c, m, _: network.person_project(c, m, 30, 15),
    "choropleth": lambda c, m, countries: geo.choropleth(c, countries, m),
}


def register_chart(name: str, build: Callable[[Corpus, DataFrame, DataFrame], DataFrame], replace: bool = False) -> None:
    """Adds a chart of one's own to every family: f(corpus, members, countries) gives rows with ``entity``."""
    if not callable(build):
        raise TypeError(f"{name}: a builder takes (corpus, members, countries) and returns a DataFrame")
    if name in CHARTS and not replace:
        raise ValueError(f"there is a chart {name} already")
    CHARTS[name] = build


@dataclass(frozen=True)
class Family:
    """``members(corpus)`` gives (entity, item_id); ``without`` are charts that would only repeat the entity."""

    members: Callable[[Corpus], DataFrame]
    without: tuple[str, ...] = ()


def _linking(*terms: str, classes: tuple[str, ...] = ()) -> Callable[[Corpus], DataFrame]:
    def members(corpus: Corpus) -> DataFrame:
        rows = corpus.linking_to(*terms).join(corpus.records, "item_id", "left_semi")
        return rows.join(corpus.of_class(*classes).withColumnRenamed("item_id", "entity"), "entity", "left_semi") if classes else rows

    return members


def _credited(is_link: Callable, of: str) -> Callable[[Corpus], DataFrame]:
    def members(corpus: Corpus) -> DataFrame:
        links, _ = corpus.scoped()
        rows = network.of_class(corpus, links.where(is_link(F.col("term"))), of)
        return rows.select(F.col("dst").alias("entity"), F.col("src").alias("item_id")).distinct()

    return members


def _sections(corpus: Corpus) -> DataFrame:
    """Records of the projects of a section."""
    of = _linking(C.IS_PART_OF, classes=(C.PROJECT,))(corpus).withColumnRenamed("entity", "project")
    up = network.of_class(corpus, corpus.links.where(F.col("term") == C.IS_PART_OF), C.GROUP)
    return of.join(up.select(F.col("src").alias("project"), F.col("dst").alias("entity")), "project").select("entity", "item_id").distinct()


FAMILIES: dict[str, Family] = {
    "sections": Family(_sections),
    "projects": Family(_linking(C.IS_PART_OF, classes=(C.PROJECT,)), ("contributor_network",)),
    "people": Family(_credited(C.is_credit, C.PERSON), ("contributors",)),
    "organisations": Family(_credited(C.is_institution_credit, C.ORGANISATION)),
    "places": Family(_linking(C.SPATIAL, C.PROVENANCE, classes=(C.LOCATION,))),
    "subjects": Family(_linking(C.SUBJECT), ("subjects",)),
    "journals": Family(_linking(C.IS_PART_OF, classes=(C.JOURNAL,)), ("contributors",)),
    "types": Family(_linking(C.TYPE), ("types",)),
    "languages": Family(_linking(C.LANGUAGE), ("languages",)),
    "genres": Family(_linking(C.FORMAT), ("genres",)),
    "collections": Family(lambda c: c.memberships.select(F.col("set_id").alias("entity"), "item_id").join(c.records, "item_id", "left_semi")),
}


def charts(corpus: Corpus, family: str, countries: DataFrame, only: tuple[str, ...] | None = None) -> dict[str, DataFrame]:
    """Chart name -> rows with ``entity``, of all of a family's entities."""
    of = FAMILIES[family]
    members = of.members(corpus).select("entity", "item_id")
    return {n: f(corpus, members, countries) for n, f in CHARTS.items() if n not in of.without and (only is None or n in only)}


def bundled(frames: dict[str, DataFrame], largest: int = 5000) -> DataFrame:
    """(entity, chart, page, rows, body): a chart's rows in a stable order as JSON arrays of at most ``largest`` rows; nearly all charts are one page."""
    out = None
    for name, df in sorted(frames.items()):
        row = F.to_json(F.struct(*[c for c in df.columns if c != "entity"]))
        numbered = df.select("entity", row.alias("row")).withColumn("k", F.row_number().over(Window.partitionBy("entity").orderBy("row")))
        body = F.concat(F.lit("["), F.array_join(F.array_sort(F.collect_list("row")), ","), F.lit("]"))
        one = numbered.groupBy("entity", F.floor((F.col("k") - 1) / largest).alias("page")).agg(F.count(F.lit(1)).alias("rows"), body.alias("body"))
        one = one.select("entity", F.lit(name).alias("chart"), "page", "rows", "body")
        out = one if out is None else out.unionByName(one)
    return out


def write(corpus: Corpus, countries: DataFrame, path: str, families: tuple[str, ...] = tuple(FAMILIES), only: tuple[str, ...] | None = None) -> None:
    """<path>/<family>/chart=<name> as Parquet, sorted by entity so that readers skip to one.

    One job a chart: a single plan of all of them is slow even on small tables.
    """
    for family in families:
        for name, df in charts(corpus, family, countries, only).items():
            rows = bundled({name: df}).drop("chart")
            rows.repartition("entity").sortWithinPartitions("entity").write.mode("overwrite").parquet(f"{path}/{family}/chart={name}")
