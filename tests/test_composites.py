"""Dashboards from one count of cells: against the single charts, and by what they read."""

import dataclasses

import pytest
from pyspark.sql import functions as F

from folioscope.functions import columns as C
from folioscope.operators import composites, dist, flows, geo, network, temporal
from folioscope.sources import bridge


@pytest.fixture(scope="module")
def kept(spark, sf, tmp_path_factory):
    """The corpus as tables, so that plans tell what they read."""
    at = tmp_path_factory.mktemp("corpus")
    made, frames = bridge.load(spark, sf), {}
    for f in dataclasses.fields(made):
        getattr(made, f.name).write.parquet(f"{at}/{f.name}")
        frames[f.name] = spark.read.parquet(f"{at}/{f.name}")
    return dataclasses.replace(made, **frames)


def files_read(df):
    """The tables that the leaves of the plan read; kept rows aren't among them."""
    found = df._jdf.queryExecution().optimizedPlan().collectLeaves()
    leaves = [found.apply(i) for i in range(found.size())]
    return [leaf.relation().location().rootPaths().mkString(",").rsplit("/", 1)[-1] for leaf in leaves if leaf.getClass().getSimpleName() == "LogicalRelation"]


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def test_statements_are_read_once(spark, kept):
    countries = geo.country_index(kept.geo, geo.square_outlines(spark)).persist()
    cells = composites.cells(composites.statements(kept, countries))
    assert files_read(cells).count("links") == 1
    charts = composites.dashboard(kept, countries)
    assert len(charts) == 23
    for df in charts.values():  # nothing but the counted cells and their titles
        assert files_read(df) == []


def test_dashboards_of_all_projects_are_the_single_charts(spark, kept):
    countries = geo.country_index(kept.geo, geo.square_outlines(spark)).persist()
    members = kept.linking_to(C.IS_PART_OF).join(kept.of_class(C.PROJECT).withColumnRenamed("item_id", "entity"), "entity", "left_semi")
    members = members.join(kept.records, "item_id", "left_semi").select("entity", "item_id").persist()
    got = composites.dashboard(kept, countries, members)
    single = {
        **{d: dist.dimension(kept, d, members).select("entity", "title", F.col("item_id").cast("string"), "n", "rank") for d in ("types", "subjects", "contributors")},
        "timeline": dist.timeline(kept, members), "heatmap": dist.heatmap(kept, members), "roles": dist.roles(kept, members),
        "stacked_timeline": temporal.stacked_timeline(kept, members), "subject_trends": temporal.subject_trends(kept, members),
        "language_timeline": temporal.language_timeline(kept, members), "chord": network.chord(kept, C.SUBJECT, members), "sankey": flows.sankey(kept, members),
        "sunburst": flows.sunburst(kept, members), "geo_flows": flows.geo_flows(kept, members), "choropleth": geo.choropleth(kept, countries, members),
    }
    shape = [c for c in ("entity", "a", "b", "c", "n", "rank")]
    for name, want in single.items():
        df = got[name]
        assert rows(df.select(*[c for c in shape if c in df.columns])) == rows(want.select("entity", *[c for c in want.columns if c != "entity"])), name
    assert "boxplot" not in got


def test_an_empty_corpus_has_empty_charts(spark, kept):
    none = dataclasses.replace(kept, **{f.name: getattr(kept, f.name).where("false") for f in dataclasses.fields(kept)})
    countries = spark.createDataFrame([], "item_id long, country string")
    assert composites.artifact("x", composites.dashboard(none, countries)).count() == 0
