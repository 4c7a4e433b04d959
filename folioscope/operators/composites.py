"""Whole dashboards from one reading of the statements.

A record's statements are gathered into one row; the row lists the cells that
it counts in, of every chart at once, and one map-side combined count of all
cells is all that is shuffled after that. Charts that share keys share cells:
what is asked by year and in all is counted by year and summed, pairs of
subjects serve the chord and its years, projects' sizes the sections. Titles are
joined to counted cells, and caps and orders are those of the single charts.

``members`` (entity, item_id) asks for every entity's dashboard: cells are
listed once a record and counted for each entity that has it.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, replace
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioscope.corpus import Corpus
from folioscope.functions import columns as C
from folioscope.operators import dist, geo
from folioscope.operators.graphs import cut
from folioscope.operators.ranking import TOP_PICKER, TOP_ROWS, by_value, ranked

#: A cell is a chart's name, up to three keys and the record's year; what a chart doesn't need is null.
CELL = "struct<chart: string, a: bigint, b: bigint, c: bigint, label: string, by_year: boolean>"


PUBLISHED_AT = "marcrel:pup"
#: Charts of linked records of a class: terms and classes, any class where none is named.
LINKED = {
    "top_journals": ((C.IS_PART_OF,), (C.JOURNAL,)), "top_series": ((C.IS_PART_OF, C.SERIES), (C.BOOK_SERIES,)), "funders": ((C.FUNDER,), ()), "publishers": ((C.PUBLISHER,), ()),
}


def _terms(x: Column) -> Column:
    return x.isin(C.IS_PART_OF, C.SERIES, C.TYPE, C.LANGUAGE, C.SUBJECT, C.FORMAT, C.SPATIAL, C.PROVENANCE, C.FUNDER, C.PUBLISHER, PUBLISHED_AT) | C.is_credit(x)


def statements(corpus: Corpus, countries: DataFrame) -> DataFrame:
    """(item_id, class_term, is_record, year, s): every record's and project's statements in reading order, each with what is to know of its target."""
    records = corpus.records.select("item_id", F.lit(True).alias("is_record"))
    items = corpus.items.select("item_id", "class_term", "year").join(records, "item_id", "left")
    items = items.where("is_record").unionByName(items.where((F.col("is_record").isNull()) & (F.col("class_term") == C.PROJECT)))
    about = corpus.items.select(F.col("item_id").alias("dst"), F.nullif("title", F.lit("")).alias("title"), F.col("class_term").alias("kind"))
    about = about.join(corpus.geo.select(F.col("item_id").alias("dst"), F.lit(True).alias("placed")), "dst", "left")
    about = about.join(countries.select(F.col("item_id").alias("dst"), "country"), "dst", "left")
    links = corpus.links.where(_terms(F.col("term"))).join(about, "dst", "left")
    one = F.struct("ord", "term", "dst", F.col("title").isNotNull().alias("titled"), "kind", F.coalesce("placed", F.lit(False)).alias("placed"), "country")
    rows = links.groupBy(F.col("src").alias("item_id")).agg(F.array_sort(F.collect_list(one)).alias("s"))
    return items.join(rows, "item_id", "left").select("item_id", "class_term", F.coalesce("is_record", F.lit(False)).alias("is_record"), "year", F.coalesce("s", F.array()).alias("s"))


def _of(test: Callable[[Column], Column], titled: bool = True) -> Column:
    return F.filter("s", lambda x: (test(x) & x["titled"]) if titled else test(x))


def _cell(chart: str, a=None, b=None, c=None, label=None, by_year: bool = False) -> Column:
    long = lambda x: F.lit(None).cast("long") if x is None else x.cast("long")
    return F.struct(F.lit(chart).alias("chart"), long(a).alias("a"), long(b).alias("b"), long(c).alias("c"), (F.lit(None).cast("string") if label is None else label).alias("label"), F.lit(by_year).alias("by_year"))


def _dimension_cells(name: str, ids: Callable[[Column], Column]) -> Column:
    """Each different titled target of a dimension once."""
    return F.transform(F.array_distinct(ids(_of(lambda x: dist.DIMENSIONS[name](x["term"])))), lambda a: _cell(name, a))


def _linked_cells(name: str, ids: Callable[[Column], Column]) -> Column:
    terms, classes = LINKED[name]
    return F.transform(F.array_distinct(ids(_of(lambda x: x["term"].isin(*terms) & (x["kind"].isin(*classes) if classes else F.lit(True))))), lambda a: _cell(name, a))


def cells(rows: DataFrame) -> DataFrame:
    """(item_id, chart, a, b, c, label, year) of rows of statements()."""
    term = lambda t: lambda x: x["term"] == t
    ids = lambda xs: F.transform(xs, lambda x: x["dst"])
    types, languages, subjects = (ids(_of(term(t))) for t in (C.TYPE, C.LANGUAGE, C.SUBJECT))
    credits = _of(lambda x: C.is_credit(x["term"]))
    projects = _of(lambda x: (x["term"] == C.IS_PART_OF) & (x["kind"] == C.PROJECT))
    projects_any = _of(lambda x: (x["term"] == C.IS_PART_OF) & (x["kind"] == C.PROJECT), titled=False)
    origins = F.filter("s", lambda x: (x["term"] == C.SPATIAL) & x["placed"])
    currents = F.filter("s", lambda x: (x["term"] == C.PROVENANCE) & x["placed"])
    two = lambda xs, ys, f: F.flatten(F.transform(xs, lambda x: F.transform(ys, lambda y: f(x, y))))
    none = F.array(F.lit(None).cast("long"))
    or_none = lambda xs: F.when(F.size(xs) > 0, xs).otherwise(none)

    several = F.when(F.size(F.array_distinct(subjects)) >= 2, F.array_sort(F.array_distinct(subjects))).otherwise(F.array().cast("array<bigint>"))
    pairs = F.filter(two(several, several, lambda x, y: F.struct(x.alias("x"), y.alias("y"))), lambda p: p["x"] < p["y"])
    last = F.slice(ids(projects), -1, 1)
    triples = F.flatten(F.transform(F.slice(ids(credits), 1, 3), lambda p: two(last, types, lambda j, t: _cell("sankey", p, j, t))))
    suns = F.flatten(F.transform(types, lambda t: two(languages, or_none(F.slice(subjects, 1, 5)), lambda g, s: _cell("sunburst", t, g, s))))
    record = [
        F.array(_cell("record", by_year=True)),
        *(_dimension_cells(d, ids) for d in dist.DIMENSIONS),
        F.transform(or_none(types), lambda t: _cell("type", t, by_year=True)),
        F.transform(subjects, lambda a: _cell("subject", a, by_year=True)),
        F.transform(languages, lambda a: _cell("language", a, by_year=True)),
        two(types, languages, lambda t, g: _cell("heatmap", t, g)),
        F.transform(F.filter("s", lambda x: C.is_credit(x["term"])), lambda x: _cell("roles", label=C.role_label(x["term"]))),
        F.transform(several, lambda a: _cell("pair_node", a, by_year=True)),
        F.transform(pairs, lambda p: _cell("pair", p["x"], p["y"], by_year=True)),
        triples, suns,
        F.filter(two(origins, currents, lambda x, y: _cell("geo_flows", x["dst"], y["dst"])), lambda x: x["a"] != x["b"]),
        F.transform(F.array_distinct(F.array_compact(F.transform(_of(term(C.SPATIAL), titled=False), lambda x: x["country"]))), lambda x: _cell("choropleth", label=x)),
        F.transform(F.slice(ids(projects_any), 1, 1), lambda a: _cell("home", a)),
        F.transform(F.array_distinct(ids(projects_any)), lambda a: _cell("project_size", a)),
        *(_linked_cells(name, ids) for name in LINKED),
        F.transform(F.array_distinct(ids(F.filter("s", lambda x: (x["term"] == PUBLISHED_AT) & x["placed"] & x["titled"]))), lambda a: _cell("published_at", a)),
        F.transform(F.array_distinct(ids(_of(lambda x: x["term"].isin(C.AUTHORS, C.EDITORS), titled=False))), lambda a: _cell("people", a)),
    ]
    up = _of(lambda x: (x["term"] == C.IS_PART_OF) & (x["kind"] == C.GROUP), titled=False)
    funder = F.slice(ids(_of(term(C.FUNDER))), 1, 1)
    me = F.col("item_id")
    project = [
        F.transform(ids(up), lambda a: _cell("section_of", me, a)),
        F.transform(F.slice(ids(up), 1, 1), lambda a: _cell("first_section", me, a)),
        F.transform(funder, lambda a: _cell("first_funder", me, a)),
    ]
    # A project's own cells count once for the corpus; a record that is itself a project has both.
    nothing = F.array().cast(f"array<{CELL}>")
    of = lambda parts, when: F.when(when, reduce(lambda x, y: F.concat(x, y), [p.cast(f"array<{CELL}>") for p in parts])).otherwise(nothing)
    listed = F.concat(of(record, F.col("is_record")), of(project, F.coalesce(F.col("class_term") == C.PROJECT, F.lit(False))))
    out = rows.select("item_id", "year", F.explode(listed).alias("cell")).select("item_id", "year", "cell.*")
    return out.withColumn("year", F.when(F.col("by_year"), F.col("year"))).drop("by_year")


#: Cells of projects, which are no record's.
_OF_PROJECTS = ("section_of", "first_section", "first_funder")


@dataclass(frozen=True)
class Counted:
    """Counted cells ([entity,] chart, a, b, c, label, year, n), kept: every chart reads these few rows."""

    rows: DataFrame
    names: DataFrame
    keys: list[str]

    def of(self, chart: str, *keys: str) -> DataFrame:
        """(keys, n) of one chart, summed over the others."""
        return self.rows.where(F.col("chart") == chart).groupBy(*self.keys, *keys).agg(F.sum("n").alias("n"))

    def titled(self, rows: DataFrame, *names: str, left: tuple[str, ...] = ()) -> DataFrame:
        for name in names:
            titles = self.names.select(F.col("dst").alias(name), F.col("title").alias(f"{name}_title"))
            rows = rows.join(titles, name, "left" if name in left else "inner").drop(name).withColumnRenamed(f"{name}_title", name)
        return rows

    def summed(self, rows: DataFrame) -> DataFrame:
        return rows.groupBy(*[c for c in rows.columns if c != "n"]).agg(F.sum("n").alias("n"))


def counted(corpus: Corpus, countries: DataFrame, members: DataFrame | None = None) -> Counted:
    found = cells(statements(corpus, countries))
    keys = [] if members is None else ["entity"]
    if members is not None:
        own = found.where(~F.col("chart").isin(*_OF_PROJECTS))
        found = own.join(members.select("entity", "item_id").distinct(), "item_id")
    rows = cut(found.groupBy(*keys, "chart", "a", "b", "c", "label", "year").agg(F.count(F.lit(1)).alias("n")))
    # Titles of what was counted, found once for all charts.
    ids = rows.select(F.explode(F.array_compact(F.array("a", "b", "c"))).alias("dst")).distinct()
    return Counted(rows, cut(corpus.titles().join(ids, "dst", "left_semi")), keys)


def _by_year(k: Counted, chart: str, missing: str | None = None) -> DataFrame:
    rows = k.of(chart, "a", "year").where("year is not null and year != 0")
    rows = k.titled(rows, "a", left=("a",) if missing else ())
    return k.summed(rows.fillna({"a": missing}) if missing else rows)


def _several_years(rows: DataFrame, keys: list[str]) -> DataFrame:
    span = dist.everything(keys)
    return rows.withColumns({"_a": F.min("year").over(span), "_b": F.max("year").over(span)}).where("_a < _b").drop("_a", "_b")


def _trends(k: Counted, top: int = 10) -> DataFrame:
    rows = _by_year(k, "subject")
    total = rows.groupBy(*k.keys, "a").agg(F.sum("n").alias("total"))
    best = ranked(total, k.keys, [F.desc("total"), C.natural_key(F.col("a")).asc(), F.col("a").asc()], top).select(*k.keys, "a")
    rows = _several_years(rows.join(best, [*k.keys, "a"], "left_semi"), k.keys)
    years, names = rows.select(*k.keys, "year").distinct(), rows.select(*k.keys, "a").distinct()
    grid = years.join(names, k.keys) if k.keys else years.crossJoin(names)  # years x at most ten names
    return grid.join(rows, [*k.keys, "year", "a"], "left").fillna({"n": 0})


def _chord(k: Counted, by: list[str], most: int, least: int = 2) -> DataFrame:
    keys = [*k.keys, *by]
    nodes, pairs = (k.of(c, *cols, *by) for c, cols in (("pair_node", ["a"]), ("pair", ["a", "b"])))
    if by:
        nodes, pairs = (df.where("year is not null and year != 0") for df in (nodes, pairs))
    best = ranked(nodes, keys, [F.desc("n"), C.natural_key(F.col("a").cast("string")).asc()], most).select(*keys, "a")
    pairs = pairs.where(F.col("n") >= least).join(best, [*keys, "a"], "left_semi")
    return pairs.join(best.withColumnRenamed("a", "b"), [*keys, "b"], "left_semi").select(*keys, "a", "b", "n")


def _sunburst(k: Counted, top: int = 8) -> DataFrame:
    rows = k.titled(k.of("sunburst", "a", "b", "c"), "a", "b", "c", left=("c",)).fillna({"c": "(no subject)"})
    group = [*k.keys, "a", "b"]
    return ranked(k.summed(rows), group, [F.desc("n"), C.natural_key(F.col("c")).asc(), F.col("c").asc()], top).drop("rank")


def _sankey(k: Counted, top: int = 10) -> DataFrame:
    rows = k.summed(k.titled(k.of("sankey", "a", "b", "c"), "a", "b", "c"))
    total = rows.groupBy(*k.keys, "a").agg(F.sum("n").alias("n"))
    best = ranked(total, k.keys, [F.desc("n"), C.natural_key(F.col("a")).asc(), F.col("a").asc()], top).select(*k.keys, "a")
    rows = rows.join(best, [*k.keys, "a"], "left_semi")
    step = lambda x, y: rows.groupBy(*k.keys, F.col(x).alias("_x"), F.col(y).alias("_y")).agg(F.sum("n").alias("n")).withColumnsRenamed({"_x": "a", "_y": "b"})
    return step("a", "b").unionByName(step("b", "c"))


def _dimension(k: Counted, name: str) -> DataFrame:
    rows = k.of(name, "a").withColumnRenamed("a", "item_id")
    rows = rows.join(k.names.withColumnRenamed("dst", "item_id"), "item_id")
    return ranked(rows, k.keys, by_value(), dist.CAPS.get(name, TOP_ROWS if name in LINKED else None)).select(*k.keys, F.col("title").alias("a"), F.col("item_id").cast("string").alias("b"), "n", "rank")


def _content_sources(k: Counted, most: int = 12) -> DataFrame:
    rows = k.summed(k.titled(k.of("home", "a"), "a"))
    rows = ranked(rows, k.keys, [F.desc("n"), C.natural_key(F.col("a")).asc(), F.col("a").asc()])
    rows = rows.withColumn("groups", F.count(F.lit(1)).over(dist.everything(k.keys)))
    label = F.when((F.col("rank") > most - 1) & (F.col("groups") > most), "Other").otherwise(F.col("a"))
    return rows.groupBy(*k.keys, label.alias("label")).agg(F.sum("n").alias("n")).withColumnRenamed("label", "a")


def _sections(k: Counted) -> dict[str, DataFrame]:
    """Charts over projects, from the sizes that records gave them."""
    links = lambda chart: k.rows.where(F.col("chart") == chart).select(F.col("a").alias("project"), F.col("b").alias("at"))
    size = k.of("project_size", "a").withColumnRenamed("a", "project")
    section, funder = links("first_section"), links("first_funder").withColumnRenamed("at", "funder")
    placed = size.join(section, "project")
    bar = k.titled(links("section_of").groupBy(F.col("at").alias("a")).agg(F.count(F.lit(1)).alias("n")), "a").where("lower(a) != 'external'")
    university = placed.join(funder, "project").groupBy(F.col("at").alias("a"), F.col("funder").alias("b")).agg(F.sum("n").alias("n"))
    box = dist.boxplot(k.titled(placed.select(F.col("at").alias("label"), F.col("n").alias("value")), "label"))
    quantile = F.explode(F.array(*[F.struct(F.lit(q).alias("b"), F.col(q).alias("value")) for q in ("low", "q1", "median", "q3", "high")])).alias("q")
    return {"sections_bar": bar, "section_university": k.summed(k.titled(university, "a", "b")), "boxplot": box.select(F.col("label").alias("a"), quantile).select("a", "q.b", "q.value")}


def dashboard(corpus: Corpus, countries: DataFrame, members: DataFrame | None = None) -> dict[str, DataFrame]:
    """Chart -> rows ([entity,] a, b, c, n, rank, value as it has them), all from one count of cells."""
    return dashboard_of(counted(corpus, countries, members))


def dashboard_of(k: Counted) -> dict[str, DataFrame]:
    charts = {d: _dimension(k, d) for d in dist.DIMENSIONS}
    charts |= {
        "timeline": k.of("record", "year").where("year is not null and year != 0").withColumnRenamed("year", "a"),
        "heatmap": k.summed(k.titled(k.of("heatmap", "a", "b"), "a", "b")),
        "roles": k.of("roles", "label").withColumnRenamed("label", "a"),
        "stacked_timeline": _by_year(k, "type", "No type").select(*k.keys, F.col("year").alias("_y"), F.col("a").alias("b"), "n").withColumnRenamed("_y", "a"),
        "subject_trends": _trends(k).select(*k.keys, F.col("year").alias("_y"), F.col("a").alias("b"), "n").withColumnRenamed("_y", "a"),
        "language_timeline": _several_years(_by_year(k, "language"), k.keys).select(*k.keys, F.col("year").alias("_y"), F.col("a").alias("b"), "n").withColumnRenamed("_y", "a"),
        "chord": _chord(k, [], 20),
        "time_chord": _several_years(_chord(k, ["year"], 16), k.keys).select(*k.keys, F.col("year").alias("c"), "a", "b", "n"),
        "sankey": _sankey(k),
        "sunburst": _sunburst(k),
        "geo_flows": k.of("geo_flows", "a", "b"),
        "choropleth": k.of("choropleth", "label").withColumnRenamed("label", "a"),
        "content_sources": _content_sources(k),
    }
    return charts | ({} if k.keys else _sections(k))


def publications(corpus: Corpus, countries: DataFrame, chosen: DataFrame, names: DataFrame) -> dict[str, DataFrame]:
    """The charts of a set of publications (item_id): the shared ones, venues, funders and publishers, where they appeared, and the summary's numbers.

    ``names`` (alias, outline) are the countries' (geo.outline_names). Countries of publication follow places upwards and are read on their own.
    """
    corpus = replace(corpus, records=corpus.records.join(chosen.select("item_id").distinct(), "item_id", "left_semi"))
    k = counted(corpus, countries)
    shared = dashboard_of(k)
    charts = {c: shared[c] for c in ("timeline", "types", "languages", "subjects", "contributors", "genres", "stacked_timeline", "chord")}
    charts |= {c: _dimension(k, c) for c in LINKED}
    charts["locations"] = _dimension(k, "published_at")
    lands = geo.publication_countries(corpus, corpus.records, names)
    charts["publication_countries"] = lands.select(F.col("country").alias("a"), F.col("outline").alias("b"), "n")
    one = lambda df, key: df.agg(F.lit(key).alias("a"), F.count(F.lit(1)).alias("n"))
    total = k.of("record").select(F.lit("publications").alias("a"), "n")
    counts = {c: c for c in ("types", "languages", "people", "published_at")} | {"journals": "top_journals", "series": "top_series", "publishers": "publishers"}
    numbers = [total, one(lands, "countries"), *(one(k.of(chart, "a").join(k.names.withColumnRenamed("dst", "a"), "a", "left_semi"), key) for key, chart in counts.items())]
    charts["stats"] = reduce(DataFrame.unionByName, numbers).where("n > 0")
    return charts


#: Kinds of entities that places are picked by, and whether only the first are offered.
PICKED = {"Project": False, "Section": False, "Person": True, "Organisation": True, "Subject": True}


def _pickable(rows: DataFrame) -> DataFrame:
    """(item_id, type, entity) of a record's projects, people, organisations and subjects, and of its projects' sections."""
    listed = {
        "Project": lambda x: (x["term"] == C.IS_PART_OF) & (x["kind"] == C.PROJECT), "Person": lambda x: C.is_credit(x["term"]) & (x["kind"] == C.PERSON),
        "Organisation": lambda x: C.is_institution_credit(x["term"]) & (x["kind"] == C.ORGANISATION), "Subject": lambda x: x["term"] == C.SUBJECT,
    }
    found = [F.transform(F.array_distinct(F.transform(F.filter("s", test), lambda x: x["dst"])), _kind_of(kind)) for kind, test in listed.items()]
    mine = rows.where("is_record").select("item_id", F.explode(reduce(lambda x, y: F.concat(x, y), found)).alias("e")).select("item_id", "e.*")
    up = rows.where(F.col("class_term") == C.PROJECT).select(F.col("item_id").alias("entity"), F.explode(F.transform(F.filter("s", lambda x: (x["term"] == C.IS_PART_OF) & (x["kind"] == C.GROUP)), lambda x: x["dst"])).alias("section"))
    sections = mine.where("type = 'Project'").join(up, "entity").select("item_id", F.lit("Section").alias("type"), F.col("section").alias("entity")).distinct()
    return mine.unionByName(sections)


def _kind_of(kind: str) -> Callable[[Column], Column]:
    return lambda x: F.struct(F.lit(kind).alias("type"), x.alias("entity"))


def spatial(corpus: Corpus, countries: DataFrame, top: int = TOP_PICKER) -> dict[str, DataFrame]:
    """Places and countries with their records by role, who may be picked, and the places of each.

    One reading of the statements; places and picked entities are counted by GROUPING SETS over (type, entity, place, role).
    """
    rows = cut(statements(corpus, countries).where("is_record or size(s) > 0"))
    journals = F.coalesce(F.col("class_term") == C.JOURNAL, F.lit(False))
    at = F.array_distinct(F.transform(F.filter("s", lambda x: x["term"].isin(C.SPATIAL, C.PROVENANCE) & x["placed"]), lambda x: F.struct(x["dst"].alias("place"), x["term"].alias("term"))))
    placed = rows.where(F.col("is_record") & ~journals).select("item_id", F.explode(at).alias("p")).select("item_id", "p.place", F.when(F.col("p.term") == C.SPATIAL, "origin").otherwise("current").alias("role"))
    all_of = placed.select("item_id", F.lit(None).cast("string").alias("type"), F.lit(None).cast("long").alias("entity"), "place", "role")
    of = placed.join(_pickable(rows), "item_id").select("item_id", "type", "entity", "place", "role")
    k = cut(all_of.unionByName(of).groupingSets([["type", "entity", "place", "role"], ["type", "entity", "place"]], "type", "entity", "place", "role").agg(F.grouping("role").alias("all_roles"), F.count(F.lit(1)).alias("n")))
    plain = k.where("type is null")
    by_role = plain.where("all_roles = 0")
    lands = by_role.join(countries.select(F.col("item_id").alias("place"), "country"), "place").groupBy("country", "role").agg(F.sum("n").alias("n"))
    picked = k.where("type is not null")
    titles = corpus.titles().withColumnRenamed("dst", "entity")
    entities = picked.where("all_roles = 1").groupBy("type", "entity").agg(F.count(F.lit(1)).alias("n")).join(titles, "entity")
    order = ranked(entities, ["type"], [F.desc("n"), F.col("title").asc(), F.col("entity").asc()])
    order = order.where(~F.col("type").isin(*[t for t, capped in PICKED.items() if capped]) | (F.col("rank") <= top))
    return {
        "locations": by_role.select(F.col("place").alias("a"), F.col("role").alias("b"), "n"),
        "countries": lands.select(F.col("country").alias("a"), F.col("role").alias("b"), "n"),
        "pickers": order.select(F.col("type").alias("a"), F.col("entity").alias("b"), F.col("title").alias("c"), "n", "rank"),
        "entity_places": picked.where("all_roles = 0").join(order.select("type", "entity"), ["type", "entity"], "left_semi").select(F.col("entity").alias("a"), F.col("place").alias("b"), F.concat_ws(" ", "type", "role").alias("c"), "n"),
    }


def artifact(name: str, charts: dict[str, DataFrame]) -> DataFrame:
    """(artifact, chart, [entity,] a, b, c, n, rank, value) of a dashboard's charts: keys as text, each chart's rows told by them."""
    kinds = {"a": "string", "b": "string", "c": "string", "n": "long", "rank": "long", "value": "double"}
    out = None
    for chart, df in charts.items():
        keys = ["entity"] if "entity" in df.columns else []
        columns = [(F.col(c).cast(t) if c in df.columns else F.lit(None).cast(t)).alias(c) for c, t in kinds.items()]
        rows = df.select(F.lit(name).alias("artifact"), F.lit(chart).alias("chart"), *keys, *columns)
        out = rows if out is None else out.unionByName(rows)
    return out
