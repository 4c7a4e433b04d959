"""Distributions, ranked lists and cross-tabs.

Every function takes a Corpus and optionally ``members`` (entity, item_id):
with it all grouping keys get ``entity``, and one pass answers every entity.
Facts are counted by target id first (map-side combined); titles are joined
to the few counted rows afterwards.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.window import WindowSpec

from folioscope.corpus import Corpus
from folioscope.functions import columns as C
from folioscope.operators.graphs import cut
from folioscope.operators.network import meet
from folioscope.operators.ranking import TOP_ROWS, TOP_SUBJECTS, by_value, first_link, page, ranked

#: Dimension -> predicate on the term. All credits are one dimension.
DIMENSIONS = {
    "types": lambda t: t == C.TYPE,
    "languages": lambda t: t == C.LANGUAGE,
    "subjects": lambda t: t == C.SUBJECT,
    "genres": lambda t: t == C.FORMAT,
    "contributors": C.is_credit,
    "locations": lambda t: t == C.SPATIAL,
    "current_locations": lambda t: t == C.PROVENANCE,
}
CAPS = {"subjects": TOP_SUBJECTS, "contributors": TOP_ROWS}


def counted(corpus: Corpus, name: str, members: DataFrame | None = None) -> tuple[DataFrame, list[str]]:
    """(item_id, title, n) of all targets, and the keys: records per target, each record once; untitled targets are dropped."""
    links, keys = corpus.scoped() if members is None else (corpus.links, [])
    some = links.where(DIMENSIONS[name](F.col("term"))).select("src", "dst").distinct()
    if members is not None:  # different rows on both sides make different rows
        keys, scope = ["entity"], members.select("entity", F.col("item_id").alias("src")).distinct()
        some = meet(cut(some), cut(scope), ["src"])
    counts = some.groupBy(*keys, "dst").agg(F.count(F.lit(1)).alias("n"))
    return counts.join(corpus.titles(), "dst").withColumnRenamed("dst", "item_id"), keys


def dimension(corpus: Corpus, name: str, members: DataFrame | None = None) -> DataFrame:
    """(item_id, title, n, rank): the first of counted(), subjects and contributors up to their cap."""
    rows, keys = counted(corpus, name, members)
    return ranked(rows, keys, by_value(), CAPS.get(name))


def timeline(corpus: Corpus, members: DataFrame | None = None) -> DataFrame:
    items, keys = corpus.scoped_items(members)
    return items.where("year is not null and year != 0").groupBy(*keys, "year").agg(F.count(F.lit(1)).alias("n"))


def pair_counts(corpus: Corpus, a: Column, b: Column, members: DataFrame | None = None) -> tuple[DataFrame, list[str]]:
    """(a, b, n) for targets of two kinds of links of the same record (C4)."""
    links, keys = corpus.scoped(members)
    left = links.where(a).select(*keys, "src", F.col("dst").alias("a"))
    right = links.where(b).select(*keys, "src", F.col("dst").alias("b"))
    return left.join(right, [*keys, "src"]).groupBy(*keys, "a", "b").agg(F.count(F.lit(1)).alias("n")), keys


def titled(rows: DataFrame, corpus: Corpus, *names: str) -> DataFrame:
    """Replaces id columns by titles, dropping untitled ones, and sums n by what remains equal."""
    for name in names:
        titles = corpus.titles().select(F.col("dst").alias(name), F.col("title").alias(f"{name}_title"))
        rows = rows.join(titles, name).drop(name).withColumnRenamed(f"{name}_title", name)
    others = [c for c in rows.columns if c != "n"]
    return rows.groupBy(*others).agg(F.sum("n").alias("n"))


def heatmap(corpus: Corpus, members: DataFrame | None = None) -> DataFrame:
    """(row, col, n): type title x language title."""
    term = F.col("term")
    counts, _ = pair_counts(corpus, term == C.TYPE, term == C.LANGUAGE, members)
    return titled(counts, corpus, "a", "b").withColumnsRenamed({"a": "row", "b": "col"})


def roles(corpus: Corpus, members: DataFrame | None = None, entity: int | None = None) -> DataFrame:
    """(role, n): credit statements, not records; of one entity if asked."""
    links, keys = corpus.scoped(members)
    some = links.where(C.is_credit(F.col("term")))
    if entity is not None:
        some = some.where(F.col("dst") == entity)
    return some.groupBy(*keys, C.role_label(F.col("term")).alias("role")).agg(F.count(F.lit(1)).alias("n"))


def roles_by_entity(corpus: Corpus) -> DataFrame:
    """(entity, role, n) for every credited entity in one pass."""
    links, _ = corpus.scoped()
    some = links.where(C.is_credit(F.col("term")))
    return some.groupBy(F.col("dst").alias("entity"), C.role_label(F.col("term")).alias("role")).agg(F.count(F.lit(1)).alias("n"))


def templates(corpus: Corpus, members: DataFrame | None = None, labels: dict[int, str] | None = None) -> DataFrame:
    """(label, n), empty with fewer than two templates."""
    items, keys = (corpus.items, []) if members is None else corpus.scoped_items(members)
    counts = items.where("template_id is not null").groupBy(*keys, "template_id").agg(F.count(F.lit(1)).alias("n"))
    pairs = [F.lit(x) for kv in (labels or {}).items() for x in kv]
    named = F.element_at(F.create_map(*pairs), F.col("template_id")) if pairs else F.lit(None).cast("string")
    label = F.coalesce(named, F.concat(F.lit("Template "), F.col("template_id").cast("string")))
    n = F.count(F.lit(1)).over(everything(keys))
    return counts.withColumn("_templates", n).where("_templates >= 2").select(*keys, label.alias("label"), "n")


def everything(keys: list[str]) -> WindowSpec:
    """All rows of a key, or all rows; for aggregated rows only."""
    return Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(1))


def value_keys(corpus: Corpus, terms: list[str], members: DataFrame | None = None) -> tuple[DataFrame, list[str]]:
    """(item_id, key, value, target): linked and literal values of the terms, a literal joined to the linked record whose title it spells."""
    links, keys = corpus.scoped(members)
    linked = links.where(F.col("term").isin(*terms)).join(corpus.titles(), "dst").select(*keys, F.col("src").alias("item_id"), F.col("dst").alias("target"), F.col("title").alias("value"))
    literals = corpus.values(*(t for t in terms if t in C.LITERAL_TERMS))
    scope = corpus.records if members is None else members
    literals = literals.join(scope, "item_id").select(*keys, "item_id", F.trim("value").alias("value")).where("value != ''")
    spelt = F.lower(F.trim("value"))
    known = linked.groupBy(*keys, spelt.alias("spelt")).agg(F.min("target").alias("known"))
    literals = literals.withColumn("spelt", spelt).join(known, [*keys, "spelt"], "left")
    both = linked.select(*keys, "item_id", "value", "target").unionByName(literals.select(*keys, "item_id", "value", F.col("known").alias("target")))
    key = F.when(F.col("target").isNotNull(), F.concat(F.lit("#"), F.col("target").cast("string"))).otherwise(F.lower("value"))
    return both.withColumn("key", key), keys


def top_values(corpus: Corpus, terms: list[str], members: DataFrame | None = None, top: int = TOP_ROWS) -> DataFrame:
    """(value, item_id, n, rank): linked and literal values together, once a record; a literal that spells a linked title counts with it."""
    rows, keys = value_keys(corpus, terms, members)
    titles = corpus.titles().select(F.col("dst").alias("item_id"), "title")
    counts = rows.groupBy(*keys, "key").agg(F.countDistinct("item_id").alias("n"), F.min("value").alias("spelling"), F.min("target").alias("target"))
    counts = counts.withColumnRenamed("target", "item_id").join(titles, "item_id", "left")
    counts = counts.select(*keys, F.coalesce("title", "spelling").alias("value"), "item_id", "n")
    return ranked(counts, keys, by_value(title="value"), top)


def count_distinct_values(corpus: Corpus, terms: list[str], members: DataFrame | None = None) -> DataFrame:
    rows, keys = value_keys(corpus, terms, members)
    return rows.groupBy(*keys).agg(F.countDistinct("key").alias("n"))


def top_linked(corpus: Corpus, terms: list[str], members: DataFrame | None = None, classes: list[str] | None = None, top: int = TOP_ROWS) -> DataFrame:
    """(item_id, title, n, rank) over targets of the terms, of some classes if asked."""
    links, keys = corpus.scoped(members)
    some = links.where(F.col("term").isin(*terms)).select(*keys, "src", "dst").distinct()
    counts = some.groupBy(*keys, "dst").agg(F.count(F.lit(1)).alias("n"))
    if classes:
        counts = counts.join(corpus.of_class(*classes), F.col("dst") == F.col("item_id"), "left_semi")
    rows = counts.join(corpus.titles(), "dst").withColumnRenamed("dst", "item_id")
    return ranked(rows, keys, by_value(), top)


def count_linked_of_class(corpus: Corpus, terms: list[str], classes: list[str], members: DataFrame | None = None) -> DataFrame:
    links, keys = corpus.scoped(members)
    some = links.where(F.col("term").isin(*terms)).select(*keys, "dst").distinct()
    return some.join(corpus.of_class(*classes), F.col("dst") == F.col("item_id"), "left_semi").groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))


def items_linked_to_title(corpus: Corpus, term: str, title: str, members: DataFrame | None = None) -> DataFrame:
    """Records with a link to a record of exactly this title, case and outer spaces aside."""
    links, keys = corpus.scoped(members)
    wanted = corpus.titles().where(F.lower(F.trim("title")) == title.strip().lower())
    some = links.where(F.col("term") == term).join(wanted, "dst", "left_semi")
    return some.groupBy(*keys).agg(F.countDistinct("src").alias("n"))


def top_authors(corpus: Corpus, members: DataFrame | None = None, top: int = TOP_ROWS) -> DataFrame:
    """(name, n, matched, item_id, rank): linked persons and literal names by name, once a record."""
    links, keys = corpus.scoped(members)
    people = corpus.of_class(C.PERSON).withColumnRenamed("item_id", "dst")
    linked = links.where(C.is_credit(F.col("term"))).join(people, "dst", "left_semi").join(corpus.titles(), "dst")
    linked = linked.select(*keys, "src", F.trim("title").alias("name"), F.col("dst").alias("target"), "ord")
    scope = corpus.records if members is None else members
    literal = corpus.values(C.AUTHORS).join(scope, "item_id")
    literal = literal.select(*keys, F.col("item_id").alias("src"), F.trim("value").alias("name"), F.lit(None).cast("long").alias("target"), "ord")
    rows = linked.unionByName(literal).where("name != ''")
    counts = rows.groupBy(*keys, "name").agg(F.countDistinct("src").alias("n"), F.max(F.col("target").isNotNull()).alias("matched"), F.max("target").alias("item_id"))
    return ranked(counts, keys, [F.desc("n"), C.natural_key(F.col("name")).asc(), F.col("name").asc()], top)


def co_targets(corpus: Corpus, entities: DataFrame, is_dim: Column, classes: list[str] | None = None, top: int = TOP_ROWS) -> DataFrame:
    """(entity, item_id, title, n, rank): what else the records that have an entity in this dimension link to, by statements."""
    links, _ = corpus.scoped()
    mine = links.where(is_dim).join(entities, F.col("dst") == F.col("entity")).select("entity", "src").distinct()
    others = links.where(is_dim).select("src", "dst")
    if classes:
        others = others.join(corpus.of_class(*classes), F.col("dst") == F.col("item_id"), "left_semi")
    counts = mine.join(others, "src").where("dst != entity").groupBy("entity", "dst").agg(F.count(F.lit(1)).alias("n"))
    rows = counts.join(corpus.titles(), "dst").withColumnRenamed("dst", "item_id")
    return ranked(rows, ["entity"], [F.desc("n"), F.col("title").asc(), F.col("item_id").asc()], top)


def category_members(corpus: Corpus, terms: list[str], entities: DataFrame) -> DataFrame:
    """(item_id, title, n): records per member of a category, through any of the terms."""
    links, _ = corpus.scoped()
    some = links.where(F.col("term").isin(*terms)).join(entities, F.col("dst") == F.col("item_id"), "left_semi")
    return some.groupBy("dst").agg(F.countDistinct("src").alias("n")).join(corpus.titles(), "dst").withColumnRenamed("dst", "item_id")


def children(corpus: Corpus, classes: list[str]) -> DataFrame:
    """(parent, item_id, ord) of isPartOf statements to targets of some classes."""
    links = corpus.links.where(F.col("term") == C.IS_PART_OF)
    return links.join(corpus.of_class(*classes), F.col("dst") == F.col("item_id"), "left_semi").select(F.col("dst").alias("parent"), F.col("src").alias("item_id"), "ord")


def sections_bar(corpus: Corpus) -> DataFrame:
    """(section, n): projects of each section, the external one aside."""
    kids = children(corpus, [C.GROUP]).join(corpus.of_class(C.PROJECT), "item_id", "left_semi")
    counts = kids.groupBy(F.col("parent").alias("dst")).agg(F.count(F.lit(1)).alias("n"))
    return counts.join(corpus.titles(), "dst").where("lower(title) != 'external'").select(F.col("title").alias("section"), "n")


def section_university(corpus: Corpus) -> DataFrame:
    """(section, funder, n): records of each project, under its section and its first titled funder."""
    project = children(corpus, [C.GROUP]).groupBy("item_id").agg(F.min_by("parent", "ord").alias("section"))
    funders = corpus.links.where(F.col("term") == C.FUNDER).join(corpus.titles(), "dst")
    funder = funders.groupBy(F.col("src").alias("item_id")).agg(F.min_by("title", "ord").alias("funder"))
    size = children(corpus, [C.PROJECT]).groupBy(F.col("parent").alias("item_id")).agg(F.countDistinct("item_id").alias("n"))
    rows = project.join(funder, "item_id").join(size, "item_id").withColumnRenamed("section", "dst").join(corpus.titles(), "dst")
    return rows.groupBy(F.col("title").alias("section"), "funder").agg(F.sum("n").alias("n"))


def profiles(corpus: Corpus, members: DataFrame) -> DataFrame:
    """(entity, items, languages, subjects, contributors, types, year_span): breadth of each entity; titles aren't asked for."""
    links = corpus.links.join(members, F.col("src") == members["item_id"]).select("entity", "term", "dst")
    term = F.col("term")
    kind = F.when(term == C.LANGUAGE, "languages").when(term == C.SUBJECT, "subjects").when(term == C.TYPE, "types").when(C.is_credit(term), "contributors")
    # Distinct (entity, kind, dst) first: one shuffle, where a countDistinct each would multiply the rows.
    found = links.select("entity", kind.alias("kind"), "dst").where("kind is not null").distinct()
    wide = found.groupBy("entity").agg(*[F.count_if(F.col("kind") == k).alias(k) for k in ("languages", "subjects", "contributors", "types")])
    items = corpus.items.join(members, "item_id").groupBy("entity").agg(
        F.count(F.lit(1)).alias("items"),
        F.coalesce(F.max("year") - F.min("year"), F.lit(0)).cast("long").alias("year_span"),
    )
    zero = {c: 0 for c in ("languages", "subjects", "contributors", "types")}
    return items.join(wide, "entity", "left").fillna(zero).select("entity", "items", "languages", "subjects", "contributors", "types", "year_span")


AXES = ("items", "languages", "subjects", "contributors", "types", "year_span")


def radar(profile: DataFrame) -> DataFrame:
    """(entity, axis, value, share): share of the axis's maximum over all entities; entities with fewer than 3 positive axes are left out."""
    maxima = profile.agg(*[F.max(a).alias(f"max_{a}") for a in AXES])
    positive = sum((F.col(a) > 0).cast("int") for a in AXES)
    stack = ", ".join(f"'{a}', {a}, max_{a}" for a in AXES)
    rows = profile.where(positive >= 3).join(F.broadcast(maxima))  # maxima is one row
    rows = rows.select("entity", F.expr(f"stack({len(AXES)}, {stack}) as (axis, value, top)")).where("top > 0")
    return rows.select("entity", "axis", "value", F.round(F.col("value") / F.col("top"), 6).alias("share"))


#: Exclusive upper bounds in minutes of the duration bands; the last is open.
BANDS = (20, 30, 40, 50, 60)


def duration_histogram(durations: DataFrame) -> DataFrame:
    """(band, n) of a column ``seconds``; 0 and less are skipped, empty bands don't show."""
    minutes = F.col("seconds") / 60
    band = F.lit(len(BANDS))
    for i, upper in reversed(list(enumerate(BANDS))):
        band = F.when(minutes < upper, F.lit(i)).otherwise(band)
    return durations.where("seconds > 0").groupBy(band.cast("int").alias("band")).agg(F.count(F.lit(1)).alias("n"))


def source_counts(corpus: Corpus) -> DataFrame:
    """(source, n): rows of the corpus's parts."""
    parts = {"items": corpus.items, "relationships": corpus.links, "sets": corpus.memberships.select("set_id").distinct(), "places": corpus.geo}
    counts = [df.agg(F.lit(name).alias("source"), F.count(F.lit(1)).alias("n")) for name, df in parts.items()]
    return union(counts)


def union(frames: list[DataFrame]) -> DataFrame:
    out = frames[0]
    for df in frames[1:]:
        out = out.unionByName(df)
    return out


def source_coverage(corpus: Corpus, terms: dict[str, Column], sources: DataFrame) -> DataFrame:
    """(source, dimension, covered): which sources (source, item_id) have a link of a kind at all."""
    links = corpus.links.join(sources, F.col("src") == sources["item_id"])
    flags = [F.max(cond).alias(name) for name, cond in terms.items()]
    wide = links.groupBy("source").agg(*flags)
    stack = ", ".join(f"'{n}', {n}" for n in terms)
    return wide.select("source", F.expr(f"stack({len(terms)}, {stack}) as (dimension, covered)"))


def boxplot(groups: DataFrame) -> DataFrame:
    """(label, low, q1, median, q3, high) of ``value`` > 0 per ``label``, linear quantiles; empty with fewer than two labels."""
    some = groups.where("value > 0")
    q = F.percentile("value", F.array(*[F.lit(x) for x in (0.0, 0.25, 0.5, 0.75, 1.0)]))
    out = some.groupBy("label").agg(q.alias("q"))
    names = ("low", "q1", "median", "q3", "high")
    out = out.withColumn("_n", F.count(F.lit(1)).over(everything([]))).where("_n >= 2")
    return out.select("label", *[F.round(F.col("q")[i], 6).alias(n) for i, n in enumerate(names)])


def project_sizes(corpus: Corpus) -> DataFrame:
    """(project, section, n): records of each project."""
    size = children(corpus, [C.PROJECT]).groupBy(F.col("parent").alias("project")).agg(F.countDistinct("item_id").alias("n"))
    section = children(corpus, [C.GROUP]).groupBy(F.col("item_id").alias("project")).agg(F.min_by("parent", "ord").alias("section"))
    return size.join(section, "project")


def score_quantiles(rows: DataFrame, column: str) -> DataFrame:
    """(name, value): minimum, 5 %, quarter, median, three quarters, 95 %, maximum."""
    names = {"min": 0.0, "p05": 0.05, "p25": 0.25, "median": 0.5, "p75": 0.75, "p95": 0.95, "max": 1.0}
    q = rows.agg(F.percentile(column, F.array(*[F.lit(v) for v in names.values()])).alias("q"))
    pairs = F.arrays_zip(F.array(*[F.lit(n) for n in names]).alias("name"), F.col("q").alias("value"))
    return q.select(F.inline(pairs).alias("name", "value")).select("name", F.round("value", 6).alias("value"))


def paged(rows: DataFrame, order: list[Column], size: int = 20) -> DataFrame:
    """Adds rank and page."""
    return ranked(rows, [], order).withColumn("page", page(F.col("rank"), size))


def first_per(corpus: Corpus, term: str, classes: list[str] | None = None) -> DataFrame:
    """(item_id, target): the first link of a term per record, to some classes if asked."""
    links, _ = corpus.scoped()
    some = links.where(F.col("term") == term)
    if classes:
        some = some.join(corpus.of_class(*classes), F.col("dst") == F.col("item_id"), "left_semi")
    return first_link(some, ["src"]).select(F.col("src").alias("item_id"), F.col("dst").alias("target"))
