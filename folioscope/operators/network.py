"""Co-occurrence networks as edge tables.

Pairs come from a self-join on the record, so their number grows with the
square of one record's targets, not of a target's records; each record's
targets are made distinct first and the pairs counted map-side.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioscope.corpus import Corpus
from folioscope.functions import columns as C
from folioscope.operators.graphs import cut
from folioscope.operators.ranking import last_link, numbered, ranked


#: Joined rows of one task, of which it holds a count or a set in memory.
MET = 1 << 19


def tasks(left: DataFrame, right: DataFrame, on: list[str]) -> int:
    """Tasks of a join on ``on``, so many that each makes about MET rows."""
    one, none = F.lit(1).cast("long"), F.lit(0).cast("long")
    rows = left.select(*on, one.alias("_l"), none.alias("_r")).unionByName(right.select(*on, none.alias("_l"), one.alias("_r")))
    # The rows of a key are counted in tasks that go by the rows too.
    counts = summed(rows, on, ["_l", "_r"], max(left.sparkSession.sparkContext.defaultParallelism, -(-left.count() // MET)))
    made = counts.where("_l > 0 and _r > 0").agg(F.sum(F.col("_l") * F.col("_r"))).first()[0] or 0
    return max(left.sparkSession.sparkContext.defaultParallelism, -(-made // MET))


def meet(left: DataFrame, right: DataFrame, on: list[str], n: int | None = None) -> DataFrame:
    """Inner join on ``on``, dealt to ``n`` or tasks() tasks: their number goes by the rows made, not by the rows read. Both sides are read twice."""
    n = n or tasks(left, right, on)
    return left.repartition(n, *on).join(right.repartition(n, *on), on)


def summed(rows: DataFrame, keys: list[str], sums: list[str], n: int) -> DataFrame:
    """Sums by ``keys`` in ``n`` tasks, whatever Spark's number of shuffle partitions: rows are added up where they are made, some MET at a time, and dealt by their keys."""

    def added(held: list[pa.RecordBatch]) -> pa.Table:
        table = pa.Table.from_batches(held).group_by(keys).aggregate([(c, "sum") for c in sums])
        return pa.table([table.column(c) for c in keys] + [table.column(f"{c}_sum") for c in sums], names=[*keys, *sums])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            held.append(batch)
            size += batch.num_rows
            if size >= MET:
                yield from added(held).to_batches()
                held, size = [], 0
        if held:
            yield from added(held).to_batches()

    rows = rows.select(*keys, *[F.col(c).cast("long").alias(c) for c in sums])
    return rows.mapInArrow(run, rows.schema).repartition(n, *keys).groupBy(*keys).agg(*[F.sum(c).alias(c) for c in sums])


def pairs(rows: DataFrame, keys: list[str], min_count: int = 1) -> DataFrame:
    """(a, b, n), a < b, of rows (src, dst) that share a src."""
    on = [*keys, "src"]
    one = cut(rows.select(*on, "dst").distinct())
    a, b = (one.select(*on, F.col("dst").alias(name)) for name in ("a", "b"))
    n = tasks(a, b, on)
    both = meet(a, b, on, n).where("a < b").withColumn("n", F.lit(1))
    return summed(both, [*keys, "a", "b"], ["n"], n).where(F.col("n") >= min_count)


def chord_nodes(corpus: Corpus, term: str, members: DataFrame | None = None, max_nodes: int = 20) -> tuple[DataFrame, DataFrame, list[str]]:
    """Top targets (dst, n, rank) among records with two targets or more, those records' rows, and the keys."""
    links, keys = corpus.scoped(members)
    rows = links.where(F.col("term") == term).join(corpus.titles(), "dst", "left_semi").select(*keys, "src", "dst").distinct()
    several = rows.groupBy(*keys, "src").agg(F.count(F.lit(1)).alias("k")).where("k >= 2").drop("k")
    rows = rows.join(several, [*keys, "src"], "left_semi")
    counts = rows.groupBy(*keys, "dst").agg(F.count(F.lit(1)).alias("n"))
    nodes = ranked(counts, keys, [F.desc("n"), C.natural_key(F.col("dst").cast("string")).asc()], max_nodes)
    return nodes, rows, keys


def chord(corpus: Corpus, term: str, members: DataFrame | None = None, max_nodes: int = 20, min_count: int = 2) -> DataFrame:
    """(a, b, n) between the top targets."""
    nodes, rows, keys = chord_nodes(corpus, term, members, max_nodes)
    return pairs(rows.join(nodes.select(*keys, "dst"), [*keys, "dst"], "left_semi"), keys, min_count)


def person_project(corpus: Corpus, members: DataFrame | None = None, top_people: int = 120, top_projects: int = 80) -> DataFrame:
    """(person, project, n): records per person and last project, among the top of each."""
    links, keys = corpus.scoped(members)
    on = [*keys, "src"]
    people = of_class(corpus, links.where(C.is_credit(F.col("term"))), C.PERSON).select(*on, F.col("dst").alias("person")).distinct()
    projects = of_class(corpus, links.where(F.col("term") == C.IS_PART_OF), C.PROJECT)
    rows = people.join(last_link(projects, on).withColumnRenamed("dst", "project"), on)
    edges = rows.groupBy(*keys, "person", "project").agg(F.count(F.lit(1)).alias("n"))
    best_people = _top(edges, keys, "person", top_people)
    best_projects = _top(edges, keys, "project", top_projects)
    return edges.join(best_people, [*keys, "person"], "left_semi").join(best_projects, [*keys, "project"], "left_semi")


def of_class(corpus: Corpus, links: DataFrame, *classes: str, column: str = "dst") -> DataFrame:
    return links.join(corpus.of_class(*classes), F.col(column) == F.col("item_id"), "left_semi")


def _top(edges: DataFrame, keys: list[str], name: str, top: int) -> DataFrame:
    total = edges.groupBy(*keys, name).agg(F.sum("n").alias("total"))
    return ranked(total, keys, [F.desc("total"), C.natural_key(F.col(name).cast("string")).asc()], top).select(*keys, name)


def person_rows(corpus: Corpus, members: DataFrame | None = None) -> tuple[DataFrame, list[str]]:
    """(src, dst) of credited persons."""
    links, keys = corpus.scoped(members)
    return of_class(corpus, links.where(C.is_credit(F.col("term"))), C.PERSON).select(*keys, "src", "dst"), keys


def collaboration(corpus: Corpus, members: DataFrame | None = None, min_count: int = 2) -> DataFrame:
    rows, keys = person_rows(corpus, members)
    return pairs(rows, keys, min_count)


def affiliations(corpus: Corpus) -> DataFrame:
    """(person, institution) statements."""
    links = of_class(corpus, corpus.links.where(F.col("term") == C.IS_PART_OF), C.ORGANISATION)
    return of_class(corpus, links, C.PERSON, column="src").select(F.col("src").alias("person"), F.col("dst").alias("institution"))


def affiliation_network(corpus: Corpus, top_people: int = 120, top_institutions: int = 80) -> DataFrame:
    """(person, institution, n)."""
    edges = affiliations(corpus).groupBy("person", "institution").agg(F.count(F.lit(1)).alias("n"))
    people, places = _top(edges, [], "person", top_people), _top(edges, [], "institution", top_institutions)
    return edges.join(people, "person", "left_semi").join(places, "institution", "left_semi")


def institution_rows(corpus: Corpus) -> DataFrame:
    """(src, dst): institutions of a record: linked ones, affiliations of its people, funders of its last project."""
    links, _ = corpus.scoped()
    term = F.col("term")
    direct = of_class(corpus, links.where(term.isin(C.FUNDER, C.PROVENANCE) | C.is_credit(term)), C.ORGANISATION).select("src", "dst")
    people, _ = person_rows(corpus)
    through = people.join(affiliations(corpus), F.col("dst") == F.col("person")).select("src", F.col("institution").alias("dst"))
    project = last_link(of_class(corpus, links.where(term == C.IS_PART_OF), C.PROJECT), ["src"]).withColumnRenamed("dst", "project")
    funders = of_class(corpus, corpus.links.where(term == C.FUNDER), C.ORGANISATION).select(F.col("src").alias("project"), "dst")
    return direct.unionByName(through).unionByName(project.join(funders, "project").select("src", "dst")).distinct()


def institution_collaboration(corpus: Corpus, top: int = 80) -> DataFrame:
    """(a, b, n) among the institutions with the most records."""
    rows = cut(institution_rows(corpus))
    counts = rows.groupBy("dst").agg(F.count(F.lit(1)).alias("n"))
    best = ranked(counts, [], [F.desc("n"), C.natural_key(F.col("dst").cast("string")).asc()], top).select("dst")
    return pairs(rows.join(best, "dst", "left_semi"), [])


def affiliation_ego(corpus: Corpus, top: int = 30) -> DataFrame:
    """(entity, person, institution): for every institution its people and their other affiliations; the institutions with the most such people."""
    links = affiliations(corpus)
    mine = links.select(F.col("institution").alias("entity"), "person")
    others = mine.join(links, "person").where("institution != entity")
    counts = others.groupBy("entity", "institution").agg(F.countDistinct("person").alias("n"))
    best = ranked(counts, ["entity"], [F.desc("n"), F.col("institution").asc()], top).select("entity", "institution")
    return mine.withColumn("institution", F.col("entity")).unionByName(others.join(best, ["entity", "institution"], "left_semi")).distinct()


def ego_collaboration(corpus: Corpus, rows: DataFrame, entities: DataFrame, top: int = 25, min_shared: int = 2) -> tuple[DataFrame, DataFrame]:
    """Spokes (entity, other, n) by statements, and extra edges (entity, a, b, n) between an entity's spokes that share records anywhere.

    ``rows`` (src, dst) are all the statements that count.
    """
    mine = rows.join(entities, F.col("dst") == F.col("entity")).select("entity", "src").distinct()
    counts = mine.join(rows, "src").where("dst != entity").groupBy("entity", F.col("dst").alias("other")).agg(F.count(F.lit(1)).alias("n"))
    spokes = ranked(counts, ["entity"], [F.desc("n"), F.col("other").asc()], top)
    shared = pairs(rows, [], min_shared)
    a, b = spokes.select("entity", F.col("other").alias("a")), spokes.select("entity", F.col("other").alias("b"))
    extra = shared.join(a, "a").join(b, ["entity", "b"]).select("entity", "a", "b", "n")
    return spokes, extra


def reachable(corpus: Corpus, starts: DataFrame, hops: int = 5) -> DataFrame:
    """(item_id, above, hop): isPartOf ancestors within ``hops``; each hop is one join, and loops end with the hops."""
    up = corpus.links.where(F.col("term") == C.IS_PART_OF).select(F.col("src").alias("at"), F.col("dst").alias("above"))
    level = starts.select("item_id", F.col("item_id").alias("at")).join(up, "at").select("item_id", "above").distinct()
    found = level.withColumn("hop", F.lit(1))
    for hop in range(2, hops + 1):
        level = level.withColumnRenamed("above", "at").join(up, "at").select("item_id", "above").distinct()
        found = found.unionByName(level.withColumn("hop", F.lit(hop)))
    return found.groupBy("item_id", "above").agg(F.min("hop").alias("hop"))


def person_class(corpus: Corpus, core: DataFrame, hops: int = 5) -> DataFrame:
    """(item_id, kind): "cluster" for members of a project or section and for persons with an affiliation that reaches an item of ``core`` (item_id), else "partner"."""
    people = corpus.of_class(C.PERSON)
    reach = reachable(corpus, people, hops).join(core.select(F.col("item_id").alias("above")), "above", "left_semi").select("item_id")
    homes = corpus.of_class(C.PROJECT, C.GROUP).withColumnRenamed("item_id", "src")
    members = corpus.links.where(F.col("term") == C.MEMBER).join(homes, "src", "left_semi").select(F.col("dst").alias("item_id"))
    inside = reach.unionByName(members).distinct().withColumn("kind", F.lit("cluster"))
    return people.join(inside, "item_id", "left").fillna({"kind": "partner"})


def contributors(corpus: Corpus) -> DataFrame:
    """(src, name, author, editor, person): names on a record, linked and literal ones merged by spelling; ``person`` is null where it is literal only."""
    links, _ = corpus.scoped()
    linked = of_class(corpus, links.where(C.is_credit(F.col("term"))), C.PERSON).join(corpus.titles(), "dst")
    is_editor = F.col("term") == C.EDITORS
    rows = linked.select("src", F.trim("title").alias("name"), is_editor.alias("editor"), F.col("dst").alias("person"))
    literal = corpus.literals.where(F.col("term").isin(C.AUTHORS, C.EDITORS)).join(corpus.records, "item_id", "left_semi")
    literal = literal.select(F.col("item_id").alias("src"), F.trim("value").alias("name"), is_editor.alias("editor"), F.lit(None).cast("long").alias("person"))
    return rows.unionByName(literal).where("name != ''").groupBy("src", "name").agg(
        F.max(~F.col("editor")).alias("author"), F.max("editor").alias("editor"), F.max("person").alias("person")
    )


def coauthor_pairs(corpus: Corpus, min_count: int = 1) -> DataFrame:
    """(a, b, n, coauthor, coeditor, mixed, relation) between names; ``relation`` is the one with the most records, ties go by name."""
    masks = cut(contributors(corpus).select("src", "name", "author", "editor"))
    a = masks.select("src", *[F.col(c).alias(f"{c}_a") for c in ("name", "author", "editor")])
    b = masks.select("src", *[F.col(c).alias(f"{c}_b") for c in ("name", "author", "editor")])
    n = tasks(a, b, ["src"])
    both = meet(a, b, ["src"], n).where("name_a < name_b")
    relation = F.when(F.col("author_a") & F.col("author_b"), "coauthor").when(F.col("editor_a") & F.col("editor_b"), "coeditor").otherwise("mixed")
    kinds = ("coauthor", "coeditor", "mixed")
    both = both.select(F.col("name_a").alias("a"), F.col("name_b").alias("b"), F.lit(1).alias("n"), *[(relation == k).cast("int").alias(k) for k in kinds])
    counts = summed(both, ["a", "b"], ["n", *kinds], n).where(F.col("n") >= min_count)
    best = F.greatest(*kinds)
    return counts.withColumn("relation", F.when(F.col("coauthor") == best, "coauthor").when(F.col("coeditor") == best, "coeditor").otherwise("mixed"))


#: Node types of the entity network in order of precedence.
ENTITY_TYPES = ("Person", "Organisation", "Location", "Subject", "Tag")


def entity_rows(corpus: Corpus, tags: DataFrame | None = None) -> DataFrame:
    """(src, dst, type): typed entities of a record; people bring their organisations along. ``type`` is the lowest index an entity has anywhere."""
    links, _ = corpus.scoped()
    term = F.col("term")
    persons, _ = person_rows(corpus)
    org = of_class(corpus, links.where(C.is_institution_credit(term)), C.ORGANISATION).select("src", "dst")
    through = persons.join(affiliations(corpus), F.col("dst") == F.col("person")).select("src", F.col("institution").alias("dst"))
    places = of_class(corpus, links.where(term.isin(C.SPATIAL, C.PROVENANCE)), C.LOCATION).select("src", "dst")
    subjects = links.where(term == C.SUBJECT).select("src", "dst")
    typed = [persons.select("src", "dst").withColumn("type", F.lit(0)), org.unionByName(through).withColumn("type", F.lit(1)), places.withColumn("type", F.lit(2))]
    if tags is None:
        typed.append(subjects.withColumn("type", F.lit(3)))
    else:
        is_tag = tags.select(F.col("item_id").alias("dst"), F.lit(4).alias("tag"))
        typed.append(subjects.join(is_tag, "dst", "left").select("src", "dst", F.coalesce("tag", F.lit(3)).alias("type")))
    rows = typed[0]
    for df in typed[1:]:
        rows = rows.unionByName(df)
    lowest = rows.groupBy("dst").agg(F.min("type").alias("type"))
    return rows.select("src", "dst").distinct().join(lowest, "dst")


def entity_edges(corpus: Corpus, min_count: int = 2) -> DataFrame:
    """(a, b, n) between entities that share records."""
    return pairs(entity_rows(corpus), [], min_count)


def entity_hubs(corpus: Corpus, min_count: int = 2, cap: int | None = 4000, made: tuple[DataFrame, DataFrame] | None = None) -> DataFrame:
    """(item_id, type, items, degree, score, rank): degree x 3 + items, the ``cap`` best or all; ``made`` are entity_rows() and their pairs() if they are at hand."""
    rows, edges = made or (None, None)
    if rows is None:
        rows = cut(entity_rows(corpus))
        edges = pairs(rows, [], min_count)
    ends = edges.select(F.col("a").alias("dst")).unionByName(edges.select(F.col("b").alias("dst")))
    degree = ends.groupBy("dst").agg(F.count(F.lit(1)).alias("degree"))
    items = rows.groupBy("dst", "type").agg(F.count(F.lit(1)).alias("items"))
    hubs = items.join(degree, "dst").withColumn("score", F.col("degree") * 3 + F.col("items")).withColumnRenamed("dst", "item_id")
    return ranked(hubs, [], [F.desc("score"), F.col("item_id").asc()], cap) if cap else numbered(hubs, [-F.col("score"), F.col("item_id")])


def cluster_partners(corpus: Corpus, categories: DataFrame) -> DataFrame:
    """(item_id, category, lat, lon): geocoded items whose first isPartOf target is one of ``categories`` (item_id)."""
    first = corpus.links.where(F.col("term") == C.IS_PART_OF).groupBy(F.col("src").alias("item_id")).agg(F.min_by("dst", "ord").alias("category"))
    return first.join(categories.select(F.col("item_id").alias("category")), "category", "left_semi").join(corpus.geo, "item_id")


def coauthor_institutions(corpus: Corpus) -> tuple[DataFrame, DataFrame]:
    """Nodes (institution, people, publications, rank) and joint counts (a, b, n) of geocoded institutions; a joint publication needs two different people."""
    persons, _ = person_rows(corpus)
    placed = affiliations(corpus).join(corpus.geo.select(F.col("item_id").alias("institution")), "institution", "left_semi").distinct()
    rows = cut(persons.distinct().join(placed, F.col("dst") == F.col("person")).select("src", "person", "institution"))
    nodes = rows.groupBy("institution").agg(F.countDistinct("person").alias("people"), F.countDistinct("src").alias("publications"))
    nodes = ranked(nodes, [], [F.desc("people"), F.desc("publications"), F.col("institution").asc()])
    a = rows.select("src", F.col("person").alias("p"), F.col("institution").alias("a"))
    b = rows.select("src", F.col("person").alias("q"), F.col("institution").alias("b"))
    joint = meet(a, b, ["src"]).where("a < b and p != q").select("src", "a", "b").distinct()
    return nodes, joint.groupBy("a", "b").agg(F.count(F.lit(1)).alias("n"))


def summary(edges: DataFrame) -> DataFrame:
    """(nodes, links, total) of an edge table (a, b, n)."""
    ends = edges.select(F.explode(F.array("a", "b")).alias("x")).agg(F.countDistinct("x").alias("nodes"))
    return ends.join(edges.agg(F.count(F.lit(1)).alias("links"), F.coalesce(F.sum("n"), F.lit(0)).alias("total")))
