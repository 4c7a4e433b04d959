"""What single items are shown with: context, credits, codes, featured collections, series."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioscope.corpus import Corpus
from folioscope.functions import columns as C
from folioscope.operators.ranking import ranked


def first_literals(literals: DataFrame, names: dict[str, str]) -> DataFrame:
    """(item_id, a column per entry of ``names`` {term: column}): an item's first value of each term, null without one."""
    rows = literals.where(F.col("term").isin(*names))
    firsts = [F.min_by("value", F.when(F.col("term") == term, F.col("ord"))).alias(name) for term, name in names.items()]
    return rows.groupBy("item_id").agg(*firsts)


def item_contexts(corpus: Corpus) -> DataFrame:
    """(item_id, year, parents, abstract) of every item: its projects in reading order and its first abstract, "" without one."""
    projects = corpus.items.where(F.col("class_term") == C.PROJECT).select(F.col("item_id").alias("dst"), "title")
    part_of = corpus.links.where(F.col("term") == C.IS_PART_OF).join(projects, "dst")
    listed = F.array_sort(F.collect_list(F.struct("ord", F.col("dst").alias("item_id"), "title")))
    parents = part_of.groupBy(F.col("src").alias("item_id")).agg(F.transform(listed, lambda p: F.struct(p["item_id"], p["title"])).alias("parents"))
    texts = first_literals(corpus.literals, {C.ABSTRACT: "a", "bibo:abstract": "b"})
    abstracts = texts.select("item_id", F.coalesce("a", "b", F.lit("")).alias("abstract"))
    rows = corpus.items.select("item_id", "year").join(parents, "item_id", "left").join(abstracts, "item_id", "left")
    none = F.array().cast("array<struct<item_id:bigint,title:string>>")
    return rows.select("item_id", "year", F.coalesce("parents", none).alias("parents"), F.coalesce("abstract", F.lit("")).alias("abstract"))


def first_creator(corpus: Corpus) -> DataFrame:
    """(item_id, creator): title of the first titled author, creator or contributor."""
    links = corpus.links.where(F.col("term").isin("marcrel:aut", C.CREATOR, C.CONTRIBUTOR))
    return links.join(corpus.titles(), "dst").groupBy(F.col("src").alias("item_id")).agg(F.min_by("title", "ord").alias("creator"))


def projects_by_code(codes: DataFrame) -> DataFrame:
    """(code, project): the project with the smallest id per code, of rows (item_id, code)."""
    named = codes.select("item_id", F.trim("code").alias("code")).where("code != ''")
    return named.groupBy("code").agg(F.min("item_id").alias("project"))


def featured(corpus: Corpus, prefix: str | None = None, producer: int | None = None, producer_term: str = "marcrel:prn") -> DataFrame:
    """(item_id) of a featured collection: an identifier that starts with ``prefix`` and a link to ``producer``, whichever are given."""
    rows = corpus.records
    if prefix:
        named = corpus.literals.where((F.col("term") == "dcterms:identifier") & F.col("value").startswith(prefix))
        rows = rows.join(named, "item_id", "left_semi")
    if producer is not None:
        made = corpus.links.where((F.col("term") == producer_term) & (F.col("dst") == producer)).select(F.col("src").alias("item_id"))
        rows = rows.join(made, "item_id", "left_semi")
    return rows


def series(corpus: Corpus, members: DataFrame) -> DataFrame:
    """(item_id, title, n, rank): what the members (item_id) are parts of, by statements."""
    links = corpus.links.where(F.col("term") == C.IS_PART_OF).join(members.select(F.col("item_id").alias("src")), "src", "left_semi")
    counts = links.groupBy("dst").agg(F.count(F.lit(1)).alias("n")).join(corpus.titles(), "dst").withColumnRenamed("dst", "item_id")
    return ranked(counts, [], [F.desc("n"), F.col("title").asc(), F.col("item_id").asc()])


def playlists(corpus: Corpus, lists: DataFrame, members: DataFrame) -> DataFrame:
    """``series`` of the titled playlists (item_id) only; each has a member at least."""
    kept = series(corpus, members).join(lists.select("item_id"), "item_id", "left_semi").drop("rank")
    return ranked(kept, [], [F.desc("n"), F.col("title").asc(), F.col("item_id").asc()])


def subjects_and_tags(corpus: Corpus, marker: Column) -> DataFrame:
    """(item_id, kind): targets of dcterms:subject, "heading" if a dcterms:type link of theirs has a target that meets ``marker`` (on dst), else "tag"."""
    targets = corpus.links.where(F.col("term") == C.SUBJECT).select(F.col("dst").alias("item_id")).distinct()
    marked = corpus.links.where((F.col("term") == C.TYPE) & marker).select(F.col("src").alias("item_id"), F.lit("heading").alias("kind")).distinct()
    return targets.join(marked, "item_id", "left").fillna({"kind": "tag"})


def with_types(corpus: Corpus, synthetic: DataFrame) -> Corpus:
    """The corpus in which the items of ``synthetic`` (item_id, title) have that one type instead of their own.

    Made-up types get negative ids, as no item stands behind them.
    """
    made = synthetic.select("item_id", "title", (-F.xxhash64("title").bitwiseAND(F.lit((1 << 62) - 1)) - 1).alias("type_id"))
    own = (F.col("term") == C.TYPE) & F.col("_made").isNotNull()
    ids = made.select(F.col("item_id").alias("src"), F.lit(True).alias("_made"))
    kept = corpus.links.join(ids, "src", "left").where(~own).drop("_made")
    stated = made.select(F.col("item_id").alias("src"), F.lit(C.TYPE).alias("term"), F.col("type_id").alias("dst"), F.lit(0).cast("long").alias("ord"))
    types = made.select(F.col("type_id").alias("item_id"), "title").distinct()
    items = corpus.items.unionByName(types, allowMissingColumns=True)
    return replace(corpus, items=items, links=kept.unionByName(stated.select(*kept.columns)))
