"""Answers over time."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from folioscope.corpus import Corpus
from folioscope.functions import columns as C
from folioscope.operators.dist import children, everything
from folioscope.operators.network import chord
from folioscope.operators.ranking import ranked


def years_of(corpus: Corpus, members: DataFrame | None) -> tuple[DataFrame, list[str]]:
    items, keys = corpus.scoped_items(members)
    return items.where("year is not null and year != 0").select(*keys, F.col("item_id").alias("src"), "year"), keys


def by_year(corpus: Corpus, term: str, members: DataFrame | None = None, missing: str | None = None) -> tuple[DataFrame, list[str]]:
    """(year, name, n) of titled targets of a term, undated records left out."""
    years, keys = years_of(corpus, members)
    links, _ = corpus.scoped(members)
    on = [*keys, "src"]
    links = links.where(F.col("term") == term).join(corpus.titles(), "dst").select(*on, F.col("title").alias("name"))
    rows = years.join(links, on, "left" if missing else "inner")
    if missing:
        rows = rows.fillna({"name": missing})
    return rows.groupBy(*keys, "year", "name").agg(F.count(F.lit(1)).alias("n")), keys


def stacked_timeline(corpus: Corpus, members: DataFrame | None = None) -> DataFrame:
    """(year, name, n): types by year; records without one are "No type"."""
    return by_year(corpus, C.TYPE, members, "No type")[0]


def _several_years(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Nothing with fewer than two years."""
    span = everything(keys)
    return rows.withColumns({"_a": F.min("year").over(span), "_b": F.max("year").over(span)}).where("_a < _b").drop("_a", "_b")


def subject_trends(corpus: Corpus, members: DataFrame | None = None, top: int = 10) -> DataFrame:
    """(year, name, n) dense over the years in which any of the top subjects is found."""
    rows, keys = by_year(corpus, C.SUBJECT, members)
    total = rows.groupBy(*keys, "name").agg(F.sum("n").alias("total"))
    best = ranked(total, keys, [F.desc("total"), C.natural_key(F.col("name")).asc(), F.col("name").asc()], top).select(*keys, "name")
    rows = rows.join(best, [*keys, "name"], "left_semi")
    return dense(_several_years(rows, keys), keys)


def dense(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Every year of a key with every name of it, n = 0 where there was none."""
    years, names = rows.select(*keys, "year").distinct(), rows.select(*keys, "name").distinct()
    grid = years.join(names, keys) if keys else years.crossJoin(names)  # years x at most ten names
    return grid.join(rows, [*keys, "year", "name"], "left").fillna({"n": 0})


def language_timeline(corpus: Corpus, members: DataFrame | None = None) -> DataFrame:
    rows, keys = by_year(corpus, C.LANGUAGE, members)
    return _several_years(rows, keys)


def beeswarm(corpus: Corpus) -> DataFrame:
    """(item_id, title, year, size): projects at the first year of their interval, as large as they have children, 1 at least."""
    size = children(corpus, [C.PROJECT]).groupBy(F.col("parent").alias("item_id")).agg(F.countDistinct("item_id").alias("n"))
    projects = corpus.items.where(F.col("class_term") == C.PROJECT).join(corpus.temporal, "item_id").join(size, "item_id", "left")
    year = C.first_year(F.col("start")).cast("int")
    return projects.select("item_id", "title", year.alias("start_year"), F.greatest(F.coalesce("n", F.lit(0)), F.lit(1)).cast("long").alias("size")).where("start_year is not null")


def gantt(corpus: Corpus) -> DataFrame:
    """(rank, item_id, title, start, end) by start, name, id."""
    rows = corpus.items.where(F.col("class_term") == C.PROJECT).join(corpus.temporal, "item_id").select("item_id", "title", "start", "end")
    return ranked(rows, [], [F.col("start").asc(), C.natural_key(F.col("title")).asc(), F.col("item_id").asc()])


def time_chord(corpus: Corpus, max_nodes: int = 16) -> DataFrame:
    """Subject co-occurrence once per year, nothing with fewer than two such years."""
    years, _ = years_of(corpus, None)
    members = years.select(F.col("year").cast("long").alias("entity"), F.col("src").alias("item_id"))
    links = chord(corpus, C.SUBJECT, members, max_nodes).withColumnRenamed("entity", "year")
    return _several_years(links, []).withColumn("year", F.col("year").cast("int"))


def whats_new(corpus: Corpus, months: tuple[int, ...] = (3, 6, 12)) -> DataFrame:
    """(months, item_id, created): records made since each cutoff, counted back from the newest one."""
    newest = corpus.items.agg(F.max("created").alias("newest"))
    cut = F.explode(F.array(*[F.struct(F.lit(m).alias("months"), C.minus_months(F.col("newest"), m).alias("cutoff")) for m in months])).alias("w")
    windows = newest.select(cut).select("w.months", "w.cutoff")  # three rows
    rows = corpus.items.where("created is not null").join(F.broadcast(windows), F.col("created") >= F.col("cutoff"))
    return rows.select("months", "item_id", "title", "created")


def whats_new_counts(corpus: Corpus) -> DataFrame:
    return whats_new(corpus).groupBy("months").agg(F.count(F.lit(1)).alias("n"))


def whats_new_items(corpus: Corpus, top: int = 24) -> DataFrame:
    """The newest first, those of one day by id."""
    return ranked(whats_new(corpus), ["months"], [F.desc("created"), F.col("item_id").asc()], top)


def whats_new_projects(corpus: Corpus, top: int = 10) -> DataFrame:
    """(months, item_id, title, n, rank): new records under their first parent project (the lowest id); of equal counts the lower id goes first."""
    parent = children(corpus, [C.PROJECT]).groupBy("item_id").agg(F.min("parent").alias("parent"))
    counts = whats_new(corpus).join(parent, "item_id").groupBy("months", F.col("parent").alias("item_id")).agg(F.count(F.lit(1)).alias("n"))
    best = ranked(counts, ["months"], [F.desc("n"), F.col("item_id").asc()], top)
    named = best.join(corpus.titles().withColumnRenamed("dst", "item_id"), "item_id", "left")
    return named.withColumn("title", F.coalesce("title", F.concat(F.lit("Project "), F.col("item_id").cast("string"))))


def sibling_sparkline(corpus: Corpus) -> DataFrame:
    """(item_id, project, year, n, here): each record's first parent project with several years, that project's years, the record's own marked."""
    kids = children(corpus, [C.PROJECT])
    years, _ = years_of(corpus, None)
    line = kids.join(years.withColumnRenamed("src", "item_id"), "item_id").groupBy("parent", "year").agg(F.count(F.lit(1)).alias("n"))
    several = line.groupBy("parent").agg(F.count(F.lit(1)).alias("years")).where("years > 1").select("parent")
    first = kids.join(several, "parent").groupBy("item_id").agg(F.min_by("parent", "ord").alias("parent"))
    own = years.select(F.col("src").alias("item_id"), F.col("year").alias("own"))
    rows = first.join(own, "item_id", "left").join(line, "parent")
    return rows.select("item_id", F.col("parent").alias("project"), "year", "n", F.coalesce(F.col("year") == F.col("own"), F.lit(False)).alias("here"))


def decade_groups(rows: DataFrame) -> DataFrame:
    """(decade, label, n, share) of rows (year, label): a null label is ungrouped, counted in the share's denominator and not shown."""
    counts = rows.where("year is not null").groupBy(C.decade(F.col("year")).alias("decade"), "label").agg(F.count(F.lit(1)).alias("n"))
    total = F.sum("n").over(Window.partitionBy("decade"))
    return counts.withColumn("share", F.round(F.col("n") / total, 6)).where("label is not null")


def smoothed_rates(hits: DataFrame, totals: DataFrame, reach: int = 2, per: float = 10_000.0) -> DataFrame:
    """(word, year, rate, smooth) from hits (word, year, n) and totals (year, total): rates per 10,000, and ratios of sums over the years within ``reach``."""
    words = hits.select("word").distinct()
    grid = words.join(F.broadcast(totals.select("year", "total")))  # words x years of the collection
    rows = grid.join(hits, ["word", "year"], "left").fillna({"n": 0})
    near = Window.partitionBy("word").orderBy("year").rangeBetween(-reach, reach)
    return rows.select(
        "word",
        "year",
        F.round(F.col("n") / F.col("total") * per, 6).alias("rate"),
        F.round(F.sum("n").over(near) / F.sum("total").over(near) * per, 6).alias("smooth"),
    )
