"""Places: hierarchies, countries, maps."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from folioscope.corpus import Corpus
from folioscope.functions import columns as C
from folioscope.operators.network import affiliations, of_class
from folioscope.operators.ranking import ranked
from folioscope.operators.temporal import stacked_timeline

#: Most outlines that one call takes: they go to every task.
MAX_OUTLINES = 20_000


def square_outlines(spark: SparkSession, size: int = 10) -> DataFrame:
    """(name, rings): a stand-in for country outlines, squares that tile the globe, named by their south-west corner."""
    rows = [
        (f"C{lat}_{lon}", [[[float(x), float(y)] for x, y in ((lon, lat), (lon + size, lat), (lon + size, lat + size), (lon, lat + size), (lon, lat))]])
        for lat in range(-90, 90, size)
        for lon in range(-180, 180, size)
    ]
    return spark.createDataFrame(rows, "name string, rings array<array<array<double>>>")


def read_outlines(spark: SparkSession, path: str) -> DataFrame:
    """(name, rings, aliases, k) of a GeoJSON file; the name is the first of four properties that is there, the aliases are all four, k is the place in the file."""
    point = "array<array<array<double>>>"
    schema = f"features array<struct<properties: map<string, string>, geometry: struct<type: string, coordinates: string>>>"
    f = spark.read.schema(schema).json(path, multiLine=True).select(F.posexplode("features").alias("k", "f"))
    names = [F.col("f.properties")[p] for p in ("ADMIN", "NAME", "NAME_EN", "NAME_LONG")]
    name = F.coalesce(*names)
    one = F.from_json("f.geometry.coordinates", point)
    many = F.flatten(F.from_json("f.geometry.coordinates", f"array<{point}>"))
    return f.select(name.alias("name"), F.when(F.col("f.geometry.type") == "Polygon", one).otherwise(many).alias("rings"), F.array_compact(F.array(*names)).alias("aliases"), "k")


@dataclass(frozen=True)
class _Outline:
    """The edges of an outline's rings, from (ax, ay) to (bx, by)."""

    name: str
    ax: np.ndarray
    ay: np.ndarray
    bx: np.ndarray
    by: np.ndarray

    @classmethod
    def of(cls, name: str, rings: list[list[list[float]]]) -> _Outline:
        shapes = [np.array(r, float) for r in rings]
        begin, end = (np.concatenate([r[part] for r in shapes]) for part in (slice(None, -1), slice(1, None)))
        return cls(name, begin[:, 0], begin[:, 1], end[:, 0], end[:, 1])

    def holds(self, x: np.ndarray, y: np.ndarray, at_once: int = 1 << 22) -> np.ndarray:
        """Even-odd over all rings, for arrays of points; so many points x edges at once."""
        inside = np.zeros(len(x), bool)
        step = max(1, at_once // max(1, len(self.ax)))
        for i in range(0, len(x), step):
            px, py = x[i : i + step, None], y[i : i + step, None]
            spans = (self.ay > py) != (self.by > py)
            with np.errstate(divide="ignore", invalid="ignore"):
                at = (self.bx - self.ax) * (py - self.ay) / (self.by - self.ay) + self.ax
            inside[i : i + step] = (spans & (px < at)).sum(axis=1) % 2 == 1
        return inside

    def cells(self, size: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(column, row, whole?) of the grid cells that may hold a point of it: those no edge comes near are whole or left out."""
        low = lambda *v: int(np.floor(min(x.min() for x in v) / size))
        high = lambda *v: int(np.floor(max(x.max() for x in v) / size))
        c0, r0, c1, r1 = low(self.ax, self.bx), low(self.ay, self.by), high(self.ax, self.bx), high(self.ay, self.by)
        border = np.zeros((c1 - c0 + 1, r1 - r0 + 1), bool)
        spans = [np.floor(f(a, b) / size).astype(int) - o for a, b, o in ((self.ax, self.bx, c0), (self.ay, self.by, r0)) for f in (np.minimum, np.maximum)]
        for left, right, bottom, top in zip(*spans):
            # An edge on a cell's own side touches the cell beside it too.
            border[max(0, left - 1) : right + 1, max(0, bottom - 1) : top + 1] = True
        col, row = (k.ravel() for k in np.meshgrid(np.arange(c0, c1 + 1), np.arange(r0, r1 + 1), indexing="ij"))
        near = border.ravel()
        whole = np.zeros(len(col), bool)
        whole[~near] = self.holds((col[~near] + 0.5) * size, (row[~near] + 0.5) * size)
        stay = near | whole
        return col[stay], row[stay], whole[stay]


def _held(outlines: list[_Outline]):
    """Rows (item_id, lat, lon, k) of points and outlines that may hold them; those that do stay."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lat, lon, k = (batch.column(i).to_numpy() for i in (1, 2, 3))
            inside = np.zeros(len(k), bool)
            for one in np.unique(k):
                rows = np.flatnonzero(k == one)
                inside[rows] = outlines[one].holds(lon[rows], lat[rows])
            yield batch.select(["item_id", "k"]).filter(pa.array(inside))

    return run


def country_index(points: DataFrame, outlines: DataFrame, size: float = 1.0) -> DataFrame:
    """(item_id, country): the first outline, in order of reading, that holds each point; points outside all are left out.

    A grid tells which outlines hold a cell wholly: its points are answered by
    an equi-join. Only points in cells that an edge comes near are tested against edges, as arrays, an outline at a time.
    """
    rows = outlines.limit(MAX_OUTLINES + 1).collect()
    if len(rows) > MAX_OUTLINES:
        raise ValueError(f"more than {MAX_OUTLINES} outlines; pass them in parts")
    shapes = [_Outline.of(r["name"], r["rings"]) for r in rows if r["rings"]]
    spark = points.sparkSession
    grid = [shape.cells(size) for shape in shapes]
    listed = [np.repeat(np.arange(len(grid)), [len(g[0]) for g in grid]), *(np.concatenate([g[i] for g in grid] or [np.empty(0, int)]) for i in range(3))]
    # As long as the outlines are wide, and sent as they are: a table of the driver's.
    cells = spark.createDataFrame(pa.table([pa.array(listed[0], pa.int32()), pa.array(listed[1], pa.int64()), pa.array(listed[2], pa.int64()), pa.array(listed[3].astype(bool))], ["k", "col", "row", "whole"]))
    names = spark.createDataFrame(pa.table([pa.array(range(len(shapes)), pa.int32()), pa.array([s.name for s in shapes], pa.string())], ["k", "country"]))
    placed = points.select("item_id", "lat", "lon").where("lat is not null and lon is not null")
    placed = placed.withColumns({"col": F.floor(F.col("lon") / size), "row": F.floor(F.col("lat") / size)}).join(cells, ["col", "row"])
    near = placed.where("not whole").select("item_id", "lat", "lon", "k").mapInArrow(_held(shapes), placed.select("item_id", "k").schema)
    first = placed.where("whole").select("item_id", "k").unionByName(near).groupBy("item_id").agg(F.min("k").alias("k"))
    return first.join(names, "k").select("item_id", "country")


def choropleth(corpus: Corpus, countries: DataFrame, members: DataFrame | None = None) -> DataFrame:
    """(country, n): each record once per country of its places."""
    links, keys = corpus.scoped(members)
    rows = links.where(F.col("term") == C.SPATIAL).join(countries, F.col("dst") == F.col("item_id"))
    return rows.select(*keys, "src", "country").distinct().groupBy(*keys, "country").agg(F.count(F.lit(1)).alias("n"))


def linked_places(corpus: Corpus, term: str, members: DataFrame | None = None) -> DataFrame:
    """(item_id, title, lat, lon, n): geocoded targets of a term."""
    links, keys = corpus.scoped(members)
    rows = links.where(F.col("term") == term).select(*keys, "src", "dst").distinct().groupBy(*keys, "dst").agg(F.count(F.lit(1)).alias("n"))
    return rows.withColumnRenamed("dst", "item_id").join(corpus.geo, "item_id").join(corpus.titles().withColumnRenamed("dst", "item_id"), "item_id")


def place_chain(corpus: Corpus) -> DataFrame:
    """(item_id, place, level): a place and all places above it, by each one's first isPartOf link to a place; a chain that comes back to a place ends.

    One recursive query, a round for each level that there is.
    """
    up = of_class(corpus, corpus.links.where(F.col("term") == C.IS_PART_OF), C.LOCATION)
    up = of_class(corpus, up, C.LOCATION, column="src").groupBy(F.col("src").alias("place")).agg(F.min_by("dst", "ord").alias("parent"))
    return corpus.items.sparkSession.sql(
        """
        WITH RECURSIVE chain(item_id, place, level, seen) MAX RECURSION LEVEL 1000 AS (
          SELECT item_id, item_id, 0, array(item_id) FROM {places}
          UNION ALL
          SELECT c.item_id, u.parent, c.level + 1, array_append(c.seen, u.parent) FROM chain c JOIN {up} u ON u.place = c.place WHERE NOT array_contains(c.seen, u.parent)
        ) SELECT item_id, place, level FROM chain
        """,
        places=corpus.of_class(C.LOCATION),
        up=up,
    )


def publication_places(corpus: Corpus) -> DataFrame:
    """(src, place, ord): where a record says it was published, and where the journals that it is part of come from."""
    links, _ = corpus.scoped()
    named = links.where(C.is_place_role(F.col("term"))).select("src", F.col("dst").alias("place"), "ord")
    journal = of_class(corpus, links.where(F.col("term") == C.IS_PART_OF), C.JOURNAL).select("src", F.col("dst").alias("journal"), "ord")
    origin = of_class(corpus, corpus.links.where(F.col("term") == C.SPATIAL), C.JOURNAL, column="src")
    return named.unionByName(journal.join(origin.select(F.col("src").alias("journal"), F.col("dst").alias("place")), "journal").drop("journal"))


def published_at(corpus: Corpus) -> DataFrame:
    """(entity, item_id): every place, at all levels above the places of publication, with the records published there."""
    rows = publication_places(corpus).join(place_chain(corpus).withColumnRenamed("place", "entity"), F.col("place") == F.col("item_id"))
    return rows.select("entity", F.col("src").alias("item_id")).distinct()


def publications_by_place(corpus: Corpus) -> DataFrame:
    """(item_id, title, n): records published at each place or below it."""
    counts = published_at(corpus).groupBy(F.col("entity").alias("dst")).agg(F.count(F.lit(1)).alias("n"))
    return counts.join(corpus.titles(), "dst").withColumnRenamed("dst", "item_id")


def published_timeline(corpus: Corpus) -> DataFrame:
    """(entity, year, name, n): types by year of what was published at each place or below it."""
    return stacked_timeline(corpus, published_at(corpus))


def outline_names(outlines: DataFrame) -> DataFrame:
    """(alias, outline) of rows (name, aliases, k): every lower-cased name that an outline answers to; of outlines that share one, the first has it."""
    rows = outlines.select("name", "k", F.explode("aliases").alias("alias")).where("alias != ''")
    return rows.groupBy(F.lower("alias").alias("alias")).agg(F.min_by("name", "k").alias("outline"))


def publication_countries(corpus: Corpus, publications: DataFrame, names: DataFrame) -> DataFrame:
    """(country, outline, n, lat, lon): publications, each once, by the top place above their places of publication.

    A top place goes by the outline that answers to its title in ``names``
    (alias, outline), not by the outline that holds its point, or else by
    its title. The point is the first one's, the country's or else the place's.
    """
    top = place_chain(corpus).groupBy("item_id").agg(F.max_by("place", "level").alias("top"))
    titles = corpus.titles().select(F.col("dst").alias("top"), F.trim("title").alias("title")).where("title != ''")
    named = top.join(titles, "top").join(names, F.lower("title") == F.col("alias"), "left").drop("alias")
    point = lambda on: corpus.geo.select(F.col("item_id").alias(on), F.struct("lat", "lon").alias(f"{on}_at"))
    named = named.join(point("top"), "top", "left").join(point("item_id"), "item_id", "left")
    named = named.select(F.col("item_id").alias("place"), F.coalesce("outline", "title").alias("country"), "outline", F.coalesce("top_at", "item_id_at").alias("at"))
    rows = publication_places(corpus).join(publications.select(F.col("item_id").alias("src")), "src", "left_semi").join(named, "place")
    counts = rows.groupBy("country", "outline").agg(F.countDistinct("src").alias("n"), F.min_by("at", F.struct("src", "ord")).alias("at"))
    return counts.select("country", "outline", "n", "at.lat", "at.lon")


def articles_by_country(mentions: DataFrame) -> DataFrame:
    """(decade, country, n) of rows (item_id, year, country, n): articles that write about each country, in each decade and, decade null, in all."""
    rows = mentions.select("item_id", "country", F.explode(F.array(C.decade(F.col("year")), F.lit(None).cast("int"))).alias("decade"))
    return rows.distinct().groupBy("decade", "country").agg(F.count(F.lit(1)).alias("n"))


def articles_about(mentions: DataFrame) -> DataFrame:
    """(country, item_id, n, rank): the articles that write about a country, by mentions, then year."""
    return ranked(mentions.select("country", "item_id", "year", "n"), ["country"], [F.desc("n"), F.coalesce("year", F.lit(0)).asc(), F.col("item_id").asc()]).drop("year")


def affiliation_map(corpus: Corpus) -> DataFrame:
    """(person, institution, lat, lon): geocoded organisations of each person."""
    rows = affiliations(corpus).join(corpus.geo, F.col("institution") == F.col("item_id"))
    return rows.select("person", "institution", "lat", "lon").distinct()


def project_affiliation_map(corpus: Corpus) -> DataFrame:
    """(project, institution, name, lat, lon, members): geocoded organisations of a project's own creators and members, with the different names of its people there in reading order.

    A team is a handful of people, so that its names are one row's array; people without a name place an institution, but aren't named.
    """
    projects = corpus.of_class(C.PROJECT).select(F.col("item_id").alias("src"))
    team = corpus.links.where(F.col("term").isin(C.CREATOR, C.MEMBER)).join(projects, "src", "left_semi")
    team = team.groupBy(F.col("src").alias("project"), F.col("dst").alias("person")).agg(F.min("ord").alias("at"))
    sites = corpus.of_class(C.ORGANISATION).join(corpus.geo, "item_id").join(corpus.titles().withColumnRenamed("dst", "item_id"), "item_id", "left")
    sites = sites.select(F.col("item_id").alias("institution"), F.col("title").alias("name"), "lat", "lon")
    work = corpus.links.where(F.col("term") == C.IS_PART_OF).select(F.col("src").alias("person"), F.col("dst").alias("institution")).distinct().join(sites, "institution")
    rows = team.join(work, "person").join(corpus.titles().withColumnRenamed("dst", "person"), "person", "left")
    named = F.array_sort(F.collect_list(F.struct("at", "person", "title")))
    names = F.array_distinct(F.array_compact(F.transform(named, lambda x: x["title"])))
    return rows.groupBy("project", "institution", "name", "lat", "lon").agg(names.alias("members"))


def spatial_places(corpus: Corpus) -> DataFrame:
    """(item_id, origins, currents, lat, lon): distinct records per geocoded place in either role; journals aren't records here."""
    links, _ = corpus.scoped()
    journals = corpus.of_class(C.JOURNAL).withColumnRenamed("item_id", "src")
    some = links.where(F.col("term").isin(C.SPATIAL, C.PROVENANCE)).join(journals, "src", "left_anti")
    rows = some.select("src", "dst", "term").distinct().groupBy(F.col("dst").alias("item_id")).agg(
        F.count_if(F.col("term") == C.SPATIAL).alias("origins"), F.count_if(F.col("term") == C.PROVENANCE).alias("currents")
    )
    return rows.join(corpus.geo, "item_id")


def spatial_countries(corpus: Corpus, countries: DataFrame) -> DataFrame:
    """(country, places, origins, currents, south, west, north, east, rank), densest first."""
    rows = spatial_places(corpus).join(countries, "item_id").groupBy("country").agg(
        F.count(F.lit(1)).alias("places"), F.sum("origins").alias("origins"), F.sum("currents").alias("currents"),
        F.min("lat").alias("south"), F.min("lon").alias("west"), F.max("lat").alias("north"), F.max("lon").alias("east"),
    )
    return ranked(rows, [], [F.desc(F.col("origins") + F.col("currents")), F.col("country").asc()])


def entity_places(corpus: Corpus, members: DataFrame) -> DataFrame:
    """(entity, place, origins, currents) over geocoded places."""
    links, keys = corpus.scoped(members)
    some = links.where(F.col("term").isin(C.SPATIAL, C.PROVENANCE)).join(corpus.geo, F.col("dst") == F.col("item_id"), "left_semi")
    return some.select(*keys, "src", "dst", "term").distinct().groupBy(*keys, F.col("dst").alias("place")).agg(
        F.count_if(F.col("term") == C.SPATIAL).alias("origins"), F.count_if(F.col("term") == C.PROVENANCE).alias("currents")
    )


def entity_picker(corpus: Corpus, members: DataFrame, cap: int = 400) -> DataFrame:
    """(entity, places, rank): entities with the most places."""
    counts = entity_places(corpus, members).groupBy("entity").agg(F.count(F.lit(1)).alias("places"))
    return ranked(counts, [], [F.desc("places"), F.col("entity").asc()], cap)


def item_map(corpus: Corpus) -> DataFrame:
    """(item_id, place, role): a record's geocoded places, each once; origin goes first."""
    links, _ = corpus.scoped()
    some = links.where(F.col("term").isin(C.SPATIAL, C.PROVENANCE)).join(corpus.geo, F.col("dst") == F.col("item_id"), "left_semi")
    role = F.when(F.col("term") == C.SPATIAL, "origin").otherwise("current")
    rank = F.when(F.col("term") == C.SPATIAL, 0).otherwise(1)
    return some.groupBy(F.col("src").alias("item_id"), F.col("dst").alias("place")).agg(F.min_by(role, rank).alias("role"))


def color_breaks(counts: DataFrame) -> DataFrame:
    """(step, value): five logarithmic breaks up to the largest ``n``, made strictly ascending."""
    top = counts.agg(F.max("n").alias("top"))
    raw = F.transform(F.sequence(F.lit(0), F.lit(4)), lambda i: F.round(F.exp(F.ln(F.col("top") + 1) * i / 4) - 1).cast("long"))
    step = lambda acc, x: F.array_append(acc, F.when(F.size(acc) == 0, x).otherwise(F.greatest(x, F.element_at(acc, -1) + 1)))
    breaks = F.aggregate(raw, F.array().cast("array<bigint>"), step)
    return top.select(F.posexplode(breaks).alias("step", "value"))


#: Names of a gazetteer that are broadcast; a list of more meets the words in a shuffle.
MOST_NAMES = 100_000


def mentions(texts: DataFrame, gazetteer: DataFrame, cut_out: str | None = None, min_mentions: int = 3) -> DataFrame:
    """(item_id, place, n): how often each place is named in rows (item_id, text), ``min_mentions`` or more.

    ``gazetteer`` (place, name, weight) has one or more names of a place, of
    one or more words. All names are found in one pass: every word that begins
    a name is joined to the names that begin with it. A name inside a longer
    one doesn't count, and a longer one of weight 0 takes what it covers away: a river named as a country is, say. What
    matches ``cut_out`` (addresses) is cut before. Case counts; words stand apart, with nothing but white space between a name's words.
    """
    names = gazetteer.select("place", F.coalesce("weight", F.lit(1)).cast("long").alias("weight"), F.filter(F.split(F.trim("name"), r"\s+"), lambda w: w != "").alias("of"))
    names = names.where(F.size("of") > 0).select("place", "weight", "of", F.col("of")[0].alias("word"))
    n, longest = names.agg(F.count(F.lit(1)), F.coalesce(F.max(F.size("of")), F.lit(1))).first()
    names = F.broadcast(names) if n <= MOST_NAMES else names  # else words are shuffled, each with as many after it as the longest name has
    text = F.coalesce("text", F.lit(""))
    text = F.regexp_replace(text, cut_out, " . ") if cut_out else text
    pieces = texts.select("item_id", F.posexplode(F.split(text, r"[^\p{L}\p{M}\p{N}'’\s-]+")).alias("piece", "s"))
    pieces = pieces.select("item_id", "piece", F.filter(F.split("s", r"\s+"), lambda w: w != "").alias("words"))
    # A word goes on with the words of a name's length, not with its whole piece, which may be a whole text.
    starts = F.transform("words", lambda w, k: F.struct(k.alias("at"), w.alias("word"), F.slice("words", k + 1, longest).alias("next")))
    begun = pieces.select("item_id", "piece", F.inline(starts)).join(names, "word")
    met = begun.where(F.slice("next", 1, F.size("of")) == F.col("of")).select("item_id", "piece", "place", "weight", "at", (F.col("at") + F.size("of")).alias("end"))
    # A piece is a clause or so: its matches are a short list.
    spans = F.collect_set(F.struct("at", "end")).over(Window.partitionBy("item_id", "piece"))
    longer = F.exists(spans, lambda o: (o["at"] <= F.col("at")) & (o["end"] >= F.col("end")) & (o["end"] - o["at"] > F.col("end") - F.col("at")))
    found = met.withColumn("covered", longer).where("not covered")
    return found.groupBy("item_id", "place").agg(F.sum("weight").alias("n")).where(F.col("n") >= min_mentions)
