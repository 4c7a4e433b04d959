"""A star schema (orders and their dimensions) as a corpus: orders are the records, dimensions the entities."""

from __future__ import annotations

from dataclasses import replace
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from folioscope.corpus import Corpus
from folioscope.functions import columns as C

#: First id of each kind of item.
SECTION, PROJECT, PLACE, REGION, INSTITUTE = 100_000_000, 200_000_000, 300_000_000, 350_000_000, 400_000_000
PERSON, SUBJECT, TYPE, LANGUAGE, GENRE, JOURNAL, RECORD = 500_000_000, 600_000_000, 700_000_000, 800_000_000, 900_000_000, 950_000_000, 1_000_000_000
#: ``ord`` of a statement is its line times this, plus its target.
LINE = 10_000_000_000
PUBLICATIONS, PODCASTS, VIDEOS = 1, 2, 3
ROLES = {"A": C.CREATOR, "N": C.CONTRIBUTOR, "R": "marcrel:aut"}
SETS = {"F": PUBLICATIONS, "O": PODCASTS, "P": VIDEOS}
#: Lines of an order table that one task joins and gathers, about, where Spark's own number of tasks would give it more.
DEALT = 1 << 18
#: Rows of a dimension up to which a join with it is left to Spark, which broadcasts so few.
FEW = 100_000


def _named(df: DataFrame, column: str, first: int) -> DataFrame:
    """(name, id) of a dimension's distinct values; a handful of rows."""
    return df.select(F.col(column).alias("name")).distinct().select(
        "name", (F.lit(first) + F.dense_rank().over(Window.orderBy("name"))).cast("long").alias("id")
    )


def _items(df: DataFrame, item_id: Column, title: Column, template: int | None, class_term: str | None, day: Column | None = None) -> DataFrame:
    created = day if day is not None else F.lit(None).cast("date")
    return df.select(
        item_id.cast("long").alias("item_id"),
        title.alias("title"),
        F.lit(template).cast("int").alias("template_id"),
        F.lit(class_term).cast("string").alias("class_term"),
        created.alias("created"),
        F.year(created).alias("year"),
    )


def _raw(df: DataFrame, src: Column, term: Column | str, dst: Column, line: Column | int) -> DataFrame:
    as_col = lambda x: x if isinstance(x, Column) else F.lit(x)
    return df.select(
        src.cast("long").alias("src"), as_col(term).alias("term"), dst.cast("long").alias("dst"), as_col(line).cast("long").alias("line")
    )


def _said(term: Column | str, dst: Column, line: Column | int) -> Column:
    """One statement of a row, as a struct."""
    as_col = lambda x: x if isinstance(x, Column) else F.lit(x)
    return F.struct(as_col(term).alias("term"), dst.cast("long").alias("dst"), as_col(line).cast("long").alias("line"))


def _each(df: DataFrame, statements: list[Column]) -> DataFrame:
    """(src, term, dst, line): all ``statements`` of each row that aren't null. The rows are read once for all of them."""
    return df.select("src", F.explode(F.array(*statements)).alias("x")).where("x is not null").select("src", "x.*")


def dealt(df: DataFrame, key: str, lines: int) -> DataFrame:
    """``df`` by ``key`` in tasks that go by the number of lines; left to Spark while its shuffle partitions are enough."""
    n = -(-lines // DEALT)
    return df.repartition(n, key) if n > int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")) else df


def met(lines: DataFrame, on: str, dimension: DataFrame, key: str, rows: int, n: int) -> DataFrame:
    """``lines`` joined to a dimension of ``rows`` rows; where that is too large to broadcast, both sides go to tasks by the ``n`` lines."""
    both = [lines, dimension] if rows <= FEW else [dealt(lines, on, n), dealt(dimension, key, n)]
    return both[0].join(both[1], F.col(on) == F.col(key))


def teams(corpus: Corpus, spark: SparkSession, sf_dir: str) -> Corpus:
    """``corpus`` with statements on projects about their own people: a supplier in five leads one, in four is in the team of another."""
    key = F.col("s_suppkey")
    people = spark.read.parquet(f"{sf_dir}/supplier.parquet").select(key)
    led = _raw(people.where(key % 5 == 0), key % 25 + PROJECT, C.CREATOR, key + PERSON, 0)
    staffed = _raw(people.where(key % 4 == 0), (key * 3) % 25 + PROJECT, C.MEMBER, key + PERSON, 1)
    own = led.unionByName(staffed).select("src", "term", "dst", (F.col("line") * LINE + F.col("dst")).alias("ord"))
    return replace(corpus, links=corpus.links.unionByName(own))


def load(spark: SparkSession, sf_dir: str) -> Corpus:
    t = {n: spark.read.parquet(f"{sf_dir}/{n}.parquet") for n in ("region", "nation", "supplier", "customer", "part", "orders", "lineitem")}
    c = F.col
    subjects, types = _named(t["part"], "p_brand", SUBJECT), _named(t["part"], "p_type", TYPE)
    languages, genres = _named(t["customer"], "c_mktsegment", LANGUAGE), _named(t["orders"], "o_orderpriority", GENRE)
    size, few = t["lineitem"].count(), {n: t[n].count() for n in ("customer", "part", "supplier")}
    orders = (
        met(t["orders"], "o_custkey", t["customer"].select("c_custkey", "c_nationkey", "c_mktsegment"), "c_custkey", few["customer"], size)
        .join(languages.select(c("name").alias("c_mktsegment"), c("id").alias("language")), "c_mktsegment")
        .join(genres.select(c("name").alias("o_orderpriority"), c("id").alias("genre")), "o_orderpriority")
    )
    parts = (
        t["part"]
        .select("p_partkey", "p_brand", "p_type")
        .join(subjects.select(c("name").alias("p_brand"), c("id").alias("subject")), "p_brand")
        .join(types.select(c("name").alias("p_type"), c("id").alias("type")), "p_type")
    )
    nation, region, line = t["nation"], t["region"], c("l_linenumber")
    # Orders come last: lines that lie by their record are gathered where they lie.
    lines = t["lineitem"].select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_returnflag", "l_linestatus")
    lines = met(lines, "l_partkey", parts.select("p_partkey", "subject", "type"), "p_partkey", few["part"], size)
    lines = met(lines, "l_suppkey", t["supplier"].select("s_suppkey", "s_name", "s_nationkey"), "s_suppkey", few["supplier"], size)
    status = t["orders"].select((c("o_orderkey") + RECORD).cast("long").alias("src"), "o_orderstatus")
    lines = lines.withColumn("src", (c("l_orderkey") + RECORD).cast("long")).drop("l_orderkey", "l_partkey", "p_partkey", "s_suppkey")
    lines = dealt(lines, "src", size).join(dealt(status, "src", size), "src")
    literal = (c("o_orderstatus") == "F") & (c("l_linestatus") == "O")
    role = reduce(lambda w, kv: w.when(c("l_returnflag") == kv[0], kv[1]), ROLES.items(), F)
    order = (c("o_orderkey") + RECORD).cast("long")
    by_order = [
        _said(C.IS_PART_OF, c("c_nationkey") + PROJECT, 0),
        _said(C.LANGUAGE, c("language"), 0),
        _said(C.FORMAT, c("genre"), 0),
        _said(C.SPATIAL, c("c_nationkey") + PLACE, 0),
        F.when((c("o_orderstatus") == "F") & (c("o_orderkey") % 3 == 0), _said(C.IS_PART_OF, c("c_nationkey") + JOURNAL, 1)),
        F.when((c("o_orderstatus") == "F") & (c("o_orderkey") % 3 == 1), _said("marcrel:pup", c("o_custkey") % 25 + PLACE, 0)),
    ]
    by_line = [
        _said(C.SUBJECT, c("subject"), line),
        _said(C.TYPE, c("type"), line),
        _said(C.PROVENANCE, c("s_nationkey") + PLACE, line),
        F.when(~literal, _said(role, c("l_suppkey") + PERSON, line)),
    ]
    raw = [
        _raw(nation, c("n_nationkey") + PROJECT, C.IS_PART_OF, c("n_regionkey") + SECTION, 0),
        _raw(nation, c("n_nationkey") + PLACE, C.IS_PART_OF, c("n_regionkey") + REGION, 0),
        _raw(nation, c("n_nationkey") + JOURNAL, C.SPATIAL, c("n_nationkey") + PLACE, 0),
        _raw(nation, c("n_nationkey") + PROJECT, C.FUNDER, (c("n_nationkey") + 7) % 25 + INSTITUTE, 0),
        _raw(t["supplier"], c("s_suppkey") + PERSON, C.IS_PART_OF, c("s_nationkey") + INSTITUTE, 0),
    ]
    # No two of the three say the same of the same record, so each is made one apart.
    said = [_each(dealt(orders.withColumn("src", order), "src", size), by_order), _each(lines, by_line), reduce(DataFrame.unionAll, raw)]
    links = reduce(DataFrame.unionAll, [x.groupBy("src", "term", "dst").agg((F.min("line") * LINE + c("dst")).alias("ord")) for x in said])
    named = lambda df, first: _items(df, c("id"), c("name"), first, None)
    items = [
        _items(region, c("r_regionkey") + SECTION, c("r_name"), 7, C.GROUP),
        _items(nation, c("n_nationkey") + PROJECT, F.concat(F.lit("Project "), "n_name"), 5, C.PROJECT),
        _items(nation, c("n_nationkey") + PLACE, c("n_name"), 3, C.LOCATION),
        _items(region, c("r_regionkey") + REGION, c("r_name"), 3, C.LOCATION),
        _items(nation, c("n_nationkey") + INSTITUTE, F.concat(F.lit("Institute "), "n_name"), 2, C.ORGANISATION),
        _items(nation, c("n_nationkey") + JOURNAL, F.concat(F.lit("Journal "), "n_name"), 8, C.JOURNAL),
        _items(t["supplier"], c("s_suppkey") + PERSON, c("s_name"), 4, C.PERSON),
        named(subjects, 6), named(types, None), named(languages, None), named(genres, None),
        _items(t["orders"], order, F.concat(F.lit("Order "), c("o_orderkey").cast("string")), 10, None, c("o_orderdate").cast("date")),
    ]
    literals = (
        lines.where(literal)
        .groupBy(c("src").alias("item_id"), c("s_name").alias("value"))
        .agg(F.min("l_linenumber").cast("long").alias("ord"))
        .select("item_id", F.lit(C.AUTHORS).alias("term"), "value", "ord")
    )
    member = reduce(lambda w, kv: w.when(c("o_orderstatus") == kv[0], kv[1]), SETS.items(), F)
    memberships = t["orders"].select(member.cast("long").alias("set_id"), order.cast("long").alias("item_id")).where("set_id is not null")
    lat = ((c("n_nationkey") * 37) % 130 - 60).cast("double").alias("lat")
    lon = ((c("n_nationkey") * 53) % 340 - 170).cast("double").alias("lon")
    geo = nation.select((c("n_nationkey") + PLACE).cast("long").alias("item_id"), lat, lon).unionAll(
        nation.select((c("n_nationkey") + INSTITUTE).cast("long").alias("item_id"), lat, lon)
    )
    start = 1990 + c("n_nationkey") % 10
    temporal = nation.select(
        (c("n_nationkey") + PROJECT).cast("long").alias("item_id"),
        start.cast("string").alias("start"),
        (start + 3).cast("string").alias("end"),
    )
    return Corpus(
        reduce(DataFrame.unionAll, items), links, literals, memberships, geo, temporal, t["orders"].select(order.cast("long").alias("item_id"))
    )
