"""Mixing sources to target weights by Sainte-Laguë apportionment of equal-token blocks.

1. Targets: sources in code point order (null last) weigh 1, 2, 3, repeating,
   and share all words; a target stops at ``max_repeats`` times its source,
   the excess is shared by weight among the others until none is above.
2. Blocks of ``block_words`` words are given to sources by highest quotients
   target / (2k - 1), then each source's blocks to its shards in the same way,
   by shard size. A shard is a hash class of about ``shard_docs`` documents
   of one source, so one source may have any share of all rows.
3. A shard's documents, in seeded order, are a circle of words. It gives its
   quota as that many blocks in a row from a seeded start, going round as often as
   the quota asks; quotas stop at ``max_repeats`` times round.

The B highest quotients are found without ranking all of them: with V the sum
of n votes, every seat with a quotient of at least V / (2B - n) is among them and
none below V / (2B + n) is, so that at most about 2n quotients between are ranked.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folioscope.llm.common import stored, text_of, unused

WORD = r"[^\x20\x09-\x0D]+"
#: Rows of a table that meets documents by source are laid out so many times: no task gets more than this share of a source.
SALTS = 32


def _source_key(source: Column) -> Column:
    """Never null, and ordered as the sources are, null last."""
    return F.when(source.isNull(), F.lit("1")).otherwise(F.concat(F.lit("0"), source))


def numbered(rows: DataFrame, order: list[str], sums: tuple[str, ...] = ()) -> DataFrame:
    """Adds ``nth`` (from 0) and, for each of ``sums``, ``before_<column>``, over all rows in total ``order``, without one task for all.

    Rows are dealt by ranges and written; what a range adds to those after it
    is one row, so that the only window without a key runs over the ranges.
    """
    dealt = rows.repartitionByRange(*order).withColumn("part", F.spark_partition_id())
    dealt = stored(dealt, "ranges")
    per = dealt.groupBy("part").agg(F.count(F.lit(1)).alias("rows_"), *[F.sum(c).alias(f"sum_{c}") for c in sums])
    ahead = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    first = per.select(
        "part", F.coalesce(F.sum("rows_").over(ahead), F.lit(0)).alias("first_nth"), *[F.coalesce(F.sum(f"sum_{c}").over(ahead), F.lit(0)).alias(f"first_{c}") for c in sums]
    )
    within = Window.partitionBy("part").orderBy(*order)
    upto = within.rowsBetween(Window.unboundedPreceding, -1)
    out = dealt.withColumn("nth", F.row_number().over(within) - 1).withColumns({f"before_{c}": F.coalesce(F.sum(c).over(upto), F.lit(0)) for c in sums})
    out = out.join(first, "part")
    out = out.withColumns({"nth": F.col("nth") + F.col("first_nth")} | {f"before_{c}": F.col(f"before_{c}") + F.col(f"first_{c}") for c in sums})
    return out.drop("part", "first_nth", *[f"first_{c}" for c in sums])


def targets(sources: DataFrame, max_repeats: int = 3, weights: tuple[int, ...] = (1, 2, 3)) -> DataFrame:
    """Adds ``target`` to one row per source (skey, source_size).

    Water-filling in closed form: sources reach their cap in the order of
    cap / weight. With the first k of them at their caps the others get
    weight x (total - caps so far) / (weight of the rest); source k + 1 is
    above its cap exactly if that is more than its own cap / weight. The
    driver gets three sums; sources may be any number.
    """
    index = F.pmod(F.col("nth"), F.lit(len(weights))) + 1
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), index.cast("int"))
    rows = numbered(sources, ["skey"]).withColumn("w", weight).withColumn("cap", (F.col("source_size") * max_repeats).cast("double"))
    rows = rows.drop("nth").withColumn("ratio", F.col("cap") / F.col("w"))
    total, heaviness = rows.agg(F.sum("source_size"), F.sum("w")).first()
    rows = numbered(rows, ["ratio", "skey"], ("cap", "w")).drop("nth")
    rows = rows.withColumn("rate", (F.lit(float(total or 0)) - F.col("before_cap")) / (F.lit(heaviness or 0.0) - F.col("before_w")))
    rows = stored(rows.withColumn("full", F.col("rate") >= F.col("ratio")), "rates")
    # Once a source isn't full none after it is, and the first such source's rate holds for all of them.
    final = rows.where(~F.col("full")).agg(F.min_by("rate", F.struct("ratio", "skey"))).first()[0]
    target = F.when(F.col("full"), F.col("cap")).otherwise(F.col("w") * F.lit(final).cast("double"))
    return rows.select("skey", "source_size", "n_docs", target.alias("target"))


def apportion(rows: DataFrame, group: str | None, key: str, votes: str, seats: str) -> DataFrame:
    """Adds ``quota``: Sainte-Laguë, exactly ``seats`` (a column, equal within a group) per group; ties go to the smaller key.

    Without a group there may be any number of keys, and no task gets them all.
    """
    within = Window.partitionBy(group) if group else None
    if group:
        rows = rows.withColumns({"V": F.sum(votes).over(within), "n_": F.count(F.lit(1)).over(within)})
    else:
        votes_, n = rows.agg(F.sum(votes), F.count(F.lit(1))).first()
        rows = rows.withColumns({"V": F.lit(float(votes_ or 0)), "n_": F.lit(n).cast("long")})
    v, big_v, b, n = F.col(votes), F.col("V"), F.col(seats), F.col("n_")
    upto = lambda tau: F.floor((v / tau + 1) / 2)  # noqa: E731  seats whose quotient is at least tau
    sure = F.when((2 * b > n) & (big_v > 0), upto(big_v / (2 * b - n))).otherwise(F.lit(0)).cast("long")
    most = F.when((b > 0) & (big_v > 0), upto(big_v / (2 * b + n))).otherwise(F.lit(0)).cast("long")
    # One seat more and less guards the two bounds against rounding.
    rows = rows.withColumns({"sure": F.greatest(sure - 1, F.lit(0)), "most": F.when(b > 0, most + 1).otherwise(F.lit(0))})
    names = [group, key] if group else [key]
    if group:
        rows = rows.withColumn("given", F.sum("sure").over(within))
    else:
        rows = stored(rows, "sure-seats")
        rows = rows.withColumn("given", F.lit(rows.agg(F.sum("sure")).first()[0] or 0).cast("long"))
    open_seats = rows.where("most >= sure").select(
        *names, votes, seats, "given", F.explode(F.sequence("sure", "most")).alias("k")
    )
    open_seats = open_seats.withColumn("q", F.col(votes) / (2 * F.col("k") + 1))
    if group:
        open_seats = open_seats.withColumn("nth", F.row_number().over(within.orderBy(F.desc("q"), key, "k")) - 1)
    else:
        open_seats = numbered(open_seats.withColumn("less", -F.col("q")), ["less", key, "k"])
    won = open_seats.where(F.col("nth") < F.col(seats) - F.col("given"))
    won = won.groupBy(*names).agg(F.count(F.lit(1)).alias("more"))
    return rows.join(won, names, "left").withColumn("quota", F.col("sure") + F.coalesce("more", F.lit(0))).drop(
        "V", "n_", "sure", "most", "given", "more"
    )


def mix(
    docs: DataFrame,
    id_col: str = "doc_id",
    source_col: str = "source",
    text_col: str = "text",
    block_words: int = 16,
    max_repeats: int = 3,
    shard_docs: int = 2000,
    seed: int = 42,
) -> DataFrame:
    """(id, size, source_size, target, taken, full_passes, first_word, last_word, second_first, second_last, row_hash), a row per row of ``docs``.

    The mix takes ``full_passes`` whole copies of a document and, besides,
    its words [first_word, last_word) and [second_first, second_last), which
    are empty mostly. ``taken`` is the sum of it in words.

    Defined cases: null text has no words; a null source is a source of its
    own, last in order; null ids and repeated rows each take part as rows
    (equal rows are put in a fixed order, so reruns agree); an empty source
    gets target 0, an empty table no rows; texts are counted whole; other
    columns are ignored.
    """
    rows = docs.select(
        F.col(id_col).alias("id"),
        _source_key(F.col(source_col)).alias("skey"),
        F.regexp_count(text_of(text_col), F.lit(WORD)).cast("long").alias("size"),
        F.xxhash64(F.lit(seed), id_col, text_of(text_col)).alias("row_hash"),
    )
    rows = stored(rows, "sizes")
    sources = rows.groupBy("skey").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("n_docs"))
    sources = targets(sources, max_repeats)
    total = sources.agg(F.sum("source_size")).first()[0] or 0
    sources = sources.withColumn("blocks", F.round(F.lit(total) / block_words).cast("long"))
    sources = apportion(sources, None, "skey", "target", "blocks").withColumn(
        "n_shards", F.ceil(F.col("n_docs") / shard_docs)
    )
    sources = stored(sources.select("skey", "source_size", "target", F.col("quota").alias("source_quota"), "n_shards"), "source-quotas")

    salted = sources.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    placed = rows.withColumn("salt", F.pmod(F.col("row_hash"), F.lit(SALTS)).cast("int")).join(salted, ["skey", "salt"])
    shard = F.pmod(F.xxhash64("row_hash", F.lit(seed)), F.col("n_shards"))
    placed = stored(placed.withColumn("shard", shard).drop("salt", "n_shards"), "sharded")

    cells = placed.groupBy("skey", "shard").agg(
        F.sum("size").alias("cell_size"), F.first("source_quota").alias("source_quota")
    )
    cells = apportion(cells, "skey", "shard", "cell_size", "source_quota")
    most = F.col("cell_size") * max_repeats
    length = F.least(F.col("quota") * block_words, most)
    start = F.pmod(F.xxhash64("skey", "shard", F.lit(seed)), F.greatest(F.col("cell_size"), F.lit(1)))
    cells = cells.select("skey", "shard", "cell_size", length.alias("length"), start.alias("start"))

    circle = Window.partitionBy("skey", "shard").orderBy("row_hash", "id", "size")
    at = F.coalesce(F.sum("size").over(circle.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    # Rows without words, which may be alike and many, have no place on the circle.
    out = placed.where("size > 0").withColumn("at", at).join(cells, ["skey", "shard"])
    cell = F.greatest(F.col("cell_size"), F.lit(1))
    # Words [start, start + rest) of the circle are taken once more than all others.
    passes, rest = F.floor(F.col("length") / cell), F.pmod(F.col("length"), cell)
    end = F.col("start") + rest
    clip = lambda x: F.greatest(F.lit(0), F.least(x - F.col("at"), F.col("size")))
    out = out.withColumns(
        {
            "full_passes": passes,
            "first_word": clip(F.col("start")),
            "last_word": clip(end),
            "second_first": F.lit(0).cast("long"),
            "second_last": clip(end - cell),
        }
    )
    taken = (
        F.col("full_passes") * F.col("size")
        + F.greatest(F.col("last_word") - F.col("first_word"), F.lit(0))
        + F.col("second_last")
    )
    columns = ["id", "size", "source_size", "target", "taken", "full_passes", "first_word", "last_word", "second_first", "second_last", "row_hash"]
    out = out.withColumn("taken", taken.cast("long")).select(columns)
    wordless = placed.where("size = 0").withColumns({c: F.lit(0).cast("long") for c in columns[4:10]}).select(columns)
    return out.unionByName(wordless).withColumnRenamed("id", id_col)


def _cut(position: int, fields: int):
    find = re.compile(WORD).finditer

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, ranges = batch.column(position), [batch.column(fields + i) for i in range(5)]
            take, pieces = [], []

            def made():
                columns = [batch.column(i).take(pa.array(take, pa.int64())) for i in range(fields)]
                columns[position] = pa.array(pieces, pa.string())
                return pa.RecordBatch.from_arrays(columns, [batch.schema.field(i).name for i in range(fields)])

            held = 0
            for k in range(batch.num_rows):
                passes, a, b, c, d = (r[k].as_py() for r in ranges)
                text = texts[k].as_py() or ""
                new = [text] * passes
                if b > a or d > c:
                    spans = [m.span() for m in find(text)]
                    new += [text[spans[x][0] : spans[y - 1][1]] for x, y in ((a, b), (c, d)) if y > x]
                take += [k] * len(new)
                pieces += new
                held += sum(map(len, new))
                if held > 1 << 23:
                    yield made()
                    take, pieces, held = [], [], 0
            if take:
                yield made()

    return run


def materialise(docs: DataFrame, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text", seed: int = 42, **how) -> DataFrame:
    """The mix itself: ``docs`` with whole documents repeated and partly taken ones cut at words; other columns are kept.

    Defined cases: those of mix(). Null and empty texts, and documents that
    the mix takes no word of, don't appear; rows alike in id and text share
    out the words that the mix takes of them in any order, each with its own
    other columns; a cut text is the stretch from its first word to its last, as
    written; other columns may have any names; texts of any length are cut
    whole; an empty table gives no rows.
    """
    plan = mix(docs, id_col, source_col, text_col, seed=seed, **how)
    ranges = ["full_passes", "first_word", "last_word", "second_first", "second_last"]
    key, nth, *own = unused(docs.columns, "row_hash", "nth", *ranges)
    # Rows that share the hash repeat whole: which of them gets which share of the words doesn't matter.
    numbered = lambda df: df.withColumn(nth, F.row_number().over(Window.partitionBy(key).orderBy(F.lit(1))))
    chosen = numbered(plan.where("taken > 0").select(F.col("row_hash").alias(key), *[F.col(c).alias(o) for c, o in zip(ranges, own)]))
    hashed = numbered(docs.where(text_of(text_col).rlike(WORD)).withColumn(key, F.xxhash64(F.lit(seed), id_col, text_of(text_col))))
    rows = hashed.join(chosen, [key, nth]).select(*[docs[c] for c in docs.columns], *own)
    return rows.mapInArrow(_cut(docs.columns.index(text_col), len(docs.columns)), docs.schema)
