"""Exact deduplication by progressive refinement, in DataFrame operations only.

Texts are equal when identical after white space is deleted. Three levels
narrow the rows that can have an equal:

1. length of the normalised text,
2. hash of its first ``prefix_chars`` characters, for lengths found twice,
3. SHA-256 of all of it, for (length, prefix) pairs found twice.

Levels 1 and 2 move (length, hash, count) only, counted map-side first.
Which rows reach level 3 is told by a bitmap that every task gets as a
scalar: the text itself is never shuffled, and a false positive costs one
needless hash and changes nothing. The bitmap has some 16 bits for each
(length, prefix) pair that is found twice, up to MOST_BITS (32 MB); with
more pairs than that can tell apart, more single texts are hashed in full.

Only rows that reached level 3 meet the groups; all others pass by. Groups of
more than 1 in HOT_SHARE of all rows, fewer than HOT_SHARE by that, are
broadcast, so that no task gets all copies of one text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioscope.llm.common import stored, text_of, without_spaces


LEAST_BITS, MOST_BITS = 1 << 20, 1 << 28
HOT_SHARE = 10_000


def _bitmap(keys: DataFrame, bits: int) -> Column:
    """Scalar array of bits / 64 longs with the bit of each row's ``slot`` set."""
    spark = keys.sparkSession
    words = keys.groupBy(F.floor(F.col("slot") / 64).alias("word")).agg(
        F.bit_or(F.expr("shiftleft(1L, cast(slot % 64 as int))")).alias("mask")
    )
    dense = spark.range(bits // 64).join(words, F.col("id") == F.col("word"), "left")
    return dense.agg(
        F.transform(
            F.array_sort(F.collect_list(F.struct("id", F.coalesce("mask", F.lit(0)).alias("mask")))),
            lambda x: x["mask"],
        )
    ).scalar()


def _slot(bits: int, *cols: str) -> Column:
    return F.pmod(F.xxhash64(*cols), F.lit(bits))


def _is_set(bitmap: Column, slot: Column) -> Column:
    word = F.get(bitmap, F.floor(slot / 64).cast("int"))
    return F.call_function("getbit", word, (slot % 64).cast("int")) == 1


def exact_dedup(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    prefix_chars: int = 128,
    bits: int | None = None,
    digest_all: bool = False,
) -> DataFrame:
    """(id, keep_id, group_size, kept, text_sha256), one row per row of ``docs``.

    Of equal texts the row with the most code points in the original text
    stays, then the smallest id. ``text_sha256`` is the digest that level 3
    made, null for rows that an earlier level found single; with
    ``digest_all`` every row gets it (the groups are found as before).

    Defined cases: a null text counts as empty, empty texts equal each
    other; rows that repeat whole, id included, count each in group_size and
    share one decision; null ids sort last and a group of them only keeps a
    null id; an empty table gives no rows; other columns are ignored.
    """
    norm = without_spaces(text_of(text_col))
    rows = docs.select(F.col(id_col).alias("id"), text_of(text_col).alias("t"), norm.alias("norm"))
    rows = rows.select(
        "id", "norm", F.char_length("t").alias("n_chars"), F.octet_length("norm").alias("norm_len")
    ).withColumn("prefix", F.xxhash64(F.substring("norm", 1, prefix_chars)))

    pairs = stored(rows.groupBy("norm_len", "prefix").agg(F.count(F.lit(1)).alias("n")), "lengths")
    lengths = pairs.groupBy("norm_len").agg(F.sum("n").alias("n_len")).where("n_len > 1")
    candidates = pairs.where("n > 1").join(lengths, "norm_len", "left_semi")
    total, twice = pairs.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count_if(F.col("n") > 1)).first()
    bits = bits or min(MOST_BITS, max(LEAST_BITS, 1 << (16 * twice).bit_length()))
    bitmap = _bitmap(candidates.select(_slot(bits, "norm_len", "prefix").alias("slot")), bits)

    alive = _is_set(bitmap, _slot(bits, "norm_len", "prefix"))
    digest = F.sha2("norm", 256)
    hashed = rows.select(
        "id",
        "n_chars",
        "norm_len",
        alive.alias("alive"),
        (digest if digest_all else F.when(alive, digest)).alias("text_sha256"),
    )
    hashed = stored(hashed, "digests")
    groups = (
        hashed.where("alive")
        .groupBy("norm_len", "text_sha256")
        .agg(
            F.count(F.lit(1)).alias("group_size"),
            F.min(F.struct((-F.col("n_chars")).alias("n"), F.col("id").isNull().alias("no_id"), "id"))["id"].alias("keep_id"),
        )
        .where("group_size > 1")
    )
    groups = groups.select("norm_len", "text_sha256", "keep_id", "group_size")
    floor = max(1, total // HOT_SHARE)
    on = ["norm_len", "text_sha256"]
    alive, hot = hashed.where("alive"), F.broadcast(groups.where(F.col("group_size") > floor))
    rest = alive.join(hot, on, "left_anti").join(groups.where(F.col("group_size") <= floor), on, "left")
    alone = hashed.where(~F.col("alive")).withColumns({"keep_id": F.col("id"), "group_size": F.lit(None).cast("long")})
    out = alive.join(hot, on).unionByName(rest).unionByName(alone)
    single = F.col("group_size").isNull()
    return out.select(
        F.col("id").alias(id_col),
        F.when(single, F.col("id")).otherwise(F.col("keep_id")).alias("keep_id"),
        F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"),
        (single | F.col("id").eqNullSafe(F.col("keep_id"))).alias("kept"),
        "text_sha256",
    )
