"""Line deduplication over levelled sorted runs of line hashes.

A *run* is a table of (key, n_docs), bucketed by key and sorted within each
bucket. A batch of documents counts its keys, merge-anti-joins them with what
the runs hold in ``min_docs`` documents already (such a key is settled and
needs no more counting) and adds the rest as a run of level 0. When a level
holds two runs, they are merged into one of the next level: both are sorted
and cut alike, so that is a full outer sort-merge join which moves no row to
another task and sorts no input. The two old runs are deleted then.

No batch can be cleaned before the last one is counted, as a key's documents
can lie in any batches. Cleaning takes the keys that the one run left in the
end counts in ``min_docs`` documents or more.

Keys are 128-bit hashes, 16 bytes each, so runs and joins carry no lines; the
text is shuffled once, to meet the positions of its dropped lines. Everything
is in the shared folder; any task can be run again.
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from folioscope.llm.common import SPACES, ascii_lower, delete, input_bytes, text_of, work_dir

#: Text that stands behind one bucket of a run; its keys take about a quarter of that.
BUCKET_BYTES = 512 << 20
#: Text of one batch.
BATCH_BYTES = 1 << 40
#: A key in more than one in so many of all counted (document, key) pairs is dealt with apart: there are fewer than that of them.
HOT_SHARE = 100_000


def line_key(line: Column) -> Column:
    """Stripped at both ends of [\\x20\\x09-\\x0D] and A-Z lower-cased."""
    return ascii_lower(F.btrim(line, F.lit(SPACES)))


class LineRuns:
    """The runs below ``path``; the list of levels is the only state on the driver.

    With ``min_docs``, keys that one of the runs holds in as many documents
    are settled: later batches don't count them again.
    """

    def __init__(self, spark: SparkSession, path: str | None = None, fanout: int = 2, min_docs: int | None = None, buckets: int = 1):
        self.spark, self.fanout, self.min_docs = spark, fanout, min_docs
        self.path = path or work_dir(spark, "runs")
        self.levels: list[list[str]] = [[]]
        self.merges = 0
        self.buckets = max(buckets, int(spark.conf.get("spark.sql.shuffle.partitions")))
        self._name, self._made = f"line_run_{uuid.uuid4().hex}", 0
        self._tables: dict[str, str] = {}

    @contextmanager
    def _cut_alike(self) -> Iterator[None]:
        """Counting deals keys out as the buckets do, and a bucket of one file is taken as sorted."""
        conf = {"spark.sql.shuffle.partitions": str(self.buckets), "spark.sql.legacy.bucketedTableScan.outputOrdering": "true"}
        before = {k: self.spark.conf.get(k) for k in conf}
        try:
            for k, v in conf.items():
                self.spark.conf.set(k, v)
            yield
        finally:
            for k, v in before.items():
                self.spark.conf.set(k, v)

    def _write(self, counts: DataFrame, level: int) -> None:
        self._made += 1
        where, name = f"{self.path}/level={level}/run={self._made}", f"{self._name}_{self._made}"
        counts.write.bucketBy(self.buckets, "key").sortBy("key").option("path", where).format("parquet").saveAsTable(name)
        self._tables[where] = name
        while len(self.levels) <= level:
            self.levels.append([])
        self.levels[level].append(where)

    def _run(self, where: str) -> DataFrame:
        return self.spark.table(self._tables[where])

    def _forget(self, runs: list[str]) -> None:
        for where in runs:
            self.spark.sql(f"DROP TABLE IF EXISTS {self._tables.pop(where)}")
            delete(self.spark, where)

    def add(self, keys: DataFrame) -> None:
        """A new batch: ``keys`` has one row per (document, distinct key)."""
        with self._cut_alike():
            counts = keys.groupBy("key").agg(F.count(F.lit(1)).alias("n_docs"))
            if self.min_docs:
                for where in self.runs():
                    settled = self._run(where).where(F.col("n_docs") >= self.min_docs)
                    counts = counts.join(settled.hint("merge"), "key", "left_anti")
            self._write(counts, 0)
            level = 0
            while len(self.levels[level]) >= self.fanout:
                self._merge(self.levels[level], level + 1)
                level += 1

    def merged(self, runs: list[str]) -> DataFrame:
        """(key, n_docs) of sorted runs, merged two at a time."""

        def two(a: DataFrame, b: DataFrame) -> DataFrame:
            both = a.join(b.withColumnRenamed("n_docs", "_more").hint("merge"), "key", "full_outer")
            return both.select("key", (F.coalesce("n_docs", F.lit(0)) + F.coalesce("_more", F.lit(0))).alias("n_docs"))

        return reduce(two, [self._run(p) for p in runs])

    def _merge(self, runs: list[str], level: int) -> None:
        runs = list(runs)
        self._write(self.merged(runs), level)
        self.levels = [[p for p in held if p not in runs] for held in self.levels]
        self.merges += 1
        for where in runs:
            self.spark.sql(f"DROP TABLE {self._tables.pop(where)}")
            delete(self.spark, where)

    def runs(self) -> list[str]:
        return [p for level in self.levels for p in level]

    def totals(self) -> DataFrame:
        """(key, n_docs) of all runs, which become one, small ones first. A settled key's count is a lower bound."""
        with self._cut_alike():
            while len(runs := self.runs()) > 1:
                self._merge(runs[:2], len(self.levels) - 1)
        return self._run(runs[0])

    def frequent(self, min_docs: int) -> DataFrame:
        """Keys that all runs together count in ``min_docs`` documents or more."""
        return self.totals().where(F.col("n_docs") >= min_docs).select("key")


def _row_key(id_col: str, text_col: str) -> list[Column]:
    """Two hashes that name a row by id and text: rows that share both repeat whole and lose the same lines."""
    id_part = F.coalesce(F.concat(F.lit("="), F.col(id_col).cast("string")), F.lit("-"))
    return [F.xxhash64(id_part).alias("row_id"), F.xxhash64(text_of(text_col)).alias("row_text")]


def line_dedup(
    docs: DataFrame | list[DataFrame],
    id_col: str = "doc_id",
    text_col: str = "text",
    min_chars: int = 1,
    min_docs: int = 10,
    least_batches: int = 4,
    batch_bytes: int = BATCH_BYTES,
) -> DataFrame:
    """(id, n_lines, n_dropped, kept_text), one row per row of ``docs``.

    ``docs`` is a table or a list of arrivals. A table is dealt into batches
    by hashes of its rows, as many as its bytes ask for and ``least_batches``
    at least, however many files it has; each arrival is dealt like that too.

    Keys of at least ``min_chars`` code points that are in ``min_docs``
    documents or more lose all their lines in every document; the others
    stay, in order, joined by \\n.

    A key in a large share of all documents would be one task's work, so the
    keys that make up more than 1 in HOT_SHARE of all counted pairs, fewer
    than HOT_SHARE by that, are broadcast; all others are merge-joined.

    Defined cases: null or empty text is one empty line and stays (its key
    is too short for any ``min_chars`` above 0); a key repeated within one
    document counts once; each row is a document of its own, repeated rows
    and null ids too; texts of any length are handled whole; an empty table
    gives no rows; other columns are ignored. The positions and the last run
    stay in the shared folder, as the result reads them.
    """
    arrivals = docs if isinstance(docs, list) else [docs]
    spark = arrivals[0].sparkSession
    sizes = [input_bytes(d, text_col) for d in arrivals]
    store = LineRuns(spark, min_docs=min_docs, buckets=math.ceil(sum(sizes) / BUCKET_BYTES))
    places = []
    for n, (arrival, size) in enumerate(zip(arrivals, sizes)):
        share = max(least_batches, math.ceil(size / batch_bytes))
        keys = F.transform(F.split(text_of(text_col), "\n", -1), line_key)
        hashes = F.transform(keys, lambda x: F.when(F.char_length(x) >= min_chars, F.unhex(F.md5(x))))
        rows = arrival.select(*_row_key(id_col, text_col), hashes.alias("keys"))
        rows = rows.withColumn("batch", F.pmod(F.xxhash64("row_text", "row_id"), F.lit(share)).cast("int"))
        where = f"{store.path}/places/arrival={n}"
        rows.write.partitionBy("batch").parquet(where)
        places.append(spark.read.schema(rows.schema).parquet(where))
        # array_distinct hashes strings, but compares binary elements pair by pair.
        once = F.array_distinct(F.transform(F.array_compact("keys"), lambda x: F.hex(x)))
        for k in range(share):
            store.add(places[-1].where(F.col("batch") == k).select(F.explode(once).alias("key")).select(F.unhex("key").alias("key")))
    counts = store.totals()
    floor = max(min_docs, (counts.agg(F.sum("n_docs")).first()[0] or 0) // HOT_SHARE)
    hot = F.broadcast(counts.where(F.col("n_docs") > floor).select("key"))
    rest = counts.where(F.col("n_docs").between(min_docs, floor)).select("key")
    at = reduce(DataFrame.unionAll, places).select("row_id", "row_text", F.posexplode("keys").alias("pos", "key"))
    at = at.where(F.col("key").isNotNull())
    gone = at.join(hot, "key", "left_semi").unionAll(at.join(hot, "key", "left_anti").join(rest.hint("merge"), "key", "left_semi"))
    dropped = gone.groupBy("row_id", "row_text").agg(F.collect_set("pos").alias("gone"))
    # Split before the join: above it ``lines`` is a plain column, not an expression evaluated again for each line.
    split = [F.col(id_col).alias("id"), F.split(text_of(text_col), "\n", -1).alias("lines"), *_row_key(id_col, text_col)]
    rows = reduce(DataFrame.unionAll, [d.select(*split) for d in arrivals])
    n_lines = F.size("lines")
    stay = F.array_except(F.sequence(F.lit(0), n_lines - 1), F.col("gone"))
    kept = F.when(F.col("gone").isNull(), F.col("lines")).otherwise(F.transform(stay, lambda i: F.get("lines", i)))
    return rows.join(dropped, ["row_id", "row_text"], "left").select(
        F.col("id").alias(id_col),
        n_lines.cast("long").alias("n_lines"),
        F.when(F.col("gone").isNull(), F.lit(0)).otherwise(F.size("gone")).cast("long").alias("n_dropped"),
        F.array_join(kept, "\n").alias("kept_text"),
    )
