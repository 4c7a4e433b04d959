"""What the operators of this subpackage share: table reading, the shared folder, text rules."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterable, Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII white space, the class [\x20\x09-\x0D].
SPACES = " \t\n\x0b\x0c\r"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Unset, it is one of our own, which only a local master may use."""
    where = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not where:
        master = spark.sparkContext.master
        if not re.match(r"local(\[|$)", master):
            raise RuntimeError(f"set spark.checkpoint.dir to a folder that all nodes of {master} share")
        where = tempfile.mkdtemp(prefix="folioscope-")
        spark.sparkContext.setCheckpointDir(where)
    return where if ":" in where else f"file://{where}"


#: Folders made since the innermost scratch() began; None outside of it.
_SCRATCH: ContextVar[list[str] | None] = ContextVar("scratch", default=None)


def work_dir(spark: SparkSession, what: str, keep: bool = False) -> str:
    """A fresh folder name below the shared folder; without ``keep``, it goes when a scratch() around it ends."""
    path = f"{shared_dir(spark).rstrip('/')}/{what}-{uuid.uuid4().hex}"
    made = _SCRATCH.get()
    if made is not None and not keep:
        made.append(path)
    return path


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """What is written in the shared folder meanwhile is deleted in the end: results that read it must have been written by then."""
    made: list[str] = []
    before = _SCRATCH.set(made)
    try:
        yield
    finally:
        _SCRATCH.reset(before)
        for path in made:
            delete(spark, path)


def delete(spark: SparkSession, path: str) -> None:
    """What lies at ``path`` in the shared folder goes, when nothing reads it any more."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def input_bytes(df: DataFrame, text_col: str = "text") -> int:
    """Bytes behind ``df``: the size of its files where it reads one table, or else its texts' bytes, counted."""
    plan = df._jdf.queryExecution().optimizedPlan()
    known = int(str(plan.stats().sizeInBytes()))
    if plan.collectLeaves().size() == 1 and known < 1 << 60:
        return known
    return df.agg(F.coalesce(F.sum(F.octet_length(text_of(text_col))), F.lit(0))).first()[0]


def stored(df: DataFrame, what: str, **how: str) -> DataFrame:
    """``df`` written as Parquet in the shared folder and read again: lineage ends here, and a lost executor costs no recomputation."""
    spark = df.sparkSession
    path = work_dir(spark, what)
    schema = df.schema
    df.write.options(**how).parquet(path)
    return spark.read.schema(schema).parquet(path)


def unused(columns: Iterable[str], *names: str) -> list[str]:
    """The names, each with as many underscores after it as no column (in any case of letters) has."""
    taken, found = {c.lower() for c in columns}, []
    for name in names:
        while name.lower() in taken:
            name += "_"
        found.append(name)
    return found


def text_of(col: str | Column) -> Column:
    """The text, null as empty."""
    return F.coalesce(F.col(col) if isinstance(col, str) else col, F.lit(""))


def ascii_lower(col: Column) -> Column:
    """A-Z lower-cased and nothing else; all-ASCII strings take the faster built-in."""
    return F.when(F.octet_length(col) == F.char_length(col), F.lower(col)).otherwise(F.translate(col, UPPER, UPPER.lower()))


def without_spaces(col: Column) -> Column:
    """``col`` without the characters of SPACES. Byte-wise replaces beat one translate() about threefold."""
    for c in SPACES:
        col = F.replace(col, F.lit(c))
    return col
