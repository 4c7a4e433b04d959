"""Table functions for SQL: register(spark) makes them known to a session."""

from __future__ import annotations

import hashlib

from pyspark.sql import SparkSession
from pyspark.sql.functions import udtf
from pyspark.sql.types import IntegerType, LongType, StringType, StructField, StructType
from pyspark.sql.udtf import AnalyzeArgument, AnalyzeResult


class Passages:
    """passages(TABLE(pieces) PARTITION BY item_id ORDER BY pos, k, target, most, least): the rows of text.passages() of pieces (item_id, pos, k, piece).

    A text is one partition, read in order: what is kept is the passages of one text.
    """

    @staticmethod
    def analyze(pieces: AnalyzeArgument, target: AnalyzeArgument, most: AnalyzeArgument, least: AnalyzeArgument) -> AnalyzeResult:
        fields = {f.name: f.dataType for f in pieces.dataType.fields}
        missing = {"item_id", "piece"} - fields.keys()
        if missing:
            raise ValueError(f"passages() needs columns {sorted(missing)}")
        for name, given in (("target", target), ("most", most), ("least", least)):
            if not isinstance(given.value, int):
                raise ValueError(f"{name} is a number of words")
        columns = [StructField("item_id", fields["item_id"]), StructField("idx", IntegerType()), StructField("words", LongType())]
        return AnalyzeResult(schema=StructType([*columns, StructField("text", StringType()), StructField("hash", StringType())]))

    def __init__(self):
        self._item, self._done, self._least = None, [], 0

    def eval(self, row, target: int, most: int, least: int):
        self._item, self._least = row["item_id"], least
        n = row["piece"].count(" ") + 1
        if self._done and self._done[-1][0] < target and self._done[-1][0] + n <= most:
            words, text = self._done[-1]
            self._done[-1] = (words + n, f"{text} {row['piece']}")
        else:
            self._done.append((n, row["piece"]))

    def terminate(self):
        if len(self._done) > 1 and self._done[-1][0] < self._least:
            (a, first), (b, second) = self._done[-2:]
            self._done[-2:] = [(a + b, f"{first} {second}")]
        for k, (words, text) in enumerate(self._done):
            yield self._item, k, words, text, hashlib.sha256(text.encode()).hexdigest()


def register(spark: SparkSession) -> None:
    spark.udtf.register("passages", udtf(Passages))
