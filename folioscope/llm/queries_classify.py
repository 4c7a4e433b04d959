"""Queries over the classifiers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioscope.llm.common import table
from folioscope.llm.quality import quality
from folioscope.llm.toxicity import toxicity


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source", "n_chars")
    out = quality(docs, table(spark, sf_dir, "labels"))
    return out.select("doc_id", "quality_score", "content_score", "meta_score", F.col("accepted").cast("int").alias("predicted"))


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


QUERIES = {"op5_quality": op5_quality, "op9_toxicity": op9_toxicity}
SQL: dict[str, str] = {}
