"""A training-data pipeline over ``documents``: five stages, each by one operator of folioscope.llm.

quality classifier -> SimHash near-dedup -> benchmark decontamination ->
mixing to target weights -> token-id output. A stage takes (spark, docs,
sf_dir), works on all rows that the stage before it kept and returns rows with the columns of
documents, but for the last, which returns what its token files hold.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioscope.llm.common import scratch, table, unused, work_dir
from folioscope.llm.decontaminate import clean
from folioscope.llm.mixing import materialise
from folioscope.llm.near_dedup import near_components
from folioscope.llm.quality import quality
from folioscope.llm.token_output import token_output


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the co-trained classifier scores under 0.5 go. Other columns may have any names."""
    (accepted,) = unused(docs.columns, "accepted")
    return quality(docs, table(spark, sf_dir, "labels")).where(F.col(f"`{accepted}`")).select(*[F.col(f"`{c}`") for c in docs.columns])


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates (five words, similarity 0.8) the document with the smallest id stays, once.

    Documents without an id come last, by two hashes of the text; such that
    share an id go by those too, and are told apart by their texts. Of rows that repeat an id and a text but
    differ elsewhere, the one with the smallest hash of all its columns stays, of rows alike in all of them one. Null and
    empty texts are one group. Other columns may have any names.
    """
    row, n = unused(docs.columns, "row", "n")
    text = F.coalesce("text", F.lit(""))
    order = F.struct(F.col("doc_id").isNull().alias("no_id"), F.col("doc_id").alias("id"), F.xxhash64("text").alias("a"), F.xxhash64(text, F.lit(1)).alias("b"), F.xxhash64(*docs.columns).alias("c"))
    keyed = docs.withColumn(row, order)
    groups = near_components(keyed, id_col=row, words=5, similarity=0.8)
    kept = groups.groupBy(row).agg(F.first("component_id").alias("component_id"), F.count(F.lit(1)).alias(n)).where(F.col(row) == F.col("component_id")).select(row, n)
    # A group's first row, as often as it is there; rows that aren't alone are few, unless one is repeated very often.
    found = keyed.join(kept, row)
    once, more = found.where(F.col(n) == 1), found.where(F.col(n) > 1).dropDuplicates([row])
    return once.unionByName(more).select(*[F.col(f"`{c}`") for c in docs.columns])


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a word inside a test item's window go."""
    return clean(docs, table(spark, sf_dir, "benchmark"))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Whole and cut documents as the source quotas ask, repeated at most three times."""
    return materialise(docs).withColumn("n_chars", F.char_length("text").cast("long"))


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token files in ascending doc_id, read back."""
    return token_output(docs, public_tokenizers.path("word_bpe_49k.json"), end_id=2)


STAGES = [
    ("quality classifier", quality_classifier),
    ("simhash near-dedup", near_dedup),
    ("benchmark decontamination", benchmark_decontamination),
    ("mixing", mixing),
    ("token-id output", token_ids),
]

#: Trained models, tokenizers and the automaton can't be said in SQL; tests/llm/test_pipeline.py holds each stage against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows. Every stage's rows stay in the shared folder, what it wrote besides doesn't."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = work_dir(spark, name.replace(" ", "-"), keep=True)
        with scratch(spark):
            stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
