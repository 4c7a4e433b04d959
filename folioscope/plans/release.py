"""Vector releases as Parquet with a manifest that readers hold the rows against."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def fingerprint(rows: DataFrame) -> DataFrame:
    """One row (records, dimensions, checksum) of rows (item_id, vector): sums of parts of the rows' SHA-256, so their order doesn't matter."""
    text = F.concat_ws(":", F.col("item_id").cast("string"), F.array_join(F.transform("vector", lambda x: x.cast("string")), ","))
    digest = F.sha2(text, 256)
    part = lambda k: F.sum(F.conv(F.substring(digest, 1 + 12 * k, 12), 16, 10).cast("decimal(38,0)"))
    whole = F.concat_ws("-", *[F.coalesce(part(k).cast("string"), F.lit("0")) for k in range(4)])
    size = F.size("vector")
    one_size = F.when(F.min(size) != F.max(size), F.raise_error(F.lit("vectors of several sizes")).cast("int")).otherwise(F.coalesce(F.max(size), F.lit(0)))
    return rows.agg(F.count(F.lit(1)).alias("records"), one_size.alias("dimensions"), whole.alias("checksum"))


def write_release(rows: DataFrame, path: str, **contract: str) -> None:
    """Rows (item_id, vector, ...) and, last, the manifest; ``contract`` says what made the vectors (model, revision, ...)."""
    floats = rows.withColumn("vector", F.col("vector").cast("array<float>"))
    floats.write.mode("errorifexists").parquet(f"{path}/vectors")
    stored = rows.sparkSession.read.parquet(f"{path}/vectors")
    says = fingerprint(stored).withColumns({k: F.lit(v) for k, v in sorted(contract.items())})
    says.coalesce(1).write.mode("errorifexists").json(f"{path}/manifest")


def read_release(spark: SparkSession, path: str, **contract: str) -> DataFrame:
    """The rows, if manifest, rows and contract agree; an error otherwise."""
    says = spark.read.json(f"{path}/manifest").first().asDict()
    rows = spark.read.parquet(f"{path}/vectors")
    found = fingerprint(rows).first().asDict() | contract
    if wrong := sorted(k for k, v in found.items() if says.get(k) != v):
        raise ValueError(f"the release isn't what its manifest says: {wrong}")
    return rows
