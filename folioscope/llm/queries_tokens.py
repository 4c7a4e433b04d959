"""Query over the token-id output."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from folioscope.llm.common import table
from folioscope.llm.token_output import token_output


def op3_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_output(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), end_id=2)


QUERIES = {"op3_token_output": op3_token_output}
SQL: dict[str, str] = {}
