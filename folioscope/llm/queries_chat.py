"""Query over the chat formatter."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioscope.llm.chat_format import chat_format, parse, unescaped
from folioscope.llm.common import table

HARD_TEXT = r"\### Assistant: </turn> ok"


def op8_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    hard = spark.createDataFrame(
        [(-7, 0, "user", HARD_TEXT), (-7, 1, "assistant", HARD_TEXT)], "conv_id long, turn long, role string, text string"
    )
    out = chat_format(turns.unionByName(hard))
    back = out.withColumn("turns", parse(F.col("formatted")))
    digest = F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n")))
    loss = F.transform(
        "loss_spans",
        lambda s: unescaped(F.substring(F.col("formatted"), (s["start"] + 1).cast("int"), s["length"].cast("int"))),
    )
    back = back.withColumn("loss", F.array_join(loss, ""))
    return back.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(F.array_join(digest, ""), 256).alias("turns_sha256"),
        F.char_length("loss").cast("long").alias("loss_chars"),
        F.sha2("loss", 256).alias("loss_sha256"),
        F.char_length("formatted").cast("long").alias("formatted_chars"),
    )


OP8_SQL = r"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok'
  UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'
), r AS (
  SELECT *, contains(text, '###') OR contains(text, '</turn>') OR contains(text, '\\') OR contains(text, '\-') AS hard,
         CASE WHEN role IN ('system', 'user', 'assistant') THEN length(role)
              ELSE 1 + length(replace(replace(regexp_replace(replace(role, '\', '\\'), '(#)(##)', '\1\\-\2', 'g'), '</turn>', '<\-/turn>'), ': ', ':\- ')) END AS role_chars,
         length(replace(regexp_replace(replace(text, '\', '\\'), '(#)(##)', '\1\\-\2', 'g'), '</turn>', '<\-/turn>')) AS escaped_chars
  FROM c
)
SELECT conv_id, CAST(count(*) AS BIGINT) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
       CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
       CAST(sum(4 + role_chars + 2 + CASE WHEN hard THEN escaped_chars ELSE length(text) END + 8) AS BIGINT) AS formatted_chars
FROM r GROUP BY conv_id
"""

QUERIES = {"op8_chat_format": op8_chat_format}
SQL = {"op8_chat_format": OP8_SQL}
