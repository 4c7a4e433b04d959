"""Queries and oracle SQL of this subpackage, for the driver's contract."""

from __future__ import annotations

from folioscope.llm import (
    queries_chat,
    queries_classify,
    queries_decontaminate,
    queries_dedup,
    queries_fill,
    queries_mixing,
    queries_phrases,
    queries_pieces,
    queries_tokens,
    queries_warc,
)

_MODULES = (queries_chat, queries_classify, queries_decontaminate, queries_dedup, queries_fill, queries_mixing, queries_phrases, queries_pieces, queries_tokens, queries_warc)

QUERIES = {k: v for m in _MODULES for k, v in m.QUERIES.items()}
SQL = {k: v for m in _MODULES for k, v in m.SQL.items()}
