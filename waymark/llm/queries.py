"""The queries of this subpackage by name, and SQL for those that SQL can express."""

from __future__ import annotations

from waymark.llm import decontaminate, embedding_dedup, language_id, lm_score, mixing, ngram_join, pii, sharding, tool_calls, url_filter

QUERIES = {
    "op1_benchmark_decontamination": decontaminate.query,
    "op2_pii": pii.query,
    "op3_sharding": sharding.query,
    "op4_tool_call_linking": tool_calls.query,
    "op5_source_mixing": mixing.query,
    "op6_embedding_near_dedup": embedding_dedup.query,
    "op7_lm_scoring": lm_score.query,
    "op8_url_filter": url_filter.query,
    "op9_ngram_jaccard_join": ngram_join.query,
    "op10_language_id": language_id.query,
}

SQL = {
    "op5_source_mixing": mixing.SQL,
    "op8_url_filter": url_filter.SQL,
}
