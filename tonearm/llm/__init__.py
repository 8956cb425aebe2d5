"""Operators of a training-data pipeline over documents, pages and embeddings.

Nothing else in the library imports this subpackage. ``QUERIES`` and ``ORACLE_SQL`` hold the
registered queries, one for each operator.
"""

from __future__ import annotations

from . import (
    crf_quality,
    html_density,
    language_id,
    packing,
    pii,
    pivot_search,
    rans_tokens,
    simhash,
    source_mix,
    token_rollups,
)

QUERIES = {
    "op1_crf_quality": crf_quality.query,
    "op2_slack_packing": packing.query,
    "op3_token_rollups": token_rollups.query,
    "op4_rans_tokens": rans_tokens.query,
    "op5_kneser_ney_language": language_id.query,
    "op6_text_density": html_density.query,
    "op7_pii_spans": pii.query,
    "op8_simhash_groups": simhash.query,
    "op9_pivot_topk": pivot_search.query,
    "op10_source_mix": source_mix.query,
}

ORACLE_SQL = {
    "op9_pivot_topk": pivot_search.ORACLE_SQL,
}
