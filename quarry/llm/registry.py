"""The registered queries of this package and their SQL."""

from __future__ import annotations

from quarry.llm import bpe_codec, jaccard_join, language_id, mixing, page_text, quality_rules, rare_features, token_counts, token_files, url_filter

QUERIES = {
    "op1_mixing": mixing.query,
    "op2_language_id": language_id.query,
    "op3_jaccard_join": jaccard_join.query,
    "op4_quality_rules": quality_rules.query,
    "op5_page_text": page_text.query,
    "op6_url_filter": url_filter.query,
    "op7_token_counts": token_counts.query,
    "op8_token_files": token_files.query,
    "op9_rare_features": rare_features.query,
    "op10_bpe_codec": bpe_codec.query,
}

#: Tokenizers and language ID can't be expressed in SQL; those queries are tested against their library, or by held-out rows.
ORACLE_SQL: dict[str, str] = {
    "op1_mixing": mixing.SQL,
    "op3_jaccard_join": jaccard_join.SQL,
    "op4_quality_rules": quality_rules.SQL,
}
