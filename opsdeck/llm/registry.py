"""The queries of this subpackage: one per operator over its whole table."""

from __future__ import annotations

from opsdeck.llm import bpe, fim, katz, langid, line_dedup, mih, mixing, ngram_join, phrases, quality, substring_dedup, token_counts, url_filter

QUERIES = {
    "op1_mix_sources": mixing.query,
    "op2_katz_backoff": katz.query,
    "op3_substring_dedup": substring_dedup.query,
    "op4_byte_bpe": bpe.query,
    "op5_quality_rules": quality.query,
    "op6_language_id": langid.query,
    "op7_multi_index_hashing": mih.query,
    "op8_token_counts": token_counts.query,
    "op9_ngram_jaccard_join": ngram_join.query,
    "op10_url_filter": url_filter.query,
    "op11_fill_in_middle": fim.query,
    "op12_phrase_mining": phrases.query,
    "op13_line_dedup": line_dedup.query,
}

#: DuckDB SQL where SQL can express the operator; the others are tested by brute force.
ORACLE_SQL = {
    "op1_mix_sources": mixing.ORACLE,
    "op3_substring_dedup": substring_dedup.ORACLE,
    "op9_ngram_jaccard_join": ngram_join.ORACLE,
    "op11_fill_in_middle": fim.ORACLE,
    "op12_phrase_mining": phrases.ORACLE,
    "op13_line_dedup": line_dedup.ORACLE,
}
