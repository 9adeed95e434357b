"""The queries of the corpus operators and their SQL."""

from __future__ import annotations

from terrace.llm import byte_bpe, exact_dedup, line_dedup, lm_scoring, mixing, ngram_join, quality_rules, suffix_dedup, token_counts, toxicity

QUERIES = {
    "op1_ngram_jaccard": ngram_join.op1_ngram_jaccard,
    "op2_line_dedup": line_dedup.op2_line_dedup,
    "op3_lm_scoring": lm_scoring.op3_lm_scoring,
    "op4_toxicity": toxicity.op4_toxicity,
    "op5_exact_dedup": exact_dedup.op5_exact_dedup,
    "op6_quality_rules": quality_rules.op6_quality_rules,
    "op7_byte_bpe": byte_bpe.op7_byte_bpe,
    "op8_mixing": mixing.op8_mixing,
    "op9_suffix_dedup": suffix_dedup.op9_suffix_dedup,
    "op10_token_counts": token_counts.op10_token_counts,
}
#: The others have no SQL: tests hold them against brute force or the public libraries.
ORACLE_SQL = {
    "op5_exact_dedup": exact_dedup.SQL,
    "op6_quality_rules": quality_rules.SQL,
    "op8_mixing": mixing.SQL,
}
