"""The registered queries of this subpackage and the SQL that states them, where SQL can."""

from __future__ import annotations

from pagelake.llm import (
    decontaminate, html_main, jaccard, langid, lines, lm, mixing, quality, sharding, suffix_sort, token_align, toxicity, whitening,
)

QUERIES = {
    "op1_line_dedup": lines.op1_line_dedup,
    "op2_ngram_jaccard": jaccard.op2_ngram_jaccard,
    "op3_sharding": sharding.op3_sharding,
    "op4_mixing": mixing.op4_mixing,
    "op5_toxicity": toxicity.op5_toxicity,
    "op6_lm_scoring": lm.op6_lm_scoring,
    "op7_language_id": langid.op7_language_id,
    "op8_html_extraction": html_main.op8_html_extraction,
    "op9_decontamination": decontaminate.op9_decontamination,
    "op10_quality_rules": quality.op10_quality_rules,
    "op11_token_alignment": token_align.op11_token_alignment,
    "op12_suffix_dedup": suffix_sort.op12_suffix_dedup,
    "op13_embedding_whitening": whitening.op13_embedding_whitening,
}

ORACLE = {
    "op4_mixing": mixing.oracle_sql(),
    "op9_decontamination": decontaminate.oracle_sql(),
    "op10_quality_rules": quality.oracle_sql(),
}
