"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

from . import alignment, decontaminate, html_text, language_model, mixing, pii, quality, simhash, substring_dedup, suffix_dedup, tokens, top_k, vector_codes

QUERIES = {
    "op1_mix_sources": mixing.op1_mix_sources,
    "op2_quality_rules": quality.op2_quality_rules,
    "op3_substring_dedup": substring_dedup.op3_substring_dedup,
    "op4_token_counts": tokens.op4_token_counts,
    "op5_main_text": html_text.op5_main_text,
    "op6_simhash_groups": simhash.op6_simhash_groups,
    "op7_private_spans": pii.op7_private_spans,
    "op8_suffix_dedup": suffix_dedup.op8_suffix_dedup,
    "op9_decontaminate": decontaminate.op9_decontaminate,
    "op10_language_model": language_model.op10_language_model,
    "op11_vector_codes": vector_codes.op11_vector_codes,
    "op12_cross_tokenizer": alignment.op12_cross_tokenizer,
    "op13_exact_top_k": top_k.op13_exact_top_k,
}
ORACLES = {
    "op1_mix_sources": mixing.OP1_SQL,
    "op2_quality_rules": quality.OP2_SQL,
    "op3_substring_dedup": substring_dedup.OP3_SQL,
    "op8_suffix_dedup": suffix_dedup.OP8_SQL,
    "op9_decontaminate": decontaminate.OP9_SQL,
    "op11_vector_codes": vector_codes.OP11_SQL,
    "op13_exact_top_k": top_k.OP13_SQL,
}
