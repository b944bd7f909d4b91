"""The queries of this subpackage by name, and SQL for those that SQL can express."""

from __future__ import annotations

from voxtally.llm import (
    chat,
    decontamination,
    line_dedup,
    ngram_join,
    packing,
    prefix_trie,
    quality_classifier,
    quality_rules,
    substring_dedup,
    token_alignment,
    token_counts,
    token_planes,
    url_filters,
)

QUERIES = {
    "op1_chat_formatting": chat.op1_chat_formatting,
    "op2_best_fit_packing": packing.op2_best_fit_packing,
    "op3_suffix_array_dedup": substring_dedup.op3_suffix_array_dedup,
    "op4_url_filters": url_filters.op4_url_filters,
    "op5_quality_rules": quality_rules.op5_quality_rules,
    "op6_token_counts": token_counts.op6_token_counts,
    "op7_fuzzy_line_dedup": line_dedup.op7_fuzzy_line_dedup,
    "op8_benchmark_decontamination": decontamination.op8_benchmark_decontamination,
    "op9_quality_classifier": quality_classifier.op9_quality_classifier,
    "op10_ngram_jaccard_join": ngram_join.op10_ngram_jaccard_join,
    "op11_prefix_trie": prefix_trie.op11_prefix_trie,
    "op12_token_planes": token_planes.op12_token_planes,
    "op13_tokenizer_alignment": token_alignment.op13_tokenizer_alignment,
}

ORACLES = {
    "op1_chat_formatting": chat.OP1_SQL,
    "op4_url_filters": url_filters.OP4_SQL,
    "op8_benchmark_decontamination": decontamination.OP8_SQL,
    "op10_ngram_jaccard_join": ngram_join.OP10_SQL,
    "op11_prefix_trie": prefix_trie.OP11_SQL,
}
