"""Queries of this subpackage by name, and their SQL."""

from __future__ import annotations

from contestry.llm import (
    benchmark,
    exact,
    hosts,
    language,
    negatives,
    packing,
    perplexity,
    repair,
    rules,
    secrets,
    simhash,
    substrings,
    warc,
)

QUERIES = {
    "op1_secret_scans": secrets.op1_secret_scans,
    "op2_quality_classifier": perplexity.op2_quality_classifier,
    "op3_quality_rules": rules.op3_quality_rules,
    "op4_substring_dedup": substrings.op4_substring_dedup,
    "op5_simhash_near_dedup": simhash.op5_simhash_near_dedup,
    "op6_benchmark_decontamination": benchmark.op6_benchmark_decontamination,
    "op7_url_filters": hosts.op7_url_filters,
    "op8_warc": warc.op8_warc,
    "op9_language_id": language.op9_language_id,
    "op10_best_fit_packing": packing.op10_best_fit_packing,
    "op11_hard_negatives": negatives.op11_hard_negatives,
    "op12_conversation_repair": repair.op12_conversation_repair,
    "op13_exact_dedup": exact.op13_exact_dedup,
}
ORACLES: dict[str, str] = {
    "op8_warc": warc.OP8_SQL,
    "op11_hard_negatives": negatives.OP11_SQL,
    "op12_conversation_repair": repair.OP12_SQL,
    "op13_exact_dedup": exact.OP13_SQL,
}
