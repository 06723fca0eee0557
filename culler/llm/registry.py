"""Queries of the subpackage and the SQL that says the same."""

from __future__ import annotations

from culler.llm import chat, classifier, decontam, jaccard, line_dedup, packing, quality_rules, secrets, sharding, substring


def queries() -> dict:
    found = (
        substring.op1_substring_dedup,
        packing.op2_best_fit_packing,
        jaccard.op3_ngram_jaccard_join,
        chat.op4_chat_formatting,
        classifier.op5_quality_classifier,
        sharding.op6_sharding,
        quality_rules.op7_quality_rules,
        decontam.op8_benchmark_decontamination,
        secrets.op9_secret_scans,
        line_dedup.op10_line_dedup,
    )
    return {f.__name__: f for f in found}


def oracle_sql() -> dict[str, str]:
    return {"op1_substring_dedup": substring.SQL, "op3_ngram_jaccard_join": jaccard.SQL, "op4_chat_formatting": chat.SQL, "op7_quality_rules": quality_rules.SQL, "op10_line_dedup": line_dedup.SQL}
