"""The queries of this subpackage, and their SQL where SQL can express them."""

from __future__ import annotations

from seepage.llm import bitplanes, chat, decontaminate, divergence, filters, jaccard, lines, mixing, neighbours, pii, ppm, rules, substrings


def queries() -> dict:
    return {
        "op1_line_dedup": lines.op1_line_dedup,
        "op2_pii": pii.op2_pii,
        "op3_jaccard_join": jaccard.op3_jaccard_join,
        "op4_ppm_scores": ppm.op4_ppm_scores,
        "op5_token_files": bitplanes.op5_token_files,
        "op6_quality_rules": rules.op6_quality_rules,
        "op7_decontamination": decontaminate.op7_decontamination,
        "op8_mixing": mixing.op8_mixing,
        "op9_substring_dedup": substrings.op9_substring_dedup,
        "op10_chat_format": chat.op10_chat_format,
        "op11_filter_audit": filters.op11_filter_audit,
        "op12_nearest": neighbours.op12_nearest,
        "op13_source_divergence": divergence.op13_source_divergence,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op1_line_dedup": lines.ORACLE_SQL,
        "op3_jaccard_join": jaccard.ORACLE_SQL,
        "op9_substring_dedup": substrings.ORACLE_SQL,
        "op10_chat_format": chat.ORACLE_SQL,
        "op11_filter_audit": filters.ORACLE_SQL,
        "op13_source_divergence": divergence.ORACLE_SQL,
    }
