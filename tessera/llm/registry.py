"""The numbered queries and the SQL of those that SQL can state."""

from __future__ import annotations

from tessera.llm import bpe, conversation_repair, decontaminate, filter_audit, jaccard_join, language_id, license_scan, line_dedup, quality, token_counts, toxicity, vp_search, warc


def queries() -> dict:
    return {
        "op1_line_dedup": line_dedup.op1_line_dedup,
        "op8_license_scan": license_scan.op8_license_scan,
        "op2_jaccard_join": jaccard_join.op2_jaccard_join,
        "op3_language_id": language_id.op3_language_id,
        "op4_bpe": bpe.op4_bpe,
        "op5_toxicity": toxicity.op5_toxicity,
        "op6_quality": quality.op6_quality,
        "op7_vp_search": vp_search.op7_vp_search,
        "op9_warc": warc.op9_warc,
        "op10_decontaminate": decontaminate.op10_decontaminate,
        "op11_conversation_repair": conversation_repair.op11_conversation_repair,
        "op12_filter_audit": filter_audit.op12_filter_audit,
        "op13_token_counts": token_counts.op13_token_counts,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op1_line_dedup": line_dedup.SQL,
        "op8_license_scan": license_scan.SQL,
        "op2_jaccard_join": jaccard_join.SQL,
        "op7_vp_search": vp_search.SQL,
        "op9_warc": warc.SQL,
        "op10_decontaminate": decontaminate.SQL,
        "op11_conversation_repair": conversation_repair.SQL,
        "op12_filter_audit": filter_audit.SQL,
    }
