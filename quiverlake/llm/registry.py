"""Queries of this subpackage by name, and their SQL where SQL can express them."""

from __future__ import annotations

from quiverlake.llm import decontaminate, jaccard_join, licenses, lm_score, mixing, nearest, quality, secrets, substring_dedup, toxicity


def queries() -> dict:
    return {
        "op1_jaccard_join": jaccard_join.op1_jaccard_join,
        "op2_secret_scan": secrets.op2_secret_scan,
        "op3_substring_dedup": substring_dedup.op3_substring_dedup,
        "op4_quality": quality.op4_quality,
        "op5_mixing": mixing.op5_mixing,
        "op6_toxicity": toxicity.op6_toxicity,
        "op7_decontamination": decontaminate.op7_decontamination,
        "op8_license_scan": licenses.op8_license_scan,
        "op9_nearest": nearest.op9_nearest,
        "op10_lm_score": lm_score.op10_lm_score,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op1_jaccard_join": jaccard_join.ORACLE_SQL,
        "op2_secret_scan": secrets.ORACLE_SQL,
        "op3_substring_dedup": substring_dedup.ORACLE_SQL,
        "op5_mixing": mixing.ORACLE_SQL,
        "op7_decontamination": decontaminate.ORACLE_SQL,
        "op8_license_scan": licenses.ORACLE_SQL,
    }
