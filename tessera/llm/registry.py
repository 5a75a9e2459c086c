"""Name to query and oracle SQL for the operators of this subpackage."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tessera.llm import bpe, centroids, contexts, decontaminate, jaccard, phrases, quality, sanitise, secret_scan, sharding, token_counts, tokenbin, warc


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_warc": warc.op1_warc,
        "op2_sharding": sharding.op2_sharding,
        "op3_jaccard_join": jaccard.op3_jaccard_join,
        "op4_decontamination": decontaminate.op4_decontamination,
        "op5_bpe": bpe.op5_bpe,
        "op6_quality_rules": quality.op6_quality_rules,
        "op7_token_binary": tokenbin.op7_token_binary,
        "op8_token_counts": token_counts.op8_token_counts,
        "op9_lm_scoring": contexts.op9_lm_scoring,
        "op10_secret_scans": secret_scan.op10_secret_scans,
        "op11_centroids": centroids.op11_centroids,
        "op12_phrases": phrases.op12_phrases,
        "op13_pii": sanitise.op13_pii,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op1_warc": warc.ORACLE,
        "op4_decontamination": decontaminate.ORACLE,
        "op6_quality_rules": quality.ORACLE,
        "op11_centroids": centroids.ORACLE,
        "op12_phrases": phrases.ORACLE,
    }
