"""Queries of the training-data operators and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

import corpus_pipeline

from saltmarsh.llm import conversation_repair, exact_dedup, language_id, license_scan, mixing, packing, quality_classifier, quality_rules, simhash, substring_dedup, suffix_dedup, toxicity, whitening


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_exact_dedup": exact_dedup.op1_exact_dedup,
        "op2_packing": packing.op2_packing,
        "op3_toxicity": toxicity.op3_toxicity,
        "op4_suffix_dedup": suffix_dedup.op4_suffix_dedup,
        "op5_license_scan": license_scan.op5_license_scan,
        "op6_language_id": language_id.op6_language_id,
        "op7_simhash": simhash.op7_simhash,
        "op8_mixing": mixing.op8_mixing,
        "op9_quality_rules": quality_rules.op9_quality_rules,
        "op10_quality_classifier": quality_classifier.op10_quality_classifier,
        "op11_whitening": whitening.op11_whitening,
        "op12_substring_dedup": substring_dedup.op12_substring_dedup,
        "op13_conversation_repair": conversation_repair.op13_conversation_repair,
        "pipeline": corpus_pipeline.run,
    }


def oracle_sql() -> dict[str, str]:
    return {"op1_exact_dedup": exact_dedup.ORACLE}
