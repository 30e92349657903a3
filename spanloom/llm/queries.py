"""The queries of this subpackage by name, and their SQL twins where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from spanloom.llm import decontamination, exact_dedup, language_id, license_scan, merkle, mixing, near_duplicates, periodic_runs, quality, quotation, secret_scan, token_shards, toxicity

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_language_id": language_id.op1_language_id,
    "op2_license_scan": license_scan.op2_license_scan,
    "op3_token_shards": token_shards.op3_token_shards,
    "op4_near_duplicates": near_duplicates.op4_near_duplicates,
    "op5_quality": quality.op5_quality,
    "op6_toxicity": toxicity.op6_toxicity,
    "op7_exact_dedup": exact_dedup.op7_exact_dedup,
    "op8_decontamination": decontamination.op8_decontamination,
    "op9_quotation": quotation.op9_quotation,
    "op10_mixing": mixing.op10_mixing,
    "op11_periodic_runs": periodic_runs.op11_periodic_runs,
    "op12_secret_scan": secret_scan.op12_secret_scan,
    "op13_merkle": merkle.op13_merkle,
}
ORACLES: dict[str, str] = {
    "op4_near_duplicates": near_duplicates.OP4_SQL,
    "op7_exact_dedup": exact_dedup.OP7_SQL,
    "op8_decontamination": decontamination.OP8_SQL,
    "op10_mixing": mixing.OP10_SQL,
    "op12_secret_scan": secret_scan.OP12_SQL,
    "op13_merkle": merkle.OP13_SQL,
}
