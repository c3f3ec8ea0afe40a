"""The queries of this subpackage, by name, with SQL where SQL can say the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import decontam, langid, license_scan, lm_score, mpegts, neardup, packing, pii_crf, pipeline, secretscan, toxicity

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_license_scan": license_scan.query,
    "op2_lm_score": lm_score.query,
    "op3_mpeg_ts": mpegts.query,
    "op4_best_fit_packing": packing.query,
    "op5_pii_crf": pii_crf.query,
    "op6_toxicity": toxicity.query,
    "op7_decontamination": decontam.query,
    "op8_near_duplicates": neardup.query,
    "op9_language_id": langid.query,
    "op10_secret_scan": secretscan.query,
    "pipeline": pipeline.run,
}

ORACLE_SQL: dict[str, str] = {"op1_license_scan": license_scan.oracle()}
