"""The queries of this subpackage, one per operator, and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import chat, hard_negatives, langid, licenses, mix, pii, point_in_time, quality_knn, quality_rules, simhash_cover, suffix_dedup, toxicity, winnow

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_quality_neighbours": quality_knn.query,
    "op2_chat_snapshots": chat.query,
    "op3_license_patience": licenses.query,
    "op4_winnowing_decontamination": winnow.query,
    "op5_systematic_mixing": mix.query,
    "op6_anchor_pii": pii.query,
    "op7_quality_cascade": quality_rules.query,
    "op8_language_bytes": langid.query,
    "op9_toxicity_conv": toxicity.query,
    "op10_simhash_anchor_cover": simhash_cover.query,
    "op11_point_in_time": point_in_time.query,
    "op12_hard_negatives": hard_negatives.query,
    "op13_suffix_ranks": suffix_dedup.query,
}

ORACLE_SQL: dict[str, str] = {
    "op2_chat_snapshots": chat.SQL,
    "op4_winnowing_decontamination": winnow.SQL,
    "op5_systematic_mixing": mix.SQL,
    "op7_quality_cascade": quality_rules.SQL,
    "op11_point_in_time": point_in_time.SQL,
    "op12_hard_negatives": hard_negatives.SQL,
    "op13_suffix_ranks": suffix_dedup.SQL,
}
