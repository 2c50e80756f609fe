"""The registered queries of the training-data operators, with their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import chat, mixing, near_dedup, nearest, packing, pages, quality, repair_files, rules, toxicity
from .common import table


def op3_dart_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_duplicates(table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = [quality.op1_nnpu_quality, packing.op2_grouping_genetic_packing, op3_dart_minhash, mixing.op4_hash_threshold_mix]
    found += [repair_files.op5_repair_token_files, pages.op6_site_style_tree, nearest.op7_ivfpq_search, rules.op8_risk_controlled_rules]
    found += [chat.op9_linked_chats, toxicity.op10_toxicity_chain]
    return {f.__name__: f for f in found}


def oracle_sql() -> dict[str, str]:
    return {"op3_dart_minhash": near_dedup.classes_sql(), "op4_hash_threshold_mix": mixing.mix_sql(), "op8_risk_controlled_rules": rules.rules_sql()}
