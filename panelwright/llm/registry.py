"""The queries of this subpackage and their SQL, by name."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import decontaminate, exact_dedup, lm_score, mixing, near_dedup, secrets, suffix_dedup, token_store, tokens, toxicity


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_decontaminate": decontaminate.op1_decontaminate,
        "op2_lm_score": lm_score.op2_lm_score,
        "op3_token_counts": tokens.op3_token_counts,
        "op4_token_store": token_store.op4_token_store,
        "op5_exact_dedup": exact_dedup.op5_exact_dedup,
        "op6_toxicity": toxicity.op6_toxicity,
        "op7_near_dedup": near_dedup.op7_near_dedup,
        "op8_suffix_dedup": suffix_dedup.op8_suffix_dedup,
        "op9_secrets": secrets.op9_secrets,
        "op10_mix_sources": mixing.op10_mix_sources,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op1_decontaminate": decontaminate.OP1_SQL,
        "op5_exact_dedup": exact_dedup.OP5_SQL,
        "op10_mix_sources": mixing.OP10_SQL,
    }
