"""The corpus operators' queries and their SQL, for ``__spark_entry__``."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from wardloom.llm import bpe, chat, dialogue_repair, near_dedup, oracles, packing, quality_mil, runs, sharding, simhash, token_store, toxicity
from wardloom.llm.common import table
from wardloom.llm.line_dedup import dedup_lines
from wardloom.llm.quality_rules import apply_quality_rules

Query = Callable[[SparkSession, str], DataFrame]


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return apply_quality_rules(table(spark, sf_dir, "documents").select("doc_id", "text")).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"
    )


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "n_lines", "n_removed", "text")


def queries() -> dict[str, Query]:
    return {
        "op1_quality_rules": op1_quality_rules,
        "op2_fingerprints": simhash.query,
        "op3_near_dedup": near_dedup.query,
        "op4_packing": packing.query,
        "op5_chat": chat.query,
        "op6_line_dedup": op6_line_dedup,
        "op7_token_store": token_store.query,
        "op8_bpe": bpe.query,
        "op9_sharding": sharding.query,
        "op10_quality_mil": quality_mil.query,
        "op11_runs": runs.query,
        "op12_dialogue_repair": dialogue_repair.query,
        "op13_toxicity": toxicity.query,
    }


def oracle_sql() -> dict[str, str]:
    """The others hash, tokenize or train; tests hold them against plain versions."""
    return {
        "op1_quality_rules": oracles.quality_rules(),
        "op3_near_dedup": oracles.near_components(),
        "op5_chat": oracles.chat_windows(),
        "op6_line_dedup": oracles.line_dedup(),
        "op12_dialogue_repair": oracles.dialogue_repair(),
    }
