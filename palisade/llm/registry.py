"""The queries of this subpackage and, where SQL can express them, the same in DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from palisade.llm import backoff, binary_tokens, decontaminate, fim, fingerprints, html_text, lines, neardup, packing, phrases, quality, substrings, toxicity
from palisade.llm.scratch import small_batches

_MODULES = {
    "op1_decontaminate": decontaminate,
    "op2_quality": quality,
    "op3_fingerprints": fingerprints,
    "op4_neardup": neardup,
    "op5_packing": packing,
    "op6_substrings": substrings,
    "op7_lines": lines,
    "op8_html_text": html_text,
    "op9_toxicity": toxicity,
    "op10_backoff": backoff,
    "op11_phrases": phrases,
    "op12_fim": fim,
    "op13_token_files": binary_tokens,
}


def _query(module) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        small_batches(spark)
        return module.query(spark, sf_dir)

    return run


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: _query(module) for name, module in _MODULES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: module.SQL for name, module in _MODULES.items() if getattr(module, "SQL", None)}
