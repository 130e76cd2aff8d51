"""Queries of this subpackage, and their SQL where DuckDB can say the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from kinetia.llm import decontaminate, html_text, language_model, ngram_join, packing, periodic_runs, pii, quality_classifier, quality_rules, simhash, spelling, suffixes, toxicity


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_quality_rules": quality_rules.query,
        "op2_suffixes": suffixes.query,
        "op3_quality_classifier": quality_classifier.query,
        "op4_pii": pii.query,
        "op5_simhash": simhash.query,
        "op6_toxicity": toxicity.query,
        "op7_html_text": html_text.query,
        "op8_packing": packing.query,
        "op9_language_model": language_model.query,
        "op10_decontaminate": decontaminate.query,
        "op11_spelling": spelling.query,
        "op12_ngram_join": ngram_join.query,
        "op13_periodic_runs": periodic_runs.query,
    }


def oracle_sql() -> dict[str, str]:
    return {"op12_ngram_join": ngram_join.ORACLE_SQL}
