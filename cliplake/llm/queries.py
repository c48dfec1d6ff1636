"""Queries of the llm operators and, where SQL can say the same, their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from cliplake.llm import language, packing, runs, subjects, tokens, truncation, turns, unify


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "p2_found": language.p2_found,
        "p2_languages": language.p2_languages,
        "p4_found": turns.p4_found,
        "p5_found": unify.p5_found,
        "p5_forms": unify.p5_forms,
        "p6_found": truncation.p6_found,
        "p6_rates": truncation.p6_rates,
        "p7_found": runs.p7_found,
        "p7_runs": runs.p7_runs,
        "p8_ids": tokens.p8_ids,
        "p9_containers": packing.p9_containers,
        "p9_fill": packing.p9_fill,
        "p10_found": subjects.p10_found,
        "p10_shares": subjects.p10_shares,
        "p10_composition": subjects.p10_composition,
    }


def oracle_sql() -> dict[str, str]:
    return {"p5_found": unify.P5_SQL, "p7_found": runs.P7_SQL}
