"""Names of the queries of this subpackage and their SQL twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tidewater.llm import oracles, queries as q


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    names = ["p2_found", "p2_appended", "p3_found", "p3_segments", "p4_found", "p4_terms", "p7_found", "p7_ranked", "p8_containers", "p8_use", "p9_found", "p9_leaks", "p10_found", "p10_restored"]
    return {name: getattr(q, name) for name in names}


def oracle_sql() -> dict[str, str]:
    return dict(oracles.SQL)
