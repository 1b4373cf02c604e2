"""Names of the core queries and their SQL twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewater.plans import oracles, reference, series

FLAGSHIP = "accel_top5"


def _days_as_text(query: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    """The query with its DATE columns as yyyy-MM-dd."""

    def run(spark: SparkSession, sf: str) -> DataFrame:
        df = query(spark, sf)
        return df.withColumns({c: F.date_format(c, "yyyy-MM-dd") for c, kind in df.dtypes if kind == "date"})

    return run


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    plain = {
        "p1_found": series.grid_gaps,
        "p1_grid": series.grid,
        "p5_found": series.outlier_cases,
        "p5_flags": series.outliers,
        "p6_found": series.trailing_rises,
        "p6_totals": series.trailing,
        **reference.QUERIES,
    }
    return {name: _days_as_text(query) for name, query in plain.items()}


def oracle_sql() -> dict[str, str]:
    return dict(oracles.SQL)
