"""The plans of the problems on series: grid (1), implausible readings (5), trailing totals (6)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewater.functions.days import day_number, day_text, figure, parse_day, weekday_number
from tidewater.functions.terms import term_key
from tidewater.operators.grid import complete_grid
from tidewater.operators.latest import latest_by
from tidewater.operators.outliers import level_outliers, move_outliers
from tidewater.operators.rolling import rolling_totals
from tidewater.runtime import table


#: Figures of documents below the first or from the second on are impossible.
IMPOSSIBLE = (0.0, 900_000.0)


def counted_snapshots(spark: SparkSession, sf: str) -> DataFrame:
    """source, day, documents of the counting row of each source and day."""
    raw = table(spark, sf, "trend_snapshot").select("source", parse_day(F.col("date")).alias("day"), figure(F.col("documents")).alias("documents"), "collected_at_utc")
    return latest_by(raw.where(F.col("day").isNotNull()), ["source", "day"], [F.col("collected_at_utc")], ["documents"])


def readings(spark: SparkSession, sf: str) -> DataFrame:
    """The usable readings of the three series, with their period numbers; impossible figures don't take part in the fit."""
    snapshot = counted_snapshots(spark, sf).select(F.lit("snapshot").alias("series"), F.lit("daily").alias("calendar"), F.col("source").alias("entity"), day_number(F.col("day")).alias("period"), F.col("documents").alias("value"), F.lit(None).cast("timestamp").alias("rank_by"))
    status = F.upper(F.regexp_replace(F.col("status"), r"^\s+|\s+$", ""))
    health = table(spark, sf, "source_health").where(status.isin("OK", "EMPTY")).select(F.lit("health").alias("series"), F.lit("daily").alias("calendar"), F.col("source").alias("entity"), day_number(F.to_date("checked_at")).alias("period"), F.coalesce(figure(F.col("documents")), F.lit(0.0)).alias("value"), F.col("checked_at").alias("rank_by"))
    market = table(spark, sf, "market").where(figure(F.col("close")) > 0).select(F.lit("market").alias("series"), F.lit("weekdays").alias("calendar"), F.col("symbol").alias("entity"), weekday_number(F.to_date("quote_ts")).alias("period"), F.col("close").alias("value"), F.col("quote_ts").alias("rank_by"))
    every = snapshot.unionByName(health).unionByName(market)
    return every.withColumn("fits", (F.col("series") == "market") | ((F.col("value") >= IMPOSSIBLE[0]) & (F.col("value") < IMPOSSIBLE[1])))


def grid(spark: SparkSession, sf: str) -> DataFrame:
    """p1: series, entity, day, value, mark for every period between the first and the last reading."""
    return complete_grid(readings(spark, sf)).select("series", "entity", day_text(F.col("period"), F.col("calendar")).alias("day"), "value", "mark")


def grid_gaps(spark: SparkSession, sf: str) -> DataFrame:
    """p1_found: the periods of the grid without a reading."""
    return grid(spark, sf).where(F.col("mark") != "observed").select("series", "entity", "day")


def outliers(spark: SparkSession, sf: str) -> DataFrame:
    """p5: every reading of both series with its flags."""
    snapshot = counted_snapshots(spark, sf).select(F.col("source").alias("entity"), "day", F.col("documents").alias("reading"))
    quotes = table(spark, sf, "market").select(F.col("symbol").alias("entity"), F.to_date("quote_ts").alias("day"), figure(F.col("close")).alias("reading"), "quote_ts")
    market = latest_by(quotes.where(F.col("reading").isNotNull()), ["entity", "day"], [F.col("quote_ts")], ["reading"])
    return level_outliers(snapshot, low=IMPOSSIBLE[0], high=IMPOSSIBLE[1]).withColumn("series", F.lit("snapshot")).unionByName(move_outliers(market).withColumn("series", F.lit("market")))


def outlier_cases(spark: SparkSession, sf: str) -> DataFrame:
    """p5_found: the implausible readings."""
    return outliers(spark, sf).where(F.col("bound") | F.col("spike") | F.col("stuck")).select("series", "entity", F.date_format("day", "yyyy-MM-dd").alias("day"))


def trailing(spark: SparkSession, sf: str, least: dict[str, dict[int, float]] | None = None) -> DataFrame:
    """p6: measure, source, term, day, total7, average7, total30, average30 for every day, silent ones included."""
    least = least or {}
    days = table(spark, sf, "trend_snapshot").select("source", parse_day(F.col("date")).alias("day")).where(F.col("day").isNotNull())
    spans = days.groupBy("source").agg(F.min("day").alias("first"), F.max("day").alias("last"))
    documents = counted_snapshots(spark, sf).select("source", F.lit("").alias("term"), "day", F.col("documents").alias("figure"))
    raw = table(spark, sf, "snapshot_terms").select("source", term_key(F.col("term")).alias("term"), parse_day(F.col("date")).alias("day"), figure(F.col("count")).alias("figure"), "collected_at_utc").where(F.col("day").isNotNull())
    counts = latest_by(raw, ["source", "term", "day"], [F.col("collected_at_utc")], ["figure"])
    parts = [rolling_totals(df, spans, ["source"], ["source", "term"], (7, 30), skip=29, at_least=least.get(name)).withColumn("measure", F.lit(name)) for name, df in (("documents", documents), ("count", counts))]
    return parts[0].unionByName(parts[1])


def trailing_rises(spark: SparkSession, sf: str) -> DataFrame:
    """p6_found: the days on which the week stands out from the month."""
    rows = trailing(spark, sf, {"documents": {7: 1}, "count": {7: 12}})
    times = F.when(F.col("measure") == "documents", 2).otherwise(3)
    return rows.where(30 * F.col("total7") >= times * 7 * F.col("total30")).select("measure", "source", "term", F.date_format("day", "yyyy-MM-dd").alias("day"))
