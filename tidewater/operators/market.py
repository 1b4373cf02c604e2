"""Indicators of daily price series by window frames over each symbol's own rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidewater.functions.days import figure
from tidewater.operators.latest import latest_by


def in_order():
    """Each symbol's days, oldest first."""
    return W.partitionBy("symbol").orderBy("day")


def newest_first():
    """Each symbol's days, newest first."""
    return W.partitionBy("symbol").orderBy(F.desc("day"))


def daily_closes(quotes: DataFrame) -> DataFrame:
    """symbol, day, close: the last usable close of each day, rounded to 4 places."""
    usable = quotes.where(figure(F.col("close")) > 0).select("symbol", F.to_date("quote_ts").alias("day"), F.round("close", 4).alias("close"), "quote_ts")
    return latest_by(usable, ["symbol", "day"], [F.col("quote_ts")], ["close"])


def numbered(closes: DataFrame) -> DataFrame:
    """Adds ``n``: 1 for a symbol's newest day."""
    return closes.withColumn("n", F.row_number().over(newest_first()))


def averages(closes: DataFrame, windows: tuple[int, ...] = (20, 50)) -> DataFrame:
    """symbol, sma{w}: means of the last w closes; NULL with fewer."""
    rows = numbered(closes)
    cols = [F.when(F.count_if(F.col("n") <= w) == w, F.round(F.avg(F.when(F.col("n") <= w, F.col("close"))), 4)).alias(f"sma{w}") for w in windows]
    return rows.groupBy("symbol").agg(*cols)


def returns(closes: DataFrame, days: int = 20) -> DataFrame:
    """symbol, return_20d_pct: the change over ``days`` rows."""
    rows = numbered(closes).where(F.col("n").isin(1, days + 1))
    last, first = F.max(F.when(F.col("n") == 1, F.col("close"))), F.max(F.when(F.col("n") == days + 1, F.col("close")))
    return rows.groupBy("symbol").agg(F.round((last / first - 1) * 100, 3).alias(f"return_{days}d_pct"))


def volatility(closes: DataFrame, rows: int = 19, least: int = 10) -> DataFrame:
    """symbol, volatility: the sample deviation of the last daily returns, per year, in percent; NULL with too few."""
    steps = closes.withColumn("step", F.col("close") / F.lag("close").over(in_order()) - 1).withColumn("n", F.row_number().over(newest_first())).where(F.col("n") <= rows)
    value = F.round(F.stddev_samp("step") * F.sqrt(F.lit(252.0)) * 100, 3)
    return steps.groupBy("symbol").agg(F.when(F.count("step") >= least, value).alias("volatility_20d_annualized_pct"))


def drawdown(closes: DataFrame, rows: int = 90) -> DataFrame:
    """symbol, drawdown: the deepest fall below the running peak of the last ``rows`` closes, in percent."""
    last = numbered(closes).where(F.col("n") <= rows)
    peak = F.max("close").over(in_order().rowsBetween(W.unboundedPreceding, 0))
    fallen = last.withColumn("fall", (F.col("close") / peak - 1) * 100)
    return fallen.groupBy("symbol").agg(F.round(F.least(F.lit(0.0), F.min("fall")), 3).alias("max_drawdown_90d_pct"))


def indicators(closes: DataFrame) -> DataFrame:
    """All indicators of every symbol. The four parts share one partitioning by symbol."""
    out = averages(closes)
    for part in (returns(closes), volatility(closes), drawdown(closes)):
        out = out.join(part, "symbol", "left")
    return out


def tail(closes: DataFrame, rows: int = 180) -> DataFrame:
    """The last ``rows`` closes of every symbol."""
    return numbered(closes).where(F.col("n") <= rows).select("symbol", "day", "close")


def ages(closes: DataFrame, as_of, most: int = 5) -> DataFrame:
    """symbol, day, status: whether the newest close is recent, stale, or in the future."""
    age = F.datediff(F.lit(as_of), F.col("day"))
    status = F.when(F.col("day").isNull() | (age < 0), "INVALID").when(age <= most, "CURRENT_DAILY").otherwise("STALE")
    return closes.groupBy("symbol").agg(F.max("day").alias("day")).select("symbol", "day", status.alias("status"))
