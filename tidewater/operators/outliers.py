"""Implausible readings: physical bounds, spikes by a rolling median and median absolute deviation, stuck values."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

MAD_TO_SIGMA = 1.4826


def _median(a: Column) -> Column:
    """The median of an array without NULLs; NULL for an empty one."""
    s, n = F.array_sort(a), F.size(a)
    hi = F.try_element_at(s, (F.floor(n / 2) + 1).cast("int"))
    return F.when(n % 2 == 1, hi).when(n > 0, (F.try_element_at(s, F.greatest(F.lit(1), F.floor(n / 2)).cast("int")) + hi) / 2)


def _runs(valid: DataFrame, run: int, habit: float) -> DataFrame:
    """Adds ``stuck``: the reading is in a run of ``run`` or more equal consecutive readings, outside of which the entity
    repeats its value on less than the share ``habit`` of its readings."""
    order = W.partitionBy("entity").orderBy("day")
    step = F.coalesce((F.col("reading") != F.lag("reading").over(order)).cast("int"), F.lit(1))
    marked = valid.withColumn("step__", step)
    marked = marked.withColumn("run__", F.sum("step__").over(order.rowsBetween(W.unboundedPreceding, 0)))
    whole = W.partitionBy("entity")
    marked = marked.withColumn("long__", F.count("*").over(W.partitionBy("entity", "run__"))).withColumn("n__", F.count("*").over(whole)).withColumn("same__", F.count("*").over(whole) - F.sum("step__").over(whole))
    elsewhere = (F.col("same__") - (F.col("long__") - 1)) / F.greatest(F.col("n__") - F.col("long__"), F.lit(1))
    return marked.withColumn("stuck", (F.col("long__") >= run) & (elsewhere < habit)).drop("step__", "run__", "long__", "n__", "same__")


def level_outliers(readings: DataFrame, *, low: float = 0.0, high: float = 900_000.0, half: int = 7, factor: float = 4.0, gap: float = 10.0, hampel: float = 3.0, run: int = 5, habit: float = 0.15, least_level: float = 10.0) -> DataFrame:
    """Flags readings of counting series against the usual behaviour of their own source.

    readings: entity, day DATE, reading DOUBLE; one row per entity and day (NULL and NaN readings are dropped before).
    ``bound``: below ``low``, or ``high`` and more. ``spike``: outside the Hampel band (``hampel`` deviations of the
    rolling median over ``half`` readings to each side, the reading itself left out), at least ``factor`` times or at most
    1/``factor`` of that median and ``gap`` off. ``stuck``: see :func:`_runs`, only where the entity's median is
    ``least_level`` or more. Impossible readings take no part in medians and runs.

    Returns entity, day, reading, level, bound, spike, stuck for every reading. A source's readings are at most one per
    day, so no window grows with repeated rows. Lone readings have no level and are only checked for bounds.
    """
    base = readings.select("entity", "day", "reading").where(F.col("reading").isNotNull() & ~F.isnan("reading") & F.col("day").isNotNull())
    impossible = (F.col("reading") < low) | (F.col("reading") >= high)
    order = W.partitionBy("entity").orderBy("day")
    valid = base.where(~impossible)
    around = F.concat(F.collect_list("reading").over(order.rowsBetween(-half, -1)), F.collect_list("reading").over(order.rowsBetween(1, half)))
    valid = valid.withColumn("around__", around).withColumn("level", _median(F.col("around__")))
    valid = valid.withColumn("mad__", _median(F.transform("around__", lambda x: F.abs(x - F.col("level")))))
    off = F.abs(F.col("reading") - F.col("level"))
    far = (F.col("reading") >= factor * F.col("level")) | (F.col("reading") * factor <= F.col("level"))
    spike = F.coalesce((off >= gap) & far & (off > hampel * MAD_TO_SIGMA * F.col("mad__")), F.lit(False))
    valid = _runs(valid.withColumn("spike", spike), run, habit)
    usual = F.percentile("reading", 0.5).over(W.partitionBy("entity"))
    valid = valid.withColumn("stuck", F.col("stuck") & (usual >= least_level))
    cols = ["entity", "day", "reading", "level", "bound", "spike", "stuck"]
    return valid.withColumn("bound", F.lit(False)).select(cols).unionByName(base.where(impossible).select("entity", "day", "reading", F.lit(None).cast("double").alias("level"), F.lit(True).alias("bound"), F.lit(False).alias("spike"), F.lit(False).alias("stuck")))


def move_outliers(readings: DataFrame, *, times: float = 12.0, run: int = 5, habit: float = 0.15) -> DataFrame:
    """Flags readings of price-like series against the usual daily move of their own symbol.

    readings: entity, day DATE, reading DOUBLE; one row per entity and day. ``bound``: 0 or less. ``spike``: away from the
    reading before and the one after, in the same direction, by more than ``times`` the median of the entity's moves
    that are not 0 (a symbol that never moves has no spikes). ``stuck``: see :func:`_runs`. A lasting jump is away from one
    side only. Returns entity, day, reading, level (the usual move), bound, spike, stuck for every reading.
    """
    base = readings.select("entity", "day", "reading").where(F.col("reading").isNotNull() & ~F.isnan("reading") & F.col("day").isNotNull())
    valid = base.where(F.col("reading") > 0)
    order = W.partitionBy("entity").orderBy("day")
    valid = valid.withColumn("before__", F.col("reading") - F.lag("reading").over(order)).withColumn("after__", F.col("reading") - F.lead("reading").over(order))
    valid = valid.withColumn("level", F.percentile(F.when(F.col("before__") != 0, F.abs("before__")), 0.5).over(W.partitionBy("entity")))
    least = F.least(F.abs("before__"), F.abs("after__"))
    spike = F.coalesce(F.col("before__").isNotNull() & F.col("after__").isNotNull() & (F.col("before__") * F.col("after__") > 0) & (least > times * F.col("level")), F.lit(False))
    valid = _runs(valid.withColumn("spike", spike), run, habit)
    cols = ["entity", "day", "reading", "level", "bound", "spike", "stuck"]
    return valid.withColumn("bound", F.lit(False)).select(cols).unionByName(base.where(F.col("reading") <= 0).select("entity", "day", "reading", F.lit(None).cast("double").alias("level"), F.lit(True).alias("bound"), F.lit(False).alias("spike"), F.lit(False).alias("stuck")))
