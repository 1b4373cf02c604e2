"""Totals and averages over trailing periods by block decomposition.

Days are cut into blocks as long as the window. Inside each block prefix and suffix sums are kept; a trailing total is
then one suffix of the earlier block plus one prefix of the block of the day, whatever the window's length, and no sum is
ever subtracted, so figures are exact for whole numbers.

Rows are pre-aggregated to one figure per entity and day before the shuffle, and an entity's figures travel as one sparse
array, whose length is bounded by the number of days, not of rows.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Cells of one dense piece in a worker; bounds the memory, not the result.
CELLS = 2_000_000


def trailing_totals(dense: np.ndarray, window: int) -> np.ndarray:
    """Totals over the ``window`` columns up to and with each column, for each row of ``dense``; short at the start."""
    rows, days = dense.shape
    blocks = -(-days // window)
    padded = np.zeros((rows, blocks * window))
    padded[:, :days] = dense
    cut = padded.reshape(rows, blocks, window)
    prefix = np.cumsum(cut, axis=2).reshape(rows, -1)
    suffix = np.cumsum(cut[:, :, ::-1], axis=2)[:, :, ::-1].reshape(rows, -1)
    total = prefix.copy()
    at = np.arange(blocks * window)
    crossing = (at % window != window - 1) & (at >= window)
    total[:, crossing] += suffix[:, at[crossing] - window + 1]
    return total[:, :days]


def rolling_totals(figures: DataFrame, spans: DataFrame, span_keys: Sequence[str], keys: Sequence[str], windows: Sequence[int] = (7, 30), *, skip: int = 0, at_least: dict[int, float] | None = None) -> DataFrame:
    """Trailing totals and averages of every entity for every day of its span, silent days included.

    figures: ``keys``, ``day`` DATE, ``figure``; missing and negative figures count as 0, rows of one entity and day add up.
    spans: ``span_keys`` (a subset of ``keys``), ``first`` and ``last`` DATE; one row per key. The result starts ``skip``
    days after ``first``. at_least: per window the least total of the rows that are returned.

    Returns keys, day DATE, and total{w}, average{w} per window. Entities without a span have no rows; rows whose day is
    NULL or outside the span are ignored; extra columns are ignored; an empty table gives an empty one.
    """
    value = F.when(F.col("figure") > 0, F.col("figure").cast("double")).otherwise(0.0)
    daily = figures.where(F.col("day").isNotNull()).groupBy(*keys, "day").agg(F.sum(value).alias("figure"))
    packed = daily.groupBy(*keys).agg(F.collect_list(F.struct(F.unix_date("day").alias("d"), F.col("figure").alias("v"))).alias("cells"))
    named = spans.select(*[F.col(k).alias(f"span__{k}") for k in span_keys], F.unix_date("first").alias("first__"), F.unix_date("last").alias("last__"))
    on = [F.col(k).eqNullSafe(F.col(f"span__{k}")) for k in span_keys]
    ready = packed.join(named, on, "inner").select(*keys, "first__", "last__", F.transform("cells", lambda c: c["d"]).alias("d__"), F.transform("cells", lambda c: c["v"]).alias("v__"))
    floors = dict(at_least or {})
    wins = list(windows)

    def roll(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            length = (batch["last__"] - batch["first__"] + 1).clip(lower=0).to_numpy()
            step = max(1, CELLS // max(1, int(length.max()) if len(length) else 1))
            for lo in range(0, len(batch), step):
                part, size = batch.iloc[lo : lo + step], length[lo : lo + step]
                days = int(size.max())
                if days <= skip:
                    continue
                dense = np.zeros((len(part), days))
                counts = np.array([len(x) for x in part["d__"]])
                row = np.repeat(np.arange(len(part)), counts)
                col = np.concatenate(part["d__"].to_numpy()) - part["first__"].to_numpy()[row]
                inside = (col >= 0) & (col < size[row])
                dense[row[inside], col[inside]] = np.concatenate(part["v__"].to_numpy())[inside]
                totals = {w: trailing_totals(dense, w) for w in wins}
                at = np.arange(days)
                keep = (at >= skip)[None, :] & (at[None, :] < size[:, None])
                for w, least in floors.items():
                    keep &= totals[w] >= least
                r, c = np.nonzero(keep)
                if not len(r):
                    continue
                out = {k: part[k].to_numpy()[r] for k in keys}
                out["day__"] = part["first__"].to_numpy()[r] + c
                for w in wins:
                    out[f"total{w}"] = totals[w][r, c]
                    out[f"average{w}"] = out[f"total{w}"] / w
                yield pd.DataFrame(out)

    kinds = dict(figures.dtypes)
    schema = ", ".join([f"`{k}` {kinds[k]}" for k in keys] + ["day__ int"] + [f"total{w} double, average{w} double" for w in wins])
    return ready.mapInPandas(roll, schema).select(*keys, F.date_from_unix_date("day__").alias("day"), *[x for w in wins for x in (f"total{w}", f"average{w}")])
