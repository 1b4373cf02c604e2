"""Irregular readings onto a regular grid, gaps filled by a low-rank factorisation of the source-by-time matrix.

Alternating least squares: with the factors of the periods fixed, every source's factors are solved from its own row, so
sources never meet; with those fixed, the normal equations of each period are summed over the partitions. The period
factors are periods x rank numbers (periods of the calendar, not rows of the input), so they may be held by the driver and
sent to every task. Rows are worked on in blocks, as matrices. Observed cells stay as they are, only missing cells between
the first and the last observed one of a source are filled, and cells whose row or column has too few readings stay marked
``unsupported``.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewater.runtime import written

SERIES_SCHEMA = "series string, calendar string, entity string, p array<int>, v array<double>, f array<boolean>"
GRID_SCHEMA = "series string, calendar string, entity string, period int, value double, mark string"
#: Cells of a block, which bounds a task's memory.
CELLS = 1_000_000


def _start(periods: np.ndarray, rank: int) -> np.ndarray:
    """Fixed starting factors of periods: a constant, and waves of the week and longer ones."""
    waves = [np.ones(len(periods))]
    for k in range(1, rank):
        turn = 2 * np.pi * periods / (7.0 * (1 + (k - 1) // 2))
        waves.append(np.sin(turn) if k % 2 else np.cos(turn))
    return np.stack(waves, axis=1)


def pack_series(readings: DataFrame) -> DataFrame:
    """series, calendar, entity, p, v, f: one row per entity with its readings in period order.

    readings: series, calendar, entity, period INT, value DOUBLE, ``rank_by`` (of several readings in a period the one with
    the greatest counts) and, if given, ``fits`` (whether the reading is plausible enough to take part in the fit). Rows
    with a NULL period or a value that is no figure are left out. Rows are first reduced to one per entity and period on
    the map side; an array's length is bounded by the calendar.
    """
    if "fits" not in readings.columns:
        readings = readings.withColumn("fits", F.lit(True))
    usable = readings.where(F.col("period").isNotNull() & F.col("value").isNotNull() & ~F.isnan("value"))
    cells = usable.groupBy("series", "calendar", "entity", "period").agg(F.max(F.struct("rank_by", "value", F.coalesce("fits", F.lit(False)).alias("fits"))).alias("best"))
    packed = cells.groupBy("series", "calendar", "entity").agg(F.array_sort(F.collect_list(F.struct("period", F.col("best.value").alias("value"), F.col("best.fits").alias("fits")))).alias("cells"))
    return packed.select("series", "calendar", "entity", F.col("cells.period").alias("p"), F.col("cells.value").alias("v"), F.col("cells.fits").alias("f"))


@dataclass
class Block:
    """Some rows of one series as matrices over the periods from ``begin`` on: values, whether observed, whether fitted;
    and the scaled values of what is fitted (0 elsewhere), with each row's mean and spread on the damped scale."""

    frame: pd.DataFrame
    begin: int
    value: np.ndarray
    seen: np.ndarray
    fit: np.ndarray
    scaled: np.ndarray
    mean: np.ndarray
    spread: np.ndarray

    def row_factors(self, basis: np.ndarray, ridge: float) -> tuple[np.ndarray, np.ndarray]:
        """The factors of all rows by least squares, and the products of each pair of them. NaN in the basis is no factor."""
        known = ~np.isnan(basis[:, 0])
        basis, rank = np.where(known[:, None], basis, 0.0), basis.shape[1]
        products = (basis[:, :, None] * basis[:, None, :]).reshape(len(basis), -1)
        left = (self.fit.astype(float) @ products).reshape(-1, rank, rank) + ridge * np.eye(rank)
        u = np.linalg.solve(left, (self.scaled @ basis)[:, :, None])[:, :, 0]
        return u, (u[:, :, None] * u[:, None, :]).reshape(len(u), -1)


def _blocks(batch: pd.DataFrame) -> Iterator[Block]:
    for _, rows in batch.groupby("series", dropna=False, sort=False):
        begin = int(min(p[0] for p in rows["p"]))
        width = int(max(p[-1] for p in rows["p"])) - begin + 1
        step = max(1, CELLS // width)
        for lo in range(0, len(rows), step):
            part = rows.iloc[lo : lo + step]
            sizes = np.array([len(p) for p in part["p"]])
            at = np.repeat(np.arange(len(part)), sizes), np.concatenate(part["p"].to_list()).astype(int) - begin
            value = np.zeros((len(part), width))
            seen, fit = np.zeros(value.shape, dtype=bool), np.zeros(value.shape, dtype=bool)
            value[at], seen[at] = np.concatenate(part["v"].to_list()), True
            fit[at] = np.concatenate(part["f"].to_list()).astype(bool)
            damped = np.where(fit, np.arcsinh(value), 0.0)
            n = np.maximum(1, fit.sum(axis=1))[:, None]
            mean = damped.sum(axis=1, keepdims=True) / n
            centred = np.where(fit, damped - mean, 0.0)
            spread = np.sqrt((centred**2).sum(axis=1, keepdims=True) / n)
            spread = np.where(spread > 1e-9, spread, 1.0)
            yield Block(part, begin, value, seen, fit, centred / spread, mean, spread)


def complete_grid(readings: DataFrame, *, rank: int = 3, rounds: int = 10, tolerance: float = 0.01, ridge: float = 0.1, least_row: int = 6, least_column: int = 6, clip: bool = False) -> DataFrame:
    """Every period between the first and the last reading of every entity, with a value or a mark.

    Returns series, calendar, entity, period, value, mark: ``observed`` (value as read), ``filled`` (estimated), or
    ``unsupported`` (value NULL; fewer than ``least_row`` fitted readings in the row or ``least_column`` in the column).
    Rounds go on until the squared error falls by less than the share ``tolerance``, ``rounds`` at most. ``clip`` keeps
    fills within the range of their row's fitted readings. An entity with a single reading gives that one row; entities
    with a NULL name form one series; an empty table gives an empty one. Several series are factorised side by side, each
    with its own period factors.
    """
    series = written(pack_series(readings), "series")
    factors: dict[str | None, tuple[int, np.ndarray]] = {}

    def basis(name: str | None, begin: int, width: int) -> np.ndarray:
        """The factors of the periods from ``begin`` on, NaN where there are none; starting ones before the first round."""
        if not factors:
            return _start(np.arange(begin, begin + width), rank)
        out = np.full((width, rank), np.nan)
        if name in factors:
            first, known = factors[name]
            lo, hi = max(begin, first), min(begin + width, first + len(known))
            if lo < hi:
                out[lo - begin : hi - begin] = known[lo - first : hi - first]
        return out

    def sums(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for b in _blocks(batch):
                name, enough = b.frame["series"].iloc[0], b.fit.sum(axis=1) >= least_row
                base = basis(name, b.begin, b.value.shape[1])
                u, products = b.row_factors(base, ridge)
                fit = b.fit & enough[:, None]
                held = fit & ~np.isnan(base[:, 0])
                error = np.where(held, b.scaled - u @ np.nan_to_num(base).T, 0.0)
                s = np.hstack([fit.T.astype(float) @ products, np.where(fit, b.scaled, 0.0).T @ u, fit.sum(axis=0)[:, None], (error**2).sum(axis=0)[:, None]])
                used = np.nonzero(fit.any(axis=0))[0]
                if len(used):
                    yield pd.DataFrame({"series": name, "period": (b.begin + used).astype("int32"), "s": list(s[used])})

    width, before = rank * rank + rank + 2, None
    for _ in range(rounds):
        parts = series.mapInPandas(sums, "series string, period int, s array<double>")
        summed = parts.groupBy("series", "period").agg(*[F.sum(F.col("s")[i]).alias(f"s{i}") for i in range(width)]).collect()  # one row per period
        by: dict[str | None, list] = {}
        for row in summed:
            by.setdefault(row[0], []).append(row[1:])
        fresh = {}
        for name, rows in by.items():
            a = np.array(rows, dtype=float)
            period, n = a[:, 0].astype(int), a[:, -2]
            solved = np.linalg.solve(a[:, 1 : 1 + rank * rank].reshape(-1, rank, rank) + ridge * np.eye(rank), a[:, 1 + rank * rank : -2, None])[:, :, 0]
            solved[n < least_column] = np.nan
            known = np.full((period.max() - period.min() + 1, rank), np.nan)
            known[period - period.min()] = solved
            fresh[name] = (int(period.min()), known)
        factors = fresh
        error = sum(row[-1] for row in summed)
        if not fresh or (before is not None and before - error < tolerance * before):
            break
        before = error

    def fill(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for b in _blocks(batch):
                base = basis(b.frame["series"].iloc[0], b.begin, b.value.shape[1]) if factors else np.full((b.value.shape[1], rank), np.nan)
                known = ~np.isnan(base[:, 0])
                u, _ = b.row_factors(base, ridge)
                with np.errstate(over="ignore"):
                    guess = np.sinh((u @ np.nan_to_num(base).T) * b.spread + b.mean)
                if clip:
                    lo = np.where(b.fit, b.value, np.inf).min(axis=1, keepdims=True)
                    guess = np.minimum(np.where(b.fit, b.value, -np.inf).max(axis=1, keepdims=True), np.maximum(lo, guess))
                rich = (b.fit & known).sum(axis=1) >= least_row
                filled = ~b.seen & known & rich[:, None] & np.isfinite(guess)
                value = np.where(b.seen, b.value, np.where(filled, guess, np.nan))
                mark = np.where(b.seen, "observed", np.where(filled, "filled", "unsupported"))
                first = b.seen.argmax(axis=1)
                last = b.seen.shape[1] - 1 - b.seen[:, ::-1].argmax(axis=1)
                t = np.arange(b.seen.shape[1])
                row, at = np.nonzero((t >= first[:, None]) & (t <= last[:, None]))
                yield pd.DataFrame({k: b.frame[k].to_numpy()[row] for k in ("series", "calendar", "entity")} | {"period": (b.begin + at).astype("int32"), "value": value[row, at], "mark": mark[row, at]})

    grid = series.mapInPandas(fill, GRID_SCHEMA)
    return grid.withColumn("value", F.when(F.isnan("value"), F.lit(None)).otherwise(F.col("value")))
