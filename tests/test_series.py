"""Grid, implausible readings and trailing totals against brute force, and on awkward input."""

import datetime as dt

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tidewater.operators.grid import complete_grid
from tidewater.operators.latest import latest_by
from tidewater.operators.outliers import level_outliers, move_outliers
from tidewater.operators.rolling import rolling_totals, trailing_totals
from pyspark.sql import functions as F

DAY0 = dt.date(2025, 1, 6)
READINGS = "series string, calendar string, entity string, period int, value double, rank_by timestamp"


def day(i):
    return DAY0 + dt.timedelta(days=i)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 50), min_size=1, max_size=90), st.sampled_from([1, 2, 7, 30]))
def test_block_decomposition_equals_direct_sums(values, window):
    direct = [sum(values[max(0, i - window + 1) : i + 1]) for i in range(len(values))]
    assert trailing_totals(np.array([values], dtype=float), window)[0].tolist() == direct


def test_rolling_covers_silent_days_nulls_and_negatives(spark):
    rows = [("a", day(0), 5.0), ("a", day(0), 1.0), ("a", day(3), None), ("a", day(4), -2.0), ("a", day(9), 4.0), ("a", None, 9.0), ("b", day(1), 3.0), (None, day(0), 1.0)]
    figures = spark.createDataFrame(rows, "source string, day date, figure double").withColumn("total7", F.lit("clash"))
    spans = spark.createDataFrame([("a", day(0), day(9)), (None, day(0), day(1))], "source string, first date, last date")
    got = {(r.source, r.day): (r.total7, r.average7) for r in rolling_totals(figures, spans, ["source"], ["source"], (7,)).collect()}
    assert len(got) == 12
    assert got["a", day(6)] == (6.0, 6.0 / 7)
    assert got["a", day(7)] == (0.0, 0.0)
    assert got["a", day(9)][0] == 4.0
    assert got[None, day(1)][0] == 1.0


def test_rolling_of_nothing(spark):
    figures = spark.createDataFrame([], "source string, day date, figure double")
    spans = spark.createDataFrame([], "source string, first date, last date")
    assert rolling_totals(figures, spans, ["source"], ["source"]).count() == 0


def test_rolling_threshold_drops_only_rows_below(spark):
    figures = spark.createDataFrame([("a", day(i), float(i)) for i in range(40)], "source string, day date, figure double")
    spans = spark.createDataFrame([("a", day(0), day(39))], "source string, first date, last date")
    full = rolling_totals(figures, spans, ["source"], ["source"]).where("total7 >= 100")
    cut = rolling_totals(figures, spans, ["source"], ["source"], at_least={7: 100})
    assert sorted(full.collect()) == sorted(cut.collect())


def brute_level(values):
    """Spikes of a series by the definition, without windows of the engine."""
    out = []
    for i, v in enumerate(values):
        around = values[max(0, i - 7) : i] + values[i + 1 : i + 8]
        if not around:
            out.append(False)
            continue
        med = float(np.median(around))
        mad = float(np.median([abs(x - med) for x in around]))
        out.append(abs(v - med) >= 10 and (v >= 4 * med or v * 4 <= med) and abs(v - med) > 3 * 1.4826 * mad)
    return out


def test_level_spikes_equal_brute_force(spark):
    rng = np.random.default_rng(5)
    series = {f"s{k}": [float(x) for x in rng.poisson(40 + 10 * k, 60)] for k in range(4)}
    series["s1"][20], series["s2"][0], series["s3"][59] = 900.0, 0.0, 700.0
    rows = [(k, day(i), v) for k, vs in series.items() for i, v in enumerate(vs)]
    got = {(r.entity, r.day): r.spike for r in level_outliers(spark.createDataFrame(rows, "entity string, day date, reading double")).collect()}
    for k, vs in series.items():
        assert [got[k, day(i)] for i in range(60)] == brute_level(vs)
    assert got["s1", day(20)] and got["s2", day(0)] and got["s3", day(59)]


def test_bounds_stuck_values_and_habit(spark):
    base = [50.0, 61.0, 47.0, 55.0, 52.0, 58.0, 49.0, 60.0, 53.0, 57.0] * 4
    stuck = base[:20] + [77.0] * 6 + base[20:]
    habit = [20.0, 20.0, 20.0, 30.0, 30.0, 20.0, 20.0] * 5 + [20.0] * 6
    low = [3.0] * 6 + [1.0, 2.0, 4.0, 3.0, 2.0] * 6
    rows = [(k, day(i), v) for k, vs in (("stuck", stuck), ("habit", habit), ("low", low)) for i, v in enumerate(vs)]
    rows += [("stuck", day(90), -1.0), ("stuck", day(91), 900000.0), ("none", day(0), None), ("nan", day(0), float("nan")), ("lone", day(0), 5.0)]
    out = level_outliers(spark.createDataFrame(rows, "entity string, day date, reading double")).collect()
    flags = {(r.entity, r.day): r for r in out}
    assert {r.day for r in out if r.stuck} == {day(20 + i) for i in range(6)}
    assert {(r.entity, r.day) for r in out if r.bound} == {("stuck", day(90)), ("stuck", day(91))}
    assert flags["lone", day(0)].level is None and not flags["lone", day(0)].spike
    assert ("none", day(0)) not in flags and ("nan", day(0)) not in flags


def test_moves_flag_single_outliers_not_jumps(spark):
    steps = [100 + (i % 3) * 0.5 for i in range(30)]
    jump = steps[:15] + [v + 80 for v in steps[15:]]
    spike = list(steps)
    spike[10] = 160.0
    rows = [(k, day(i), float(v)) for k, vs in (("jump", jump), ("spike", spike), ("flat", [5.0] * 30)) for i, v in enumerate(vs)] + [("bad", day(0), 0.0)]
    out = move_outliers(spark.createDataFrame(rows, "entity string, day date, reading double")).collect()
    assert {(r.entity, r.day) for r in out if r.spike} == {("spike", day(10))}
    assert {r.entity for r in out if r.bound} == {"bad"}


def grid_rows(spark, rows):
    return complete_grid(spark.createDataFrame([(s, "daily", e, p, v, None) for s, e, p, v in rows], READINGS))


def test_grid_keeps_readings_fills_low_rank_gaps_and_marks_the_rest(spark):
    rng = np.random.default_rng(1)
    shape = [1.0 + 0.5 * float(np.sin(i / 3)) for i in range(40)]
    rows, hidden = [], {}
    for k in range(30):
        for i in range(40):
            v = (10 + k) * shape[i]
            if rng.random() < 0.1 and 0 < i < 39 and i != 20:
                hidden[f"e{k}", i] = v
            elif i != 20:
                rows.append(("s", f"e{k}", i, v))
    rows += [("s", "short", 0, 1.0), ("s", "short", 3, 2.0), ("s", "one", 5, 7.0), ("s", "none", 5, None), ("s", "none", 6, float("nan"))]
    got = {(r.entity, r.period): r for r in grid_rows(spark, rows).collect()}
    seen = {(e, p): v for _, e, p, v in rows if v is not None and v == v}
    assert all(got[k].mark == "observed" and got[k].value == v for k, v in seen.items())
    errors = [abs(got[k].value - v) / v for k, v in hidden.items()]
    assert all(got[k].mark == "filled" for k in hidden) and np.mean(errors) < 0.1
    assert all(got[f"e{k}", 20].mark == "unsupported" and got[f"e{k}", 20].value is None for k in range(30))  # no source has this day
    assert got["short", 1].mark == got["short", 2].mark == "unsupported"
    assert ("one", 5) in got and ("one", 6) not in got and not any(e == "none" for e, _ in got)


def test_impossible_readings_stay_but_do_not_bend_the_fills(spark):
    rows = [("s", "daily", f"e{i}", t, (10.0 + i) * (2 + t % 7), None) for i in range(12) for t in range(40) if (i + t) % 9]
    fine = spark.createDataFrame(rows, "series string, calendar string, entity string, period int, value double, rank_by int")
    bad = fine.withColumn("value", F.when((F.col("entity") == "e3") & (F.col("period") == 5), 1e9).otherwise(F.col("value"))).withColumn("fits", F.col("value") < 1e6)
    got = [{(r.entity, r.period): (r.value, r.mark) for r in complete_grid(df).collect()} for df in (fine, bad)]
    assert got[1]["e3", 5] == (1e9, "observed") and got[0].keys() == got[1].keys()
    filled = [k for k, (_, mark) in got[0].items() if mark == "filled"]
    assert len(filled) > 30 and all(abs(got[1][k][0] - got[0][k][0]) < 0.1 * got[0][k][0] for k in filled)


def test_grid_counts_the_latest_of_a_period_and_nothing_of_nothing(spark):
    t = dt.datetime(2025, 1, 6, 10)
    rows = [("s", "daily", "a", 1, 1.0, t), ("s", "daily", "a", 1, 2.0, t + dt.timedelta(hours=1)), ("s", "daily", "a", None, 3.0, t)]
    assert [(r.period, r.value) for r in complete_grid(spark.createDataFrame(rows, READINGS)).collect()] == [(1, 2.0)]
    assert complete_grid(spark.createDataFrame([], READINGS)).count() == 0


def test_latest_counts_and_ties_do_not_depend_on_order(spark):
    rows = [("a", 1, 5.0), ("a", 2, None), ("a", 2, 4.0), (None, 1, 1.0)]
    df = spark.createDataFrame(rows, "k string, at int, v double")
    want = [(None, 1.0), ("a", 4.0)]
    for part in (df, df.orderBy(F.desc("v")), df.repartition(3)):
        assert sorted(((r.k, r.v) for r in latest_by(part, ["k"], [F.col("at")], ["v"]).collect()), key=str) == sorted(want, key=str)


@pytest.mark.parametrize("name", ["p1_found", "p5_found", "p6_found"])
def test_queries_have_the_given_columns(spark, sf, name):
    import __spark_entry__

    want = {"p1_found": ["series", "entity", "day"], "p5_found": ["series", "entity", "day"], "p6_found": ["measure", "source", "term", "day"]}[name]
    df = __spark_entry__.queries()[name](spark, sf)
    assert df.columns == want
    rows = df.collect()
    assert rows and len(rows) == len(set(rows))
