"""Sliding fits and the steepest window."""

import numpy as np
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import Window
from pyspark.sql import functions as F

from ratewell import scale
from ratewell.functions.clock import clock_minutes, whole_minutes
from ratewell.functions.lines import intercept, line_sums, r_squared, slope
from ratewell.operators import rates

SCHEMA = "series string, pos int, x double, y double"


def frame(spark, series):
    rows = [(k, i, float(x), None if y is None else float(y)) for k, points in series.items()
            for i, (x, y) in enumerate(points)]
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


def by_series(fits):
    out = {}
    for r in sorted(fits.collect(), key=lambda r: r["window_start"]):
        out.setdefault(r["series"], []).append(r)
    return out


def check_against_polyfit(points, fits, window):
    assert [r["window_start"] for r in fits] == list(range(1, len(points) - window + 1))
    for r in fits:
        part = points[r["window_start"] - 1:r["window_start"] + window]
        x, y = np.array(part, float).T
        slope, intercept = np.polyfit(x, y, 1)
        assert r["n"] == window + 1
        assert r["slope"] == pytest.approx(slope, rel=1e-7, abs=1e-9)
        assert r["intercept"] == pytest.approx(intercept, rel=1e-7, abs=1e-7)
        assert r["r2"] == pytest.approx(np.corrcoef(x, y)[0, 1] ** 2, abs=1e-7)


@settings(max_examples=6, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(length=st.integers(3, 50), window=st.integers(2, 12), seed=st.integers(0, 1000))
def test_fit_matches_polyfit(spark, length, window, seed):
    rng = np.random.default_rng(seed)
    points = list(zip(np.cumsum(rng.uniform(0.5, 3, length)), rng.normal(0, 10, length)))
    fits = by_series(rates.sliding_fit(frame(spark, {"s": points}), ["series"], ["pos"], "x", "y", window, longest=50))
    check_against_polyfit(points, fits.get("s", []), window) if length > window else None
    if length <= window:
        assert fits == {}


@pytest.mark.parametrize("window", [2, 20, 31])
def test_one_long_series_in_chunks(spark, window):
    rng = np.random.default_rng(window)
    long = list(zip(np.cumsum(rng.uniform(0.5, 3, 400)), rng.normal(0, 10, 400)))
    short = long[:60]
    df = frame(spark, {"long": long, "short": short})
    fits = by_series(rates.sliding_fit(df, ["series"], ["pos"], "x", "y", window, group_rows=100, chunk_rows=50))
    check_against_polyfit(long, fits["long"], window)
    check_against_polyfit(short, fits["short"], window)


def test_chunk_shorter_than_window_is_widened(spark):
    points = [(i, i * i % 37) for i in range(200)]
    df = frame(spark, {"s": points})
    got = by_series(rates.sliding_fit(df, ["series"], ["pos"], "x", "y", 30, group_rows=50, chunk_rows=7))
    check_against_polyfit(points, got["s"], 30)


def test_series_without_a_full_window_gives_nothing(spark):
    df = frame(spark, {"short": [(0, 1), (1, 2), (2, 3)], "single": [(0, 1)]})
    assert rates.sliding_fit(df, ["series"], ["pos"], "x", "y", 3, longest=3).count() == 0
    assert rates.sliding_fit(df, ["series"], ["pos"], "x", "y", 2, longest=3).count() == 1


def test_flat_series_has_no_r2_and_fails_the_gate(spark):
    df = frame(spark, {"flat": [(i, 2) for i in range(8)], "up": [(i, 3 * i + 1) for i in range(8)]})
    fits = rates.sliding_fit(df, ["series"], ["pos"], "x", "y", 4, longest=8)
    assert all(r["r2"] is None and r["slope"] == 0 for r in by_series(fits)["flat"])
    best = rates.best_window(fits, ["series"], min_r2=0.9).collect()
    assert {r["series"] for r in best} == {"up"}
    assert best[0]["max_slope"] == pytest.approx(3) and best[0]["intercept"] == pytest.approx(1)


def test_constant_time_has_no_slope(spark):
    fits = rates.sliding_fit(frame(spark, {"s": [(5, i) for i in range(6)]}), ["series"], ["pos"], "x", "y", 4, longest=6)
    assert [r["slope"] for r in fits.collect()] == [None, None]
    assert rates.best_window(fits, ["series"]).count() == 0


def with_gaps(seed, length=120, whole=False):
    rng = np.random.default_rng(seed)
    y = rng.integers(0, 9, length) if whole else rng.normal(0, 10, length)
    x = np.cumsum(rng.integers(1, 4, length)) if whole else np.cumsum(rng.uniform(0.5, 3, length)) + 1e6
    points = [(a, None if i % 9 == 4 else b) for i, (a, b) in enumerate(zip(x, y))]
    points[40:75] = [(a, None) for a, _ in points[40:75]]
    return points


def fits_of(spark, points, window, **options):
    return by_series(rates.sliding_fit(frame(spark, {"s": points}), ["series"], ["pos"], "x", "y", window, **options))["s"]


@pytest.mark.parametrize("window", [1, 5, 7, 8, 13, 20, 30, 62, 100])
def test_sums_agree_with_frames(spark, window):
    df = frame(spark, {"s": with_gaps(window)})
    ours = by_series(rates.sliding_fit(df, ["series"], ["pos"], "x", "y", window, longest=120))["s"]
    over = Window.partitionBy("series").orderBy("pos").rowsBetween(0, window)
    frames = df.select("pos", *line_sums(F.col("x"), F.col("y"), over)).select(
        "pos", "n", slope().alias("slope"), r_squared().alias("r2"), intercept().alias("intercept")).orderBy("pos").collect()
    assert len(ours) == 120 - window
    for a, b in zip(ours, frames):
        assert (a["window_start"], a["n"]) == (b["pos"] + 1, b["n"])
        for name in ("slope", "r2"):
            assert a[name] == (None if b[name] is None else pytest.approx(b[name], rel=1e-8, abs=1e-9))
        assert (a["intercept"] is None) == (b["intercept"] is None)


@pytest.mark.parametrize("window", [3, 5, 9, 20, 70])
@pytest.mark.parametrize("options", [{"longest": 120}, {"group_rows": 50, "chunk_rows": 25}])
def test_same_known_reads_give_the_same_bits(spark, window, options):
    points, lines, ties = with_gaps(window), {}, 0
    # A window that loses a missing read and gets one; 24 and 49 lie where a chunk ends.
    for lost in (2, 24, 35, 48, 49):
        for i in (lost, lost + window + 1):
            points[i : i + 1] = [(x, None) for x, _ in points[i : i + 1]]
    for r in fits_of(spark, points, window, **options):
        start = r["window_start"] - 1
        reads = tuple(p for p in points[start : start + window + 1] if p[1] is not None)
        line = (r["slope"], r["intercept"], r["r2"])
        ties += len(reads) > 1 and reads in lines
        assert lines.setdefault(reads, line) == line
    assert ties > 0


@pytest.mark.parametrize("window", [3, 5, 7])
def test_whole_numbers_are_exact_on_every_path(spark, monkeypatch, window):
    points = with_gaps(window, whole=True)
    beside = fits_of(spark, points, window, longest=120)
    monkeypatch.setattr(rates, "NARROW", 0)
    assert [r.asDict() for r in fits_of(spark, points, window, longest=120)] == [r.asDict() for r in beside]
    assert [r.asDict() for r in fits_of(spark, points, window, group_rows=50, chunk_rows=25)] == [r.asDict() for r in beside]
    for r in beside:
        reads = [p for p in points[r["window_start"] - 1 : r["window_start"] + window] if p[1] is not None]
        n, sx, sy = len(reads), sum(int(x) for x, _ in reads), sum(int(y) for _, y in reads)
        below = n * sum(int(x) ** 2 for x, _ in reads) - sx * sx
        above = n * sum(int(x) * int(y) for x, y in reads) - sx * sy
        assert r["slope"] == (above / below if below else None)


def test_widths_by_condition_in_one_shuffle(spark):
    df = frame(spark, {s: with_gaps(i) for i, s in enumerate("abcd")})
    widths = {"a": 1, "b": 6, "c": 17, "d": 40}
    fits = rates.sliding_fit_by(df, "series", widths, ["series"], ["pos"], "x", "y", longest=120)
    plan = fits._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and plan.count("Sort [") == 1 and plan.count("Scan") == 1
    got = by_series(fits)
    for i, s in enumerate("abcd"):
        alone = by_series(rates.sliding_fit(df, ["series"], ["pos"], "x", "y", widths[s], longest=120))[s]
        assert [(r["window_start"], r["n"], r["window"]) for r in got[s]] == [(r["window_start"], r["n"], widths[s]) for r in alone]
        for a, b in zip(got[s], alone):
            assert a["slope"] == (None if b["slope"] is None else pytest.approx(b["slope"], rel=1e-9))


@pytest.mark.parametrize("window", [5, 30, 62])
def test_constant_series_has_exactly_no_spread(spark, window):
    df = frame(spark, {"s": [(i * 0.1, 2.1) for i in range(80)]})
    fits = rates.sliding_fit(df, ["series"], ["pos"], "x", "y", window, longest=80).collect()
    assert all(r["slope"] == 0 and r["r2"] is None for r in fits) and len(fits) == 80 - window


@pytest.mark.parametrize("window", [5, 30, 100])
def test_fit_sorts_and_shuffles_once(spark, window):
    df = frame(spark, {"s": [(i, i) for i in range(40)]})
    fits = rates.sliding_fit(df, ["series"], ["pos"], "x", "y", window, longest=40)
    plan = fits._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and plan.count("Sort [") == 1


def test_null_read_is_left_out_of_its_fits(spark):
    points = [(i, 2 * i) for i in range(10)]
    points[4] = (4, None)
    fits = by_series(rates.sliding_fit(frame(spark, {"s": points}), ["series"], ["pos"], "x", "y", 5, longest=10))["s"]
    assert [r["n"] for r in fits] == [5, 5, 5, 5, 5]
    assert all(r["slope"] == pytest.approx(2) for r in fits)


def test_ties_all_or_first(spark):
    zigzag = [(i, i % 2) for i in range(9)]
    fits = rates.sliding_fit(frame(spark, {"s": zigzag}), ["series"], ["pos"], "x", "y", 1, longest=9)
    every = rates.best_window(fits, ["series"])
    assert sorted(r["window_start"] for r in every.collect()) == [1, 3, 5, 7]
    first = rates.best_window(fits, ["series"], ties="first").collect()
    assert [r["window_start"] for r in first] == [1]


def test_min_slope(spark):
    df = frame(spark, {"down": [(i, -i) for i in range(6)], "up": [(i, i) for i in range(6)]})
    fits = rates.sliding_fit(df, ["series"], ["pos"], "x", "y", 3, longest=6)
    assert {r["series"] for r in rates.best_window(fits, ["series"], min_slope=0).collect()} == {"up"}
    assert rates.best_window(fits, ["series"], min_slope=1.3).count() == 0


@pytest.mark.parametrize("lo, hi", [(1, 30), (5, 30), (30, 2000)])
def test_trim(spark, lo, hi):
    df = frame(spark, {"s": [(i, i) for i in range(100)]})
    kept = rates.trim_reads(df, ["series"], ["pos"], lo, hi)
    assert sorted(r["pos"] for r in kept.collect()) == list(range(lo - 1, min(hi, 100)))
    assert kept.columns == df.columns


def test_trim_limits_before_the_shuffle(spark):
    kept = rates.trim_reads(frame(spark, {"s": [(i, i) for i in range(10)]}), ["series"], ["pos"], 1, 5)
    plan = kept._jdf.queryExecution().executedPlan().toString()
    assert "Partial" in plan.split("Exchange hashpartitioning")[1]


def test_trim_of_a_series_in_many_splits(spark, monkeypatch):
    """64 splits of 500 reads of one series: no task gets more than 8 times 30 of them."""
    df = spark.range(0, 32_000, 1, 64).select(F.lit("s").alias("series"), ((F.col("id") * 7919) % 32_000).alias("pos"))
    monkeypatch.setattr(scale, "GROUP_ROWS", 1000)
    few = rates._first_of_splits(df, ["series"], ["pos"], 30, 64)
    per_group = few.groupBy(F.spark_partition_id()).count().collect()
    assert few.count() == 8 * 30 and max(r["count"] for r in per_group) <= 8 * 30
    plan = few._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan.split("Exchange hashpartitioning")[1]
    kept = rates.trim_reads(df, ["series"], ["pos"], 5, 30, spread_over=64)
    assert sorted(r["pos"] for r in kept.collect()) == list(range(4, 30)) and kept.columns == df.columns


def test_trimmed_rate_needs_one_shuffle(spark):
    df = frame(spark, {"s": [(i, i) for i in range(10)]})
    reads = rates.trim_reads(df, ["series"], ["pos"], 1, 9)
    best = rates.best_window(rates.sliding_fit(reads, ["series"], ["pos"], "x", "y", 3, longest=9), ["series"], longest=9)
    plan = best._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1


def test_inactive_series_keep_their_reads(spark):
    df = frame(spark, {"flat": [(i, 2) for i in range(8)], "up": [(i, i) for i in range(8)]})
    fits = rates.sliding_fit(df, ["series"], ["pos"], "x", "y", 4, longest=8)
    best = rates.best_window(fits, ["series"], min_r2=0.9, ties="first")
    tagged = rates.attach_rates(df, best, ["series"], "series").groupBy("series", "winners").count().collect()
    assert {(r["series"], r["winners"], r["count"]) for r in tagged} == {("flat", " inactive", 8), ("up", "up", 8)}


def test_last_minute(spark):
    df = frame(spark, {"s": [(i * 2, i) for i in range(5)], "t": [(i * 2, i) for i in range(3)]})
    got = rates.force_last_minute(df.withColumnRenamed("x", "minutes"), ["series"])
    assert sorted(r["minutes"] for r in got.where("series = 's'").collect()) == [0, 2, 4, 6, 60]
    assert sorted(r["minutes"] for r in got.where("series = 't'").collect()) == [0, 2, 60]


def test_minutes_round_half_to_even(spark):
    seconds = spark.createDataFrame([(150.0,), (210.0,), (30.0,), (90.0,), (100.0,)], "s double")
    got = [r[0] for r in seconds.select(whole_minutes(F.col("s"))).collect()]
    assert got == [2.0, 4.0, 0.0, 2.0, 2.0]


def test_clock_minutes(spark):
    texts = spark.createDataFrame([("1899-12-31 00:02:00",), ("1899-12-31 01:30:29",), ("no time",), (None,)], "t string")
    assert [r[0] for r in texts.select(clock_minutes("t")).collect()] == [2.0, 90.0, None, None]


def test_elapsed_minutes_do_not_wrap_at_midnight(spark):
    df = spark.sql("""SELECT 's' AS k, timestamp_ntz'2024-01-01 23:50:00' + make_dt_interval(0, 0, 10 * id, 0) AS ts
                      FROM range(4)""")
    got = sorted(r["minutes"] for r in rates.elapsed_minutes(df, ["k"], "ts").collect())
    assert got == [0, 10, 20, 30]


def test_window_width_by_condition(spark):
    df = frame(spark, {"s": [(i, i) for i in range(12)], "t": [(i, i) for i in range(12)]})
    df = df.withColumn("ph", F.when(F.col("series") == "s", "pH4").otherwise("pH8"))
    fits = rates.sliding_fit_by(df, "ph", {"pH4": 9, "pH8": 4}, ["series"], ["pos"], "x", "y", longest=12)
    counts = {(r["ph"], r["window"]): r["count"] for r in fits.groupBy("ph", "window").count().collect()}
    assert counts == {("pH4", 9): 3, ("pH8", 4): 8}


def test_sorted_rates(spark):
    df = spark.createDataFrame([("a", 1.0), ("b", 3.0), ("c", 2.0)], "org string, max_slope double")
    assert [r["org"] for r in rates.sorted_rates(df).collect()] == ["b", "c", "a"]
