"""t probabilities against closed forms and against numeric integration."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from ratewell.functions.distributions import f_upper, t_critical, t_two_sided
from ratewell.operators import calibrate

CLOSED = {
    1: lambda t: 1 - 2 / math.pi * math.atan(t),
    2: lambda t: 1 - t / math.sqrt(2 + t * t),
    4: lambda t: 1 - t / math.sqrt(4 + t * t) * (1 + 2 / (4 + t * t)),
}
TS = [0.0, 1e-6, 0.01, 0.3, 1.0, 1.5, 1.7, 1.8, 2.0, 3.0, 5.0, 12.0]


def integrated(t, v):
    """Two-sided tail by Simpson's rule over t = sqrt(v) tan(angle), where the density is a power of a cosine."""
    angle = np.linspace(math.atan(t / math.sqrt(v)), math.pi / 2, 200_001)
    top = np.linspace(0, math.pi / 2, 200_001)

    def area(a):
        y = np.cos(a) ** (v - 1)
        return (a[1] - a[0]) / 3 * (y[0] + y[-1] + 4 * y[1:-1:2].sum() + 2 * y[2:-1:2].sum())
    return area(angle) / area(top)


def tails(spark, pairs):
    rows = spark.createDataFrame(pairs, "t double, v long")
    return {(r["t"], r["v"]): r for r in rows.select(
        "t", "v", t_two_sided(F.col("t"), F.col("v")).alias("p"), f_upper(F.col("t") * F.col("t"), F.col("v")).alias("p_f")).collect()}


def test_closed_forms(spark):
    for (t, v), r in tails(spark, [(t, v) for t in TS for v in CLOSED]).items():
        assert r["p"] == pytest.approx(CLOSED[v](t), rel=1e-9, abs=1e-14) and r["p_f"] == pytest.approx(r["p"], rel=1e-12)


def test_many_degrees_of_freedom(spark):
    for (t, v), r in tails(spark, [(t, v) for t in TS for v in (3, 5, 10, 37, 200, 3000)]).items():
        assert r["p"] == pytest.approx(integrated(t, v), rel=1e-8, abs=1e-13)
    for (t, _), r in tails(spark, [(t, 10**9) for t in TS[:-1]]).items():
        assert r["p"] == pytest.approx(math.erfc(t / math.sqrt(2)), rel=1e-5)


def test_sign_and_missing_numbers(spark):
    found = tails(spark, [(-2.0, 4), (2.0, 4), (None, 4), (2.0, None), (2.0, 0)])
    assert found[(-2.0, 4)]["p"] == found[(2.0, 4)]["p"]
    assert [found[k]["p"] for k in ((None, 4), (2.0, None), (2.0, 0))] == [None] * 3


@pytest.mark.parametrize("level", [0.1, 0.5, 0.95, 0.999, 0.999999])
def test_critical_values_undo_the_tail(spark, level):
    rows = spark.createDataFrame([(v,) for v in (1, 2, 3, 4, 10, 100, 10**6)], "v long")
    for r in rows.select("v", t_critical(level, F.col("v")).alias("t")).withColumn("p", t_two_sided(F.col("t"), F.col("v"))).collect():
        assert r["p"] == pytest.approx(1 - level, rel=1e-9)
    assert spark.range(1).select(t_critical(level, F.lit(None).cast("long"))).first()[0] is None


def test_known_critical_values(spark):
    rows = spark.createDataFrame([(1,), (2,), (10,), (30,)], "v long").select("v", t_critical(0.95, F.col("v")).alias("t"))
    assert {r["v"]: round(r["t"], 3) for r in rows.collect()} == {1: 12.706, 2: 4.303, 10: 2.228, 30: 2.042}


def test_fit_and_band(spark):
    df = spark.createDataFrame([("p", float(i), 2.0 * i + (-1) ** i) for i in range(6)], "k string, x double, y double")
    fit = calibrate.fit_line(df, ["k"], "x", "y")
    row = calibrate.with_p_values(fit).first()
    assert row["p_m"] == pytest.approx(CLOSED[4](abs(row["t_m"]))) and row["p_b"] == pytest.approx(CLOSED[4](abs(row["t_b"])))
    assert row["p_f"] == pytest.approx(row["p_m"])
    by_level = calibrate.fitted_line(fit, 5, level=0.95).collect()
    by_hand = calibrate.fitted_line(fit, 5, t_critical=2.7764451051977987).collect()
    assert [r["upper"] for r in by_level] == pytest.approx([r["upper"] for r in by_hand], rel=1e-12)
    with pytest.raises(ValueError):
        calibrate.fitted_line(fit, 5, t_critical=2.0, level=0.95)
