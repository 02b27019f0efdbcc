"""Standard curves."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from ratewell.operators import calibrate, controls


def test_fit_summary_against_matrix_solution(spark):
    rng = np.random.default_rng(1)
    x = np.repeat([0.0, 8, 16, 24, 40], 6)
    y = 0.11 + 0.046 * x + rng.normal(0, 0.02, len(x))
    df = spark.createDataFrame([("p", float(a), float(b)) for a, b in zip(x, y)] + [("p", 3.0, None)],
                               "assay string, nmol double, absorbance double")
    row = calibrate.fit_line(df, ["assay"], "nmol", "absorbance").first()
    design = np.column_stack([np.ones_like(x), x])
    coef, rss, *_ = np.linalg.lstsq(design, y, rcond=None)
    n = len(x)
    s2 = rss[0] / (n - 2)
    cov = s2 * np.linalg.inv(design.T @ design)
    r2 = 1 - rss[0] / ((y - y.mean()) ** 2).sum()
    want = {"b": coef[0], "m": coef[1], "r2": r2, "n": n, "residual_se": math.sqrt(s2),
            "se_b": math.sqrt(cov[0, 0]), "se_m": math.sqrt(cov[1, 1]), "t_m": coef[1] / math.sqrt(cov[1, 1]),
            "t_b": coef[0] / math.sqrt(cov[0, 0]), "f": coef[1] ** 2 / cov[1, 1],
            "adj_r2": 1 - (1 - r2) * (n - 1) / (n - 2), "x_min": 0.0, "x_max": 40.0}
    for name, value in want.items():
        assert row[name] == pytest.approx(value, rel=1e-9), name


def test_fit_of_two_points_has_no_errors(spark):
    df = spark.createDataFrame([("p", 0.0, 1.0), ("p", 2.0, 5.0)], "k string, x double, y double")
    row = calibrate.fit_line(df, ["k"], "x", "y").first()
    assert (row["b"], row["m"], row["residual_se"], row["se_m"]) == (1.0, 2.0, None, None)


def test_band_is_narrowest_at_the_mean(spark):
    df = spark.createDataFrame([("p", float(i), 2.0 * i + (-1) ** i) for i in range(11)], "k string, x double, y double")
    band = calibrate.fitted_line(calibrate.fit_line(df, ["k"], "x", "y"), 11, 2.0).orderBy("point").collect()
    width = [r["upper"] - r["lower"] for r in band]
    assert [r["x"] for r in band] == [float(i) for i in range(11)]
    assert min(width) == width[5] and width[0] == pytest.approx(width[10])
    assert "lower" not in calibrate.fitted_line(calibrate.fit_line(df, ["k"], "x", "y")).columns


@pytest.mark.parametrize("label, position", [("stdcurve_3", -1), ("pH4_stdcurve_3", -1), ("stdcurve_3_rep1", -2), ("stdcurve_3_x", 2)])
def test_dose_is_eight_nmol_per_microlitre(spark, label, position):
    dose = calibrate.dose_from_label(F.col("label"), position)
    row = spark.createDataFrame([(label,)], "label string").select(*[c.alias(n) for n, c in dose.items()]).first()
    assert row["ul"] == 3 and row["mm"] == pytest.approx(0.12) and row["nmol"] == pytest.approx(24)


def test_inverse_of_each_assay_and_fixed(spark):
    rows = spark.createDataFrame([("a", 5.0), ("b", 5.0)], "assay string, absorbance double")
    lines = spark.createDataFrame([("a", 1.0, 2.0), ("b", 0.0, 0.0)], "assay string, b double, m double")
    got = {r["assay"]: r["nmol"] for r in calibrate.apply_calibration(rows, lines, ["assay"], "absorbance").collect()}
    assert got == {"a": 2.0, "b": None}
    fixed = calibrate.apply_fixed(rows, 0.1136175, 0.04623074, "absorbance").first()["nmol"]
    assert fixed == pytest.approx((5 - 0.1136175) / 0.04623074)


def test_replicates(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", 3.0), ("b", 5.0), ("c", None)], "k string, v double")
    got = {r["k"]: (r["mean"], r["sd"], r["n"]) for r in controls.replicate_stats(df, ["k"], "v").collect()}
    assert got == {"a": (2.0, pytest.approx(math.sqrt(2)), 2), "b": (5.0, None, 1), "c": (None, None, 0)}
    assert controls.attach_stats(df, ["k"], "v").count() == 4


def test_control_pairs(spark):
    df = spark.createDataFrame(
        [(0, "s1", 5.0), (0, "s1", 7.0), (0, "s2", 9.0), (0, "ctl", 1.0), (1, "s1", 8.0), (1, "other", 3.0)],
        "minutes int, label string, nmol double")
    got = controls.subtract_control(df, ["minutes"], "label", "nmol", [("s1", "ctl", "mean_1"), ("s2", "ctl", "mean_2")])
    assert {(r["minutes"], r["id"]): r["mean"] for r in got.collect()} == {
        (0, "mean_1"): 5.0, (0, "mean_2"): 8.0, (1, "mean_1"): None}


def test_blank_matches_the_whole_substrate(spark):
    rows = [("rfp_urea", 0, 1.0), ("rfp_urea", 0, 3.0), ("c1_urea", 0, 10.0),
            ("rfp_ethylurea", 0, 5.0), ("c1_ethylurea", 0, 10.0), ("rfp_only", 0, 1.0), ("c1_noblank", 0, 1.0)]
    df = spark.createDataFrame(rows, "label string, read_idx int, value double").selectExpr(
        "*", "split_part(label, '_', 1) colony", "split_part(label, '_', 2) substrate")
    got = controls.subtract_blank(df, ["substrate", "read_idx"], F.col("colony") == "rfp", "value").collect()
    assert {r["label"]: r["corrected"] for r in got} == {"c1_urea": 8.0, "c1_ethylurea": 5.0}


def test_substrates(spark):
    df = spark.createDataFrame([("c1_Urea_4np",), ("c2_urea_4np",), ("time",), ("wt_methyl",)], "label string")
    assert sorted(r[0] for r in controls.distinct_substrates(df, "label").collect()) == ["methyl", "urea"]
