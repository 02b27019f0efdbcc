"""Response curves and normalisation against known results."""

import pytest
from pyspark.sql import functions as F

from ratewell.functions.text import first_match
from ratewell.operators import curves, normalize, report, sections

# Measured rates of three replicates per pH: fixed values.
PH_RATES = {
    "pH4": [-0.002066070891014128, 0.017069980183315347, 0.009381261889446539],
    "pH5": [0.5568867508570207, 0.48616083931896165, 0.560856472349458],
    "pH6": [1.002701514104417, 0.9376371017088121, 1.0548417394224139],
    "pH7": [1.3910808810178892, 1.4321429070238378, 1.446807916311678],
    "pH8_": [1.742085626685383, 2.057798628298425, 1.958307167571694],
    "pH85": [1.504435793657266, 1.7279637410887112, 1.6105343124841738],
    "pH9": [1.940766198322046, 1.9690690387142422, 2.114303042555341],
}
# Their curve per nmol of enzyme (mean, sd): fixed values.
PH_CURVE = {
    4.0: (0.09726825433349312, 0.1152294614033022), 5.0: (6.397697482518379, 0.5029092213608019),
    6.0: (11.947259356776918, 0.7026834522934293), 7.0: (17.03242215260748, 0.3456724541090217),
    8.0: (22.968435350139867, 1.9315465010651123), 8.5: (19.317630278734914, 1.3379944644902584),
    9.0: (24.029251628056556, 1.1141154751152211),
}
# Rates after heating, replicates of one label per temperature: fixed values.
HEAT_RATES = [
    ("Lacticaseib_40°C_rep1", 6.432948965604396), ("Lacticaseib_40°C_rep3", 6.182339626219152),
    ("Lacticaseib_40°C_rep2", 5.920806289988907), ("Lacticaseib_70°C_rep1", 0.23174189088544989),
    ("Lacticaseib_70°C_rep3", 0.21791638034966973), ("Lacticaseib_70°C_rep2", 0.20606594274757312),
    ("abiotic_control_rep3", 0.1375138426370333),
]
# Rates of one series at six temperatures for 2 uL of enzyme, and per nmol: fixed values.
TEMPERATURE_RATES = {
    "21_4degrees": (0.04959449209405443, 5.93471700640219), "25degrees": (0.07616237257025878, 9.113958196878926),
    "30degrees": (0.09794166660325536, 11.720173952449773), "35degrees": (0.11527473758393512, 13.794333133818798),
    "40degrees": (0.1763162425288007, 21.098855111897624), "45degrees": (0.11441160797410868, 13.691046866374991),
}
MG_PER_ML, G_PER_MOL = 0.22, 52652.53


def test_enzyme_amount(spark):
    amount = normalize.enzyme_nmol(20.0, MG_PER_ML, G_PER_MOL)
    assert spark.range(1).select(amount).first()[0] == pytest.approx(0.08356673458996179, rel=1e-12)


def test_nan_is_left_out_of_a_curve(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", 3.0), ("a", float("nan")), ("a", None)], "k string, rate double")
    row = curves.response_curve(df, ["k"], "rate").first()
    assert (row["mean"], row["n"]) == (2.0, 2) and row["lo"] == pytest.approx(2 - 2 ** 0.5)


def test_ph_curve(spark):
    rows = [(f"{c}.csv", f"mean_{i}", str(v), c) for c, values in PH_RATES.items() for i, v in enumerate(values, 1)]
    rows += [(f"{c}.csv", "org", "max_slope", "pH") for c in PH_RATES]
    rows += [("copy.csv", *rows[0][1:])]
    table = spark.createDataFrame(rows, "file_name string, org string, max_slope string, condition string")
    rates = normalize.per_enzyme(curves.clean_rates(table), normalize.enzyme_nmol(20.0, MG_PER_ML, G_PER_MOL))
    got = {r["ph"]: r for r in curves.ph_curve(rates, "condition", "nm_slope").collect()}
    assert set(got) == set(PH_CURVE)
    for ph, (mean, sd) in PH_CURVE.items():
        assert got[ph]["mean"] == pytest.approx(mean, rel=1e-9)
        assert got[ph]["sd"] == pytest.approx(sd, rel=1e-9)
        assert got[ph]["n"] == 3 and got[ph]["lo"] == pytest.approx(mean - sd) and got[ph]["hi"] == pytest.approx(mean + sd)


def test_stability_curve(spark):
    table = spark.createDataFrame(HEAT_RATES, "org string, max_slope double").where("org rlike 'Lacticaseib'")
    rates = normalize.per_enzyme(table, normalize.enzyme_nmol(10.0, 0.48, G_PER_MOL))
    got = {r["temperature"]: (r["mean"], r["sd"]) for r in curves.temperature_curve(rates, "org", "nm_slope").collect()}
    assert got == {
        40.0: (pytest.approx(67.77585360051923, rel=1e-9), pytest.approx(2.809130444201847, rel=1e-9)),
        70.0: (pytest.approx(2.397606864475705, rel=1e-9), pytest.approx(0.14096210532642808, rel=1e-9))}


def test_temperature_family(spark):
    rows = [("mean_2", c, v) for c, (v, _) in TEMPERATURE_RATES.items()] + [("mean_9", "25degrees", 1.0)]
    table = spark.createDataFrame(rows, "org string, condition string, max_slope double")
    picked = curves.pick_series(table, "org", {"mean_1": 20.0, "mean_2": 2.0, "mean_3": 10.0})
    rates = normalize.per_enzyme(picked, normalize.enzyme_nmol(F.col("enzyme_ul"), MG_PER_ML, G_PER_MOL))
    got = curves.temperature_curve(rates, "condition", "nm_slope", ["enzyme_ul"]).collect()
    want = {(2.0, float(c[:2])): v for c, (_, v) in TEMPERATURE_RATES.items()}
    assert {(r["enzyme_ul"], r["temperature"]): r["mean"] for r in got} == {k: pytest.approx(v, rel=1e-9) for k, v in want.items()}
    assert all(r["sd"] is None for r in got)


def test_older_time_unit(spark):
    row = normalize.per_enzyme(spark.createDataFrame([(120.0,)], "max_slope double"), 0.5, divisor=120).first()
    assert (row["sec_slope"], row["nm_slope"]) == (1.0, 2.0)
    none = normalize.per_enzyme(spark.createDataFrame([(120.0,)], "max_slope double"), 0.0).first()
    assert none["nm_slope"] is None


def test_log_rates(spark):
    rows = normalize.scaled_rates(spark.createDataFrame([(1.0,), (-1.0,)], "max_slope double"), 27.02703).collect()
    assert rows[0]["hr_slope"] == 120 and rows[0]["log_slope"] == pytest.approx(1.431798329)
    assert rows[1]["log_slope"] is None


def test_amount_from_file_name(spark):
    names = [("20230623_enzyme_2_slopes.csv",), ("20230623_enzyme_20_slopes.csv",)]
    got = curves.amount_from_file_name(spark.createDataFrame(names, "file_name string"), "20230623").collect()
    assert [r["amount"] for r in got] == [2.0, 20.0]


def rates_table(spark):
    rows = [("wt", "urea", 2.0), ("wt", "urea", 4.0), ("rfp", "urea", 1.0), ("c1", "urea", 6.0), ("c1", "lonely", 5.0)]
    return spark.createDataFrame(rows, "colony string, substrate string, max_slope double")


def test_fold_change(spark):
    changed = normalize.fold_change(rates_table(spark), ["substrate"], F.col("colony") == "wt", "max_slope")
    got = {(r["colony"], r["substrate"], r["max_slope"]): r["fold_change"] for r in changed.collect()}
    assert got[("c1", "urea", 6.0)] == 2.0 and got[("rfp", "urea", 1.0)] == pytest.approx(1 / 3)
    assert got[("c1", "lonely", 5.0)] is None
    means = normalize.reference_means(changed, ["substrate"], "colony", ["wt", "rfp"], "fold_change", "mean_fc").collect()
    assert {r["colony"]: r["mean_fc"] for r in means} == {"wt": 1.0, "rfp": pytest.approx(1 / 3)}


def test_protein_joins_on_lower_case_and_refuses_repeats(spark):
    protein = spark.createDataFrame([("WT", 2000.0), ("C1", 0.0)], "sample string, nm double")
    got = normalize.per_protein(rates_table(spark), protein, "colony", "sample", "nm")
    assert got.count() == 5
    assert sorted(r["max_slope"] for r in got.where("colony = 'wt'").collect()) == [1.0, 2.0]
    assert all(r["max_slope"] is None for r in got.where("colony <> 'wt'").collect())
    with pytest.raises(ValueError):
        normalize.per_protein(rates_table(spark), protein.unionByName(protein), "colony", "sample", "nm")


def test_histogram_density_sums_to_one(spark):
    df = spark.createDataFrame([("a", float(v)) for v in (0, 1, 2, 29, 29)] + [("b", 14.5), ("b", None)], "f string, x double")
    bars = report.density_histogram(df, ["f"], "x", bins=30).collect()
    assert {(r["f"], r["bin"]): r["count"] for r in bars} == {
        ("a", 0): 1, ("a", 1): 1, ("a", 2): 1, ("a", 29): 2, ("b", 14): 1}
    assert sum(r["density"] for r in bars if r["f"] == "a") == pytest.approx(1.0)
    assert {r["bin"]: r["centre"] for r in bars}[29] == 29.0


def test_histogram_of_one_value(spark):
    df = spark.createDataFrame([("a", 3.0)] * 4, "f string, x double")
    assert [(r["count"], r["density"]) for r in report.density_histogram(df, ["f"], "x").collect()] == [(4, 1.0)]


@pytest.mark.parametrize("group_rows", [None, 5])
def test_box_plot(spark, group_rows):
    df = spark.createDataFrame([("a", float(v)) for v in (1, 2, 3, 4, 5, 6, 7, 8, 9, 50)] + [("b", 1.0)], "s string, x double")
    got = {r["s"]: r for r in report.box_stats(df, ["s"], "x", group_rows).collect()}
    assert (got["a"]["q1"], got["a"]["median"], got["a"]["q3"]) == (3.25, 5.5, 7.75)
    assert (got["a"]["whisker_lo"], got["a"]["whisker_hi"], got["a"]["n_outliers"]) == (1.0, 9.0, 1)
    assert [tuple(r) for r in report.box_outliers(df, ["s"], "x", group_rows).collect()] == [("a", 50.0)]
    five = {r["s"]: r for r in report.five_number(df, ["s"], "x", group_rows).collect()}
    assert (five["a"]["min"], five["a"]["max"], five["a"]["mean"], five["a"]["n"]) == (1.0, 50.0, 9.5, 10)


def hplc_sheet(spark):
    """Two blocks of stacked sections with a row ahead of the first marker."""
    rows = [
        ["note", None, None], ["h", "DH_1_AP", "DH_2_AP"], ["0h", "10.0 a", "12.0 b"], ["24h", "5 a", "bad"],
        ["h", "EV_1_AP", "EV_2_AP"], ["0h", "1.0 a", "3.0 b"],
        ["h", "p006_1_AP", "p006_2_MB"], ["0h", " 7.5", "2"], ["24h", None, "4.5 x"],
    ]
    return spark.createDataFrame([("s", i, r) for i, r in enumerate(rows)], "sheet string, row_idx int, cells array<string>")


@pytest.mark.parametrize("group_rows", [None, 4])
def test_sections_and_time_course(spark, group_rows):
    marker = F.col("cells")[1].rlike("^(DH|EV|p006)")
    cells = sections.section_table(hplc_sheet(spark), ["sheet"], "row_idx", "cells", marker, group_rows)
    assert cells.count() == 10
    assert {r["section"] for r in cells.collect()} == {1, 2, 3}
    fields = sections.hplc_fields(cells).where("enzyme <> 'EV'").where("variable <> 'p006_2_MB'")
    got = {(r["idvar"], r["biorep"]): r for r in sections.time_course(fields).collect()}
    assert got[("DH_0h_AP", "1")]["mean"] == 11.0 and got[("DH_0h_AP", "1")]["time_hrs"] == 0.0
    assert got[("DH_24h_AP", "2")]["conc"] is None and got[("DH_24h_AP", "2")]["mean"] == 5.0
    assert got[("p006_24h_AP", "1")]["mean"] is None
    assert ("p006_0h_MB", "2") not in got


def test_trace(spark):
    df = spark.createDataFrame([(float(i), "LB_t1") for i in range(12)], "time_min double, file string")
    assert sections.trace_window(df, "time_min", 10).count() == 10
    assert sections.trace_window(df, "time_min", 10, (3, 10)).count() == 7
    classes = df.select(first_match("file", [("t1", "0.25h"), ("t2", "1.1h")]).alias("c")).distinct().collect()
    assert [r["c"] for r in classes] == ["0.25h"]
