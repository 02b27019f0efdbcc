"""Plans that start from folders of files."""

import pytest

from ratewell.plans import chromatography, response, slopes
from test_curves import HEAT_RATES, PH_CURVE, PH_RATES, TEMPERATURE_RATES


def write(folder, name, header, rows):
    lines = [",".join(header), *[",".join(map(str, r)) for r in rows]]
    (folder / name).write_text("\n".join(lines) + "\n", encoding="utf-8")


CONDITION = ["org", "max_slope", "r2", "intercept", "pH"]


def test_ph_files(spark, tmp_path):
    for condition, values in PH_RATES.items():
        write(tmp_path, f"{condition}_x_slopes.csv", CONDITION,
              [(f"mean_{i}", v, 0.9, 1.0, condition) for i, v in enumerate(values, 1)])
    write(tmp_path, "other.csv", CONDITION, [("mean_1", 99, 0.9, 1, "pH4")])
    got = {r["ph"]: r for r in response.ph_curve(spark, str(tmp_path), include="_x_").collect()}
    assert {k: (v["mean"], v["sd"]) for k, v in got.items()} == {
        k: (pytest.approx(m, rel=1e-9), pytest.approx(s, rel=1e-9)) for k, (m, s) in PH_CURVE.items()}
    plain = {r["ph"]: r["mean"] for r in response.ph_curve(spark, str(tmp_path), None, include="_x_").collect()}
    assert plain[7.0] == pytest.approx(sum(PH_RATES["pH7"]) / 3)


def test_stability_files(spark, tmp_path):
    write(tmp_path, "heat_degrees_all.csv", CONDITION[:4], [(label, v, 0.9, 1.0) for label, v in HEAT_RATES])
    got = response.stability_curve(spark, str(tmp_path), "Lacticaseib", include="degrees", exclude="pdf|png|4degrees")
    assert {r["temperature"]: round(r["mean"], 8) for r in got.collect()} == {40.0: 67.77585360, 70.0: 2.39760686}


def test_temperature_files_to_family(spark, tmp_path):
    (tmp_path / "rates").mkdir()
    for condition, (rate, _) in TEMPERATURE_RATES.items():
        write(tmp_path / "rates", f"20230623_enzyme_{condition}.csv", CONDITION,
              [("mean_2", rate, 0.9, 1.0, condition), ("mean_1", rate * 10, 0.9, 1.0, condition)])
    volumes = {"mean_1": 20.0, "mean_2": 2.0}
    rates = response.normalised_rates(spark, str(tmp_path / "rates"), volumes)
    want = {float(c[:2]): per_nmol for c, (_, per_nmol) in TEMPERATURE_RATES.items()}
    for volume in volumes.values():
        curve = response.temperature_curves(rates).where(f"enzyme_ul = {volume}").collect()
        assert {r["temperature"]: r["mean"] for r in curve} == {k: pytest.approx(v, rel=1e-9) for k, v in want.items()}
    (tmp_path / "norm").mkdir()
    for amount in (1, 2, 20):
        rows = rates.where(f"enzyme_ul = {amount}").select("org", "max_slope", "r2", "intercept", "condition", "sec_slope", "nm_slope")
        write(tmp_path / "norm", f"20230623_enzyme_{amount}_slopes.csv", rows.columns, [tuple(r) for r in rows.collect()])
    family = response.curve_family(spark, str(tmp_path / "norm"), "20230623").collect()
    assert {r["amount"] for r in family} == {2.0, 20.0} and len(family) == 12
    logs = response.log_temperature_curve(spark, str(tmp_path / "rates")).collect()
    assert all(r["n"] == 2 for r in logs) and len(logs) == 6


def test_hplc_sheet(spark, tmp_path):
    lines = ["h,DH_1_AP,DH_2_AP", "0h,10.0 a,12.0 b", "24h,5 a,bad", ",,", "h,EV_1_AP,EV_2_AP", "0h,1.0 a,3.0 b",
             "h,p006_1_AP,p006_2_MB", "0h,7.5,2",
             "h,DH_1_MB,DH_2_MB", "0h,1,3"]
    (tmp_path / "sheet.csv").write_text("\n".join(lines) + "\n")
    got = chromatography.hplc_time_course(spark, str(tmp_path), 3).collect()
    assert {r["idvar"]: r["mean"] for r in got} == {"DH_0h_AP": 11.0, "DH_24h_AP": 5.0, "p006_0h_AP": 7.5, "DH_0h_MB": 2.0}
    other = chromatography.hplc_time_course(spark, str(tmp_path), 3, drop_enzymes=(), drop_ids="DH_24h").collect()
    assert {r["idvar"] for r in other} == {"DH_0h_AP", "EV_0h_AP", "p006_0h_AP", "DH_0h_MB"}


def test_chromatograms(spark, tmp_path):
    for name in ("LBII_t1.csv", "LBIIpbt6.csv", "Wasser_t2.csv"):
        (tmp_path / name).write_text("p\n" * 76 + "time (min),value (mAU)\n" + "".join(f"{i},{i}.5\n" for i in range(12)))
    got = chromatography.chromatogram_overlay(spark, str(tmp_path), exclude="~|Wasser|MiliQ").groupBy("sample").count()
    assert {r["sample"]: r["count"] for r in got.collect()} == {" enzyme_0.25h": 7, "boiled_enzyme_40.4h": 7}


def test_slope_catalogue(spark, tmp_path):
    write(tmp_path, "20230421_64DHH_4NP_butyrate_1_all_data_calculated_slopes.csv", CONDITION[:4], [("a", 0.1, 0.9, 1), ("b", 0.3, 0.9, 1)])
    write(tmp_path, "20230422_64DHH_4NP_trimethylacetate_all_data_calculated_slopes.csv", CONDITION[:4], [("c", 0.12345, 0.9, 1)])
    write(tmp_path, "notes.csv", CONDITION[:4], [("z", 9, 9, 9)])
    tables = slopes.slope_catalogue(spark, str(tmp_path))
    assert {(r["substrate"], r["n"]) for r in tables["counts"].collect()} == {("butyrate", 2), ("trimethylacetate", 1)}
    assert [r["org"] for r in tables["labels"].collect()] == ["b"]
    assert {r["substrate"]: r["median"] for r in tables["summary"].collect()} == {"butyrate": 0.2, "trimethylacetate": 0.12345}
    assert tables["box"].count() == 2
    assert {(r["date"], r["org"], r["substrate"]) for r in tables["catalogue"].collect()} == {
        ("20230421", "a", "butyrate"), ("20230421", "b", "butyrate"), ("20230422", "c", "trimethylacetate")}
