"""Whole analyses on synthetic plates with known rates, read from files."""

import pytest
from pyspark.sql import functions as F

from ratewell.plans.assays import RateSettings, StandardSettings, condition_assay, kinetic_assay, screen
from ratewell.plans.sheets import labelled_reads, sheet_minutes

B, M = 0.11, 0.046
RATES = {"enzA": 1.5, "enzB": 0.4, "enzC": 3.0}


def plate_labels():
    labels = [f"stdcurve_{u}" for u in range(6)]
    labels += [name for name in RATES for _ in range(3)]
    labels += ["flat"] * 3 + ["buffer"] * 2 + ["inactivated"] * 3
    return labels + [None] * (96 - len(labels))


def amount(label, minutes):
    if label.startswith("stdcurve"):
        return 8.0 * int(label.split("_")[1])
    return {"flat": 2.0, "buffer": 1.0, "inactivated": 0.1 * minutes}.get(label, 0) + RATES.get(label, 0) * minutes


def write_plate(folder, name, reads=31):
    labels = plate_labels()
    (folder / "reads").mkdir(exist_ok=True)
    (folder / "template").mkdir(exist_ok=True)
    lines = ["x"] * 28 + [",".join(["", "Time", "T", *[f"w{i}" for i in range(96)]])]
    for i in range(reads):
        minutes = 2 * i
        wells = [f"{B + M * amount(label, minutes)!r}" if label else "0.05" for label in labels]
        lines.append(",".join(["", f"1899-12-31 {minutes // 60:02d}:{minutes % 60:02d}:00", "37", *wells]))
    (folder / "reads" / name).write_text("\n".join(lines) + "\n")
    grid = [",".join(["", *map(str, range(1, 13))])]
    grid += [",".join(["ABCDEFGH"[r], *[labels[r * 12 + c] or "NA" for c in range(12)]]) for r in range(8)]
    (folder / "template" / name).write_text("\n".join(grid) + "\n")


@pytest.fixture(scope="module")
def reads(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("plates")
    for name in ("one.csv", "two.csv"):
        write_plate(folder, name)
    return labelled_reads(spark, str(folder / "reads"), str(folder / "template"), 29, 60).cache()


def test_kinetic_assay_finds_the_known_rates(spark, reads):
    result = kinetic_assay(reads, ["plate_id"])
    line = result.calibration.collect()
    assert len(line) == 2 and all(r["b"] == pytest.approx(B) and r["m"] == pytest.approx(M) for r in line)
    assert all(r["n"] == 6 * 31 and r["r2"] == pytest.approx(1) for r in line)
    top = {}
    for r in result.rates.collect():
        top.setdefault((r["plate_id"], r["label"]), r)
    assert {label for _, label in top} >= set(RATES) and len({p for p, _ in top}) == 2
    for (_, label), r in top.items():
        if label in RATES:
            assert r["max_slope"] == pytest.approx(RATES[label], rel=1e-9) and r["r2"] == pytest.approx(1)
    per_series = result.fits.groupBy("plate_id", "label").count().collect()
    assert {r["count"] for r in per_series} == {25}
    assert {r["label"] for r in result.progress.select("label").distinct().collect()} == {*RATES, "flat", "inactivated"}


def test_given_calibration_replaces_the_fit(spark, reads):
    given = spark.createDataFrame([("one.csv", B, M / 2), ("two.csv", B, M)], "plate_id string, b double, m double")
    best = kinetic_assay(reads, ["plate_id"], calibration=given).rates.where("label = 'enzA'").collect()
    assert {r["plate_id"]: round(r["max_slope"], 6) for r in best} == {"one.csv": 3.0, "two.csv": 1.5}


def test_last_read_set_to_sixty(spark, reads):
    short = kinetic_assay(reads.where("minutes < 40"), ["plate_id"], settings=RateSettings(last_minute=60.0))
    assert short.progress.agg(F.max("minutes")).first()[0] == 38
    assert short.reads.agg(F.max("minutes")).first()[0] == 60


def test_condition_assay_subtracts_the_control(spark, reads):
    at = reads.withColumn("condition", F.when(F.col("plate_id") == "one.csv", "pH4").otherwise("pH85"))
    pairs = [("enzA", "inactivated", "mean_1"), ("enzC", "inactivated", "mean_2")]
    result = condition_assay(at, ["plate_id", "condition"], pairs, StandardSettings(exclude="stdcurve_1"),
                             RateSettings(first_read=5, last_read=30, window=20, min_r2=None, min_slope=None))
    got = {}
    for r in result.rates.collect():
        got[(r["condition"], r["id"])] = r["max_slope"]
    assert got == {(c, i): pytest.approx(v) for c in ("pH4", "pH85") for i, v in (("mean_1", 1.4), ("mean_2", 2.9))}
    assert {r["count"] for r in result.fits.groupBy("condition", "id").count().collect()} == {6}
    assert {r["n"] for r in result.calibration.collect()} == {5 * 31}


def screen_reads(spark):
    rate = {"rfp": 0.0, "wt": 1.0, "c1": 2.0, "c2": 0.5}
    blank = {"urea": 0.30, "ethylurea": 0.70}
    rows = [("p", float(t), f"{c}_{s}_4np", blank[s] + (0.01 if c == "rfp" else 0.0) + B * (c != "rfp") + M * v * t)
            for t in range(60) for s in blank for c, v in rate.items()]
    return spark.createDataFrame(rows, "plate string, minutes double, label string, absorbance double")


def test_screen_fold_change(spark):
    line = spark.createDataFrame([("p", B, M)], "plate string, b double, m double")
    protein = spark.createDataFrame([("WT", 2000.0), ("C1", 1000.0), ("C2", 4000.0)], "sample string, nm_per_od double")
    settings = RateSettings(first_read=3, last_read=50, window=30, min_r2=None)
    plain = screen(screen_reads(spark), ["plate"], line, settings)
    got = {(r["substrate"], r["colony"]): r for r in plain.extra["fold_change"].collect()}
    assert set(got) == {(s, c) for s in ("urea", "ethylurea") for c in ("wt", "c1", "c2")}
    for s in ("urea", "ethylurea"):
        assert got[(s, "c1")]["max_slope"] == pytest.approx(2.0)
        assert got[(s, "c1")]["fold_change"] == pytest.approx(2.0)
        assert got[(s, "c2")]["fold_change"] == pytest.approx(0.5)
    scaled = screen(screen_reads(spark), ["plate"], line, settings, protein=protein)
    change = {(r["substrate"], r["colony"]): r["fold_change"] for r in scaled.extra["fold_change"].collect()}
    assert change[("urea", "c1")] == pytest.approx(4.0) and change[("urea", "c2")] == pytest.approx(0.25)
    means = scaled.extra["reference_fold_changes"].collect()
    assert {(r["substrate"], r["colony"], round(r["mean_fc"], 9)) for r in means} == {
        ("urea", "wt", 1.0), ("ethylurea", "wt", 1.0)}
    unblanked = screen(screen_reads(spark), ["plate"], line, settings, blank=None)
    assert unblanked.rates.where("colony = 'rfp'").where("max_slope > 1e-6").count() == 0


def test_clock_past_midnight_and_again(spark):
    clock = ["23:58:00", "23:59:30", "00:00:10", "12:00:00", "00:00:00"]
    rows = [("p", i, f"1899-12-31 {t}") for i, t in enumerate(clock)] + [("q", 0, "1899-12-31 00:10:00"), ("q", 1, "1899-12-31 00:12:00")]
    reads = spark.createDataFrame(rows, "plate_id string, read_idx long, time_text string")
    got = {(r["plate_id"], r["read_idx"]): r["minutes"] for r in sheet_minutes(reads).collect()}
    assert [got["p", i] for i in range(5)] == [0.0, 2.0, 2.0, 722.0, 1442.0] and [got["q", i] for i in range(2)] == [0.0, 2.0]


def test_screen_rates_do_not_depend_on_row_order(spark):
    """Reads of the same minute keep the order of read_idx, or of their amounts."""
    line = spark.createDataFrame([("p", B, M)], "plate string, b double, m double")
    rows = [("p", i, float(i // 2), "wt_urea_4np", B + M * (0.3 * i + (i * 7 % 5) * 0.1)) for i in range(60)]
    settings = RateSettings(first_read=3, last_read=50, window=10, min_r2=None)
    for columns in ("plate string, read_idx long, minutes double, label string, absorbance double",):
        for indexed in (True, False):
            found = set()
            for order in (rows, rows[::-1], rows[1::2] + rows[::2]):
                reads = spark.createDataFrame(order, columns)
                reads = reads if indexed else reads.drop("read_idx")
                found.add(tuple(tuple(r) for r in screen(reads, ["plate"], line, settings, blank=None).rates.collect()))
            assert len(found) == 1 and found.pop()
