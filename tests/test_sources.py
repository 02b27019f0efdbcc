"""Scans and sinks on files written by the test."""

import pytest
from pyspark.sql import functions as F

from ratewell import schemas
from ratewell.functions.clock import clock_minutes
from ratewell.operators import layout
from ratewell.sources import scans, sinks


@pytest.fixture
def small_blocks(spark):
    """Split files into blocks of a few lines."""
    spark.conf.set("spark.sql.files.maxPartitionBytes", "64")
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    yield spark
    spark.conf.unset("spark.sql.files.maxPartitionBytes")
    spark.conf.unset("spark.sql.files.openCostInBytes")


def test_line_numbers_across_blocks(small_blocks, tmp_path):
    for name, count in (("one.csv", 100), ("two.csv", 57)):
        (tmp_path / name).write_text("".join(f"{name} line {i}\n" for i in range(1, count + 1)))
    lines = scans.numbered_lines(small_blocks, str(tmp_path))
    assert lines.select(F.spark_partition_id()).distinct().count() > 1
    rows = lines.collect()
    assert len(rows) == 157
    assert all(r["value"] == f"{r['file_name']} line {r['line_no']}" for r in rows)


def plate_csv(reads=5, wells=96, start=29):
    lines = [f"preamble {i}" for i in range(1, start)]
    names = [f"{r}{c}" for r in "ABCDEFGH" for c in range(1, 13)][:wells]
    lines.append(",".join(["", "Time", "T° 410", *names]))
    for i in range(reads):
        values = [f"{w / 100 + i}" for w in range(wells)]
        if i == 2:
            values[3] = ""
        lines.append(",".join(["", f"1899-12-31 00:{2 * i:02d}:00", "37.1", *values]))
    return "\n".join([*lines, "trailer,x"]) + "\n"


def test_plate_rectangle(spark, tmp_path):
    (tmp_path / "assay_a.csv").write_text(plate_csv())
    (tmp_path / "~assay_a.csv").write_text(plate_csv())
    reads = scans.scan_plate_reads(spark, str(tmp_path), 29, 34, exclude="~|setup|Template")
    assert [f.dataType for f in reads.schema] == [f.dataType for f in schemas.PLATE_READS]
    assert reads.columns == schemas.PLATE_READS.fieldNames()
    rows = reads.withColumn("minutes", clock_minutes("time_text")).orderBy("read_idx").collect()
    assert [(r["plate_id"], r["read_idx"], r["minutes"]) for r in rows] == [("assay_a.csv", i, 2.0 * i) for i in range(5)]
    assert rows[1]["temperature_c"] == 37.1 and len(rows[1]["wells"]) == 96
    assert rows[1]["wells"][95] == pytest.approx(1.95) and rows[2]["wells"][3] is None


def test_instrument_names_against_template(spark, tmp_path):
    (tmp_path / "reads").mkdir()
    (tmp_path / "reads" / "plate.csv").write_text(plate_csv())
    (tmp_path / "template").mkdir()
    grid = [",".join(["", *map(str, range(1, 13))])]
    grid += [",".join([r, *[f"{r}_{c}" if (r, c) != ("A", 1) else "NA" for c in range(1, 13)]]) for r in "ABCDEFGH"]
    (tmp_path / "template" / "plate.csv").write_text("\n".join(grid) + "\n")
    labels = scans.scan_label_grid(spark, str(tmp_path / "template"))
    wells = layout.flatten_grid(labels, ["plate_id"], "grid_row", [f"c{i}" for i in range(1, 13)])
    assert set(wells.columns) == set(schemas.PLATE_MAP.fieldNames())
    names = scans.scan_instrument_names(spark, str(tmp_path / "reads"), 29)
    assert [r["instrument_name"] for r in names.orderBy("position").limit(3).collect()] == ["Time", "T° 410", "A1"]
    template = wells.where("label is not null").select(
        "plate_id", (F.col("well_idx") + 2).alias("position"), F.col("label").alias("template_name"))
    pairs = layout.layout_check(names, template, ["plate_id"], "position")
    states = {r["state"]: r["count"] for r in pairs.groupBy("state").count().collect()}
    assert states == {"paired": 95, "no template": 3}
    sinks.write_layout_check(pairs, str(tmp_path / "check"))
    assert spark.read.option("header", True).csv(str(tmp_path / "check")).count() == 98


def test_chromatogram_after_preamble(small_blocks, tmp_path):
    body = "".join(f"{i / 10},{i * 2}\n" for i in range(40))
    (tmp_path / "LB_t1.csv").write_text("".join(f"preamble {i}\n" for i in range(76)) + "time (min),value (mAU)\n" + body)
    trace = scans.scan_after_header(small_blocks, str(tmp_path), schemas.CHROMATOGRAM, 76)
    rows = trace.orderBy("line_no").collect()
    assert len(rows) == 40
    assert (rows[0]["time_min"], rows[0]["value_m_au"]) == (0.0, 0.0)
    assert (rows[39]["time_min"], rows[39]["value_m_au"]) == (3.9, 78.0)


def test_tables_tabs_and_provenance(spark, tmp_path):
    (tmp_path / "a.tsv").write_text("Sample\tConc\nC1\t5.5\n")
    (tmp_path / "b.tsv").write_text("Sample\tConc\nC2\t\n")
    got = scans.scan_table(spark, str(tmp_path), "sample string, conc double", sep="\t").orderBy("file_name").collect()
    assert [tuple(r) for r in got] == [("C1", 5.5, "a.tsv"), ("C2", None, "b.tsv")]
    only = scans.scan_table(spark, str(tmp_path), "sample string, conc double", sep="\t", include="^b")
    assert only.count() == 1


def test_headerless_keeps_header_rows(spark, tmp_path):
    (tmp_path / "pH4.csv").write_text("org,max_slope,r2,intercept,pH\nmean_1,0.5,0.9,1,pH4\n")
    rows = scans.scan_headerless(spark, str(tmp_path), ["org", "max_slope", "r2", "intercept", "condition"])
    assert sorted(r["max_slope"] for r in rows.collect()) == ["0.5", "max_slope"]


def test_rates_round_trip_per_assay(spark, tmp_path):
    rates = spark.createDataFrame(
        [("x", "a", 1.0), ("x", "b", 3.0), ("y", "c", 2.0)], "assay string, org string, max_slope double")
    sinks.write_rates(rates, str(tmp_path / "out"), ["assay"], "parquet")
    assert sorted(p.name for p in (tmp_path / "out").glob("assay=*")) == ["assay=x", "assay=y"]
    back = spark.read.parquet(str(tmp_path / "out")).where("assay = 'x'")
    assert {r["org"] for r in back.collect()} == {"a", "b"}
    sinks.write_rates(rates, str(tmp_path / "flat"))
    text = sorted((tmp_path / "flat").glob("part-*"))
    lines = [line for p in text for line in p.read_text().splitlines() if not line.startswith("assay,")]
    assert [line.split(",")[1] for line in lines] == ["b", "c", "a"]
    sinks.write_normalised(rates.withColumn("enzyme_ul", F.lit(2.0)), str(tmp_path / "norm"))
    assert [p.name for p in (tmp_path / "norm").glob("enzyme_ul=*")] == ["enzyme_ul=2.0"]


def test_normalised_rates_keep_other_amounts(spark, tmp_path):
    rates = spark.createDataFrame([("a", 1.0, 20), ("b", 2.0, 2), ("c", 3.0, 2)], "org string, max_slope double, enzyme_ul int")
    path = str(tmp_path / "norm")
    sinks.write_normalised(rates.where("enzyme_ul = 20"), path)
    sinks.write_normalised(rates.where("enzyme_ul = 2"), path)
    back = spark.read.option("header", True).csv(path)
    assert {(r["org"], int(r["enzyme_ul"])) for r in back.collect()} == {("a", 20), ("b", 2), ("c", 2)}
    sinks.write_normalised(rates.where("org = 'b'"), path)
    assert {r["org"] for r in spark.read.option("header", True).csv(path).collect()} == {"a", "b"}


def test_catalogue(spark, tmp_path):
    rows = spark.createDataFrame(
        [("output//20230421_64DHH_4NP_butyrate_1_all_data_calculated_slopes.csv", "p", 0.123456, 0.99996),
         ("20230422_64DHH_4NP_trimethylacetate_all_data_calculated_slopes.csv", "q", 0.00005, 0.5)],
        "file_name string, org string, max_slope double, r2 double")
    table = sinks.catalogue(rows)
    got = sorted(map(tuple, table.drop("file_name").collect()))
    assert got == [("20230421", "p", 0.1235, 1.0, "butyrate"), ("20230422", "q", 0.0, 0.5, "trimethylacetate")]
    sinks.write_catalogue(table, str(tmp_path / "cat"))
    assert spark.read.option("header", True).csv(str(tmp_path / "cat")).columns == table.columns
