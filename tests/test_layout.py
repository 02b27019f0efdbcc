"""Plate templates."""

import pytest
from pyspark.sql import functions as F

from ratewell.functions.text import clean_names, contains_any, first_match, first_number, half_unit, strip_replicate, token
from ratewell.operators import cleaning, layout


def labels(spark, names, plate="p"):
    return spark.createDataFrame([(plate, i, n) for i, n in enumerate(names)], "plate_id string, well_idx int, label string")


def unique(spark, names):
    got = layout.unique_labels(labels(spark, names), ["plate_id"], "label", ["well_idx"])
    return [r["unique_label"] for r in sorted(got.collect(), key=lambda r: r["well_idx"])]


def test_flatten_is_row_major(spark):
    grid = spark.createDataFrame([("p", 1, "c", None), ("p", 0, "a", "b")], "plate_id string, grid_row int, c1 string, c2 string")
    wells = layout.flatten_grid(grid, ["plate_id"], "grid_row", ["c1", "c2"]).orderBy("well_idx").collect()
    assert [(r["well_idx"], r["well"], r["label"]) for r in wells] == [(0, "A1", "a"), (1, "A2", "b"), (2, "B1", "c"), (3, "B2", None)]


@pytest.mark.parametrize("columns, index, name", [(12, 95, "H12"), (24, 383, "P24"), (48, 1535, "AF48"), (12, 0, "A1")])
def test_well_names(spark, columns, index, name):
    assert spark.range(1).select(layout.well_name(F.lit(index), columns)).first()[0] == name


@pytest.mark.parametrize("names, want", [
    (["a", "a", "a", "b"], ["a", "a.1", "a.2", "b"]),
    (["a", "a", "a.1"], ["a", "a.2", "a.1"]),
    (["a", "a", "a", "a", "a.1", "a.3"], ["a", "a.2", "a.4", "a.5", "a.1", "a.3"]),
    (["a.1", "a.1", "a", "a"], ["a.1", "a.1.1", "a", "a.2"]),
    (["x.01", "x", "x"], ["x.01", "x", "x.1"]),
    (["s_0.5", "s_0.5", "s_0"], ["s_0.5", "s_0.5.1", "s_0"]),
])
def test_unique_labels(spark, names, want):
    assert unique(spark, names) == want


def test_unique_labels_per_plate(spark):
    both = labels(spark, ["a", "a"]).unionByName(labels(spark, ["a"], "q"))
    got = layout.unique_labels(both, ["plate_id"], "label", ["well_idx"]).collect()
    assert {(r["plate_id"], r["well_idx"]): r["unique_label"] for r in got} == {("p", 0): "a", ("p", 1): "a.1", ("q", 0): "a"}


def test_strip_replicate_takes_one_digit(spark):
    df = spark.createDataFrame([("a.1",), ("a.10",), ("stdcurve_0.5",), ("a",)], "s string")
    assert [r[0] for r in df.select(strip_replicate("s")).collect()] == ["a", "a0", "stdcurve_0", "a"]


def test_label_wells_drops_unlabelled_wells(spark):
    reads = spark.createDataFrame([("p", 0, [1.0, 2.0, 3.0])], "plate_id string, read_idx int, wells array<double>")
    observations = layout.explode_wells(reads, ["plate_id", "read_idx"])
    got = layout.label_wells(observations, labels(spark, ["a", None, "inactivated"]), ["plate_id"]).collect()
    assert {(r["label"], r["value"]) for r in got} == {("a", 1.0), ("inactivated", 3.0)}


def test_layout_check_shows_both_sides(spark):
    instrument = spark.createDataFrame([("p", 0, "A1"), ("p", 1, "A2")], "plate_id string, position int, instrument_name string")
    template = spark.createDataFrame([("p", 1, "x"), ("p", 2, "y")], "plate_id string, position int, template_name string")
    got = layout.layout_check(instrument, template, ["plate_id"], "position").collect()
    assert {(r["position"], r["state"]) for r in got} == {(0, "no template"), (1, "paired"), (2, "no well")}


def test_layout_check_of_a_plate_without_id(spark):
    instrument = spark.createDataFrame([(None, 0, "A1"), (None, 1, "A2")], "plate_id string, position int, instrument_name string")
    template = spark.createDataFrame([(None, 1, "x"), ("q", None, "y")], "plate_id string, position int, template_name string")
    got = layout.layout_check(instrument, template, ["plate_id"], "position").collect()
    assert {(r["plate_id"], r["position"], r["state"]) for r in got} == {
        (None, 0, "no template"), (None, 1, "paired"), ("q", None, "no well")}


def test_cyclic_tags(spark):
    wells = labels(spark, ["wt", "mutant", "x", "mutant", "mutant", "mutant"])
    rep = wells.select(layout.cyclic_replicate(F.col("label"), F.col("well_idx"))).collect()
    assert [r[0] for r in rep][:4] == ["wt_rep1", "mutant_rep2", "x_rep3", "mutant_rep1"]
    tagged = layout.tag_matching(wells, ["plate_id"], "label", ["well_idx"], "mutant").orderBy("well_idx")
    assert [r["label"] for r in tagged.collect()] == ["wt", "mutant_1", "x", "mutant_2", "mutant_3", "mutant_1"]


def test_mask_and_grid_rows(spark):
    wells = labels(spark, [f"w{i}" for i in range(96)]).withColumn("condition", F.lit("35"))
    masks = spark.createDataFrame([("35", 49, 72), ("25", 1, 24)], "condition string, lo int, hi int")
    left = sorted(r["well_idx"] for r in layout.mask_wells(wells, masks, "condition").collect())
    assert left == [*range(48), *range(72, 96)]
    rows = sorted(r["well_idx"] for r in layout.keep_grid_rows(wells, 3, 4, 12).collect())
    assert rows == list(range(24, 48))


def test_wells_near_match(spark):
    names = ["other"] * 40
    for i in (20, 21, 22):
        names[i] = "21_4_sample"
    got = layout.wells_near_match(labels(spark, names), ["plate_id"], F.col("label").rlike("21_4"))
    assert sorted(r["well_idx"] for r in got.collect()) == [*range(8, 14), 20, 21, 22, 23, 24, 25]


def test_wells_near_match_of_a_plate_without_id(spark):
    wells = labels(spark, ["hit" if i == 14 else "other" for i in range(20)])
    both = wells.unionByName(wells.withColumn("plate_id", F.lit(None).cast("string")))
    both = both.unionByName(both.where("well_idx = 17"))
    got = [(r["plate_id"], r["well_idx"]) for r in layout.wells_near_match(both, ["plate_id"], F.col("label") == "hit").collect()]
    expected = [*range(2, 8), 14, 17, 17]
    for plate in {p for p, _ in got}:
        assert sorted(w for p, w in got if p == plate) == expected
    assert None in {p for p, _ in got}


def test_drop_incomplete_reads(spark):
    reads = spark.createDataFrame(
        [(0, "t", [1.0, 2.0]), (1, "t", [1.0, None]), (2, None, [1.0, 2.0])], "read_idx int, time_text string, wells array<double>")
    assert [r["read_idx"] for r in cleaning.drop_incomplete_reads(reads).collect()] == [0]


def test_drop_incomplete_long(spark):
    rows = [("p", 0, 1.0), ("p", 0, 2.0), ("p", 1, None), ("p", 1, 2.0), ("q", 1, 3.0)]
    df = spark.createDataFrame(rows, "plate_id string, read_idx int, value double")
    left = cleaning.drop_incomplete_long(df, ["plate_id", "read_idx"], "value")
    assert sorted((r["plate_id"], r["read_idx"]) for r in left.collect()) == [("p", 0), ("p", 0), ("q", 1)]


def test_drop_incomplete_long_with_unknown_reads(spark):
    rows = [(None, 0, 1.0), (None, 0, None), (None, 1, 2.0), ("p", None, None), ("p", None, 1.0)]
    df = spark.createDataFrame(rows, "plate_id string, read_idx int, value double")
    left = cleaning.drop_incomplete_long(df, ["plate_id", "read_idx"], "value")
    assert [tuple(r) for r in left.collect()] == [(None, 1, 2.0)]


def test_the_text_nan_is_missing(spark):
    df = spark.createDataFrame([("k", "NaN", "7"), ("k", "1.5", "NaN"), ("k", "x", "8")], "k string, a string, b string")
    got = cleaning.cast_text(cleaning.cast_text(df, ["a"]), ["b"], "bigint")
    assert [(r["a"], r["b"]) for r in got.collect()] == [(None, 7), (1.5, None), (None, 8)]
    numbers = df.select(F.lit(1).alias("id"), "k", F.col("a").try_cast("double").alias("v"))
    assert cleaning.spread(numbers, ["id"], "k", ["k"], "v").first()["k"] == 1.5


def test_substring_drops_ignore_case(spark):
    df = spark.createDataFrame([("Paracetamol_1",), ("urea",), ("TrimethylAcetate",)], "variable string")
    kept = cleaning.drop_labels_containing(df, "variable", ["trimethylacet", "PARACET"])
    assert [r[0] for r in kept.collect()] == ["urea"]
    wide = spark.createDataFrame([(1, 2, 3)], "time int, mean_1 int, NA_x int")
    assert cleaning.drop_columns_containing(wide, ["na_"]).columns == ["time", "mean_1"]
    assert cleaning.keep_columns_containing(wide, ["TIME", "mean_"]).columns == ["time", "mean_1"]
    assert [r[0] for r in df.select(contains_any("variable", ["UREA"])).collect()] == [False, True, False]


def test_header_names():
    assert clean_names(["Time", "T° 410", "value (mAU)", "Time", "", "8x"]) == ["time", "t_410", "value_m_au", "time_2", "x", "x8x"]


def test_clean_header_on_a_table(spark):
    assert cleaning.normalise_header(spark.createDataFrame([(1, 2)], "`Time (min)` int, Value int")).columns == ["time_min", "value"]


def test_tokens(spark):
    one = spark.createDataFrame([("pH4_stdcurve_5",)], "s string")
    row = one.select(token("s", "_", 1), token("s", "_", -1), token("s", "_", -2), token("s", "_", 9)).first()
    assert tuple(row) == ("pH4", "5", "stdcurve", None)


@pytest.mark.parametrize("text, number", [
    ("pH85_", 85.0), ("21_4degrees", 21.0), ("Lacticaseib_70°C_rep1", 70.0), ("none", None), ("-3.5 C", -3.5),
    ("1,234 x", 1234.0), (".5 x", 0.5)])
def test_first_number(spark, text, number):
    assert spark.createDataFrame([(text,)], "s string").select(first_number("s")).first()[0] == number


@pytest.mark.parametrize("number, fixed", [(85.0, 8.5), (95.0, 9.5), (5.0, 5.0), (8.0, 8.0), (10.0, 10.0), (105.0, 105.0), (8.5, 8.5)])
def test_half_units(spark, number, fixed):
    assert spark.createDataFrame([(number,)], "n double").select(half_unit("n")).first()[0] == fixed


def test_first_match_wins(spark):
    df = spark.createDataFrame([("t1_t2",), ("t2",), ("zz",)], "f string")
    assert [r[0] for r in df.select(first_match("f", [("t1", "one"), ("t2", "two")])).collect()] == ["one", "two", None]


def test_melt_and_spread(spark):
    wide = spark.createDataFrame([(0, 1.0, 2.0), (1, 3.0, 4.0)], "time int, a double, b double")
    long = cleaning.melt(wide, ["time"], ["a", "b"])
    assert long.count() == 4
    back = cleaning.spread(long, ["time"], "variable", ["a", "b"], "value")
    assert sorted(map(tuple, back.collect())) == sorted(map(tuple, wide.collect()))


def test_repeated_headers_go(spark):
    df = spark.createDataFrame([("1.5",), ("max_slope",), (None,)], "max_slope string")
    kept = cleaning.cast_text(cleaning.drop_header_rows(df, "max_slope", "max_slope"), ["max_slope"])
    assert [r[0] for r in kept.collect()] == [1.5, None]
