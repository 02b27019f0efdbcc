"""Positions, running sums and quantiles: the spread path equals the plain one."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from ratewell.operators.ordering import number_rows, previous_value, quantile_table, running_total


def skewed(spark, rows=600, seed=3):
    """Key ``a`` holds a third of the rows, one key is NULL."""
    rng = random.Random(seed)
    keys = ["a"] * (rows // 3) + [rng.choice(["b", "c", None]) for _ in range(rows - rows // 3)]
    data = [(k, i * 7919 % 1009, rng.randint(0, 5), rng.gauss(0, 1)) for i, k in enumerate(keys)]
    rng.shuffle(data)
    return spark.createDataFrame(data, "k string, pos int, amount int, value double").repartition(5)


def expected_total(rows, amount):
    total, out = {}, {}
    for r in sorted(rows, key=lambda r: r["pos"]):
        total[r["k"]] = total.get(r["k"], 0) + amount(r)
        out[(r["k"], r["pos"])] = total[r["k"]]
    return out


@pytest.mark.parametrize("group_rows_of", [10_000, 7])
def test_previous_value(spark, group_rows_of):
    rows = [(k, i, None if i % 5 == 0 else i * 1.5) for k, n in (("a", 60), ("b", 3), (None, 41)) for i in range(n)]
    df = spark.createDataFrame(rows, "k string, pos int, v double").repartition(5)
    got = {(r["k"], r["pos"]): r["before"] for r in previous_value(
        df, ["k"], ["pos"], "v", "before", group_rows=group_rows_of).collect()}
    assert got == {(k, i): None if i == 0 or (i - 1) % 5 == 0 else (i - 1) * 1.5 for k, i, _ in rows}


@pytest.mark.parametrize("group_rows", [None, 150, 40])
def test_running_total_any_group_size(spark, group_rows):
    df = skewed(spark)
    want = expected_total(df.collect(), lambda r: r["amount"])
    got = running_total(df, ["k"], ["pos"], F.col("amount"), "total", group_rows=group_rows)
    assert {(r["k"], r["pos"]): r["total"] for r in got.collect()} == want
    assert set(got.columns) == {"k", "pos", "amount", "value", "total"}


@pytest.mark.parametrize("group_rows", [None, 60])
def test_number_rows(spark, group_rows):
    df = skewed(spark)
    want = expected_total(df.collect(), lambda r: 1)
    got = number_rows(df, ["k"], ["pos"], "place", group_rows=group_rows)
    assert {(r["k"], r["pos"]): r["place"] for r in got.collect()} == want


def test_needs_a_key(spark):
    with pytest.raises(ValueError):
        number_rows(skewed(spark), [], ["pos"], "place")


@pytest.mark.parametrize("group_rows", [None, 100])
def test_quantiles_match_linear_interpolation(spark, group_rows):
    df = skewed(spark).withColumn("value", F.round("value", 1)).where("k is not null")
    df = df.unionByName(df.limit(1).withColumn("value", F.lit(None).cast("double")))
    values = {}
    for r in df.collect():
        if r["value"] is not None:
            values.setdefault(r["k"], []).append(r["value"])
    probabilities = {"min": 0, "q1": 0.25, "mid": 0.5, "q3": 0.75, "p97": 0.97, "max": 1}
    got = {r["k"]: r for r in quantile_table(df, ["k"], "value", probabilities, group_rows=group_rows).collect()}
    assert set(got) == set(values)
    for k, v in values.items():
        for name, p in probabilities.items():
            assert got[k][name] == pytest.approx(np.quantile(v, p), abs=1e-12)


def test_quartiles_of_four_numbers(spark):
    df = spark.createDataFrame([("x", float(v)) for v in (1, 2, 4, 9)], "k string, value double")
    row = quantile_table(df, ["k"], "value", {"q1": 0.25, "q2": 0.5, "q3": 0.75}).first()
    assert (row["q1"], row["q2"], row["q3"]) == (1.75, 3.0, 5.25)


@pytest.mark.parametrize("group_rows", [None, 40])
def test_group_totals(spark, group_rows):
    df = skewed(spark)
    want = {r["k"]: r["s"] for r in df.groupBy("k").agg(F.sum("amount").alias("s")).collect()}
    got = running_total(df, ["k"], ["pos"], F.col("amount"), "upto", group_rows=group_rows, total="all_of_it")
    assert {r["k"]: r["all_of_it"] for r in got.collect()} == want
    assert got.count() == df.count() and set(got.columns) == {*df.columns, "upto", "all_of_it"}


def test_narrowed_quantiles_of_odd_values(spark):
    """Values over all magnitudes, neighbours in the last bit, whole numbers beyond 2 ** 53, one value, none."""
    tight = [1.0 + i * 2.0 ** -52 for i in range(40)]
    wide = [s * 10.0 ** e for s in (-1, 1) for e in range(-300, 301, 20)] + [0.0, float("inf"), float("nan")]
    rows = [("tight", v) for v in tight] + [("wide", v) for v in wide] + [(None, 5.0)] * 30 + [("none", None)] * 30
    df = spark.createDataFrame(rows, "k string, value double")
    probabilities = {"min": 0, "q1": 0.25, "mid": 0.5, "p9": 0.9, "max": 1}
    got = {r["k"]: r for r in quantile_table(df, ["k"], "value", probabilities, group_rows=0, count="n").collect()}
    want = {r["k"]: r for r in quantile_table(df, ["k"], "value", probabilities, count="n").collect()}
    assert got == want and set(got) == {"tight", "wide", None}
    whole = spark.createDataFrame([("w", 2**60 + i) for i in range(50)], "k string, value long")
    row = quantile_table(whole, ["k"], "value", {"min": 0, "max": 1}, group_rows=0).first()
    assert (row["min"], row["max"]) == (float(2**60), float(2**60 + 49))
