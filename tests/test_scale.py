"""Size checks and the joins behind them."""

import pytest
from pyspark.sql import functions as F

from ratewell import scale


def facts(spark):
    rows = [("hot", i) for i in range(100)] + [(f"k{i % 20}", i) for i in range(100)] + [(None, i) for i in range(60)]
    return spark.createDataFrame(rows, "k string, v int").repartition(4)


def dims(spark):
    return spark.createDataFrame([("hot", 1), *[(f"k{i}", i) for i in range(0, 20, 2)]], "k string, d int")


def as_set(df):
    return sorted(map(str, df.collect()))


@pytest.mark.parametrize("how", ["inner", "left"])
@pytest.mark.parametrize("broadcast_bytes, group_rows", [(0, 50), (0, None), (120, 50)])
def test_join_paths_agree(spark, how, broadcast_bytes, group_rows):
    plain = facts(spark).join(dims(spark), ["k"], how)
    got = scale.join_dimension(facts(spark), dims(spark), ["k"], how, broadcast_bytes, group_rows)
    assert as_set(got.select("k", "v", "d")) == as_set(plain.select("k", "v", "d"))


def test_small_dimension_is_broadcast(spark):
    plan = scale.join_dimension(facts(spark), dims(spark), ["k"])._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan


def test_large_dimension_is_not_broadcast(spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        joined = scale.join_dimension(facts(spark), dims(spark), ["k"], broadcast_bytes=0)
        assert "SortMergeJoin" in joined._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_split_heavy_keeps_every_row(spark):
    split = scale.split_heavy(facts(spark), ["k"], 50)
    assert {r["k"] for r in split.heavy.collect()} == {"hot", None}
    assert split.heavy_rows == split.heavy.count() == 160
    assert split.light.count() == 100


def test_no_heavy_group(spark):
    split = scale.split_heavy(facts(spark), ["k"], 1000)
    assert split.heavy is None and split.light.count() == 260


def test_byte_size_counts_all_rows(spark):
    one = scale.byte_size(spark.createDataFrame([("abcd",)], "s string"))
    assert scale.byte_size(spark.createDataFrame([("abcd",)] * 50, "s string")) == 50 * one
    assert scale.byte_size(spark.createDataFrame([], "s string")) == 0


def test_given_checkpoint_dir_is_kept(spark):
    before = spark.sparkContext.getCheckpointDir()
    scale.ensure_checkpoint_dir(spark)
    assert spark.sparkContext.getCheckpointDir() == before
    assert scale.settle(spark.range(3)).count() == 3


def test_match_keys_treats_null_as_a_key(spark):
    null = spark.createDataFrame([(None,)], "k string")
    assert scale.match_keys(facts(spark), null, ["k"], "left_semi").count() == 60
    assert scale.match_keys(facts(spark), null, ["k"], "left_anti").select(F.col("k")).where("k is null").count() == 0


def test_size_of_rows_counts_null_fields(spark):
    """Rows of NULL numbers take as much room as others."""
    empty = spark.range(1000).select("id", *[F.lit(None).cast("double").alias(f"c{i}") for i in range(50)])
    assert scale.byte_size(empty) >= 1000 * 51 * 8
    assert not scale.fits_broadcast(empty, 400_000)
    assert scale.fits_broadcast(empty, 1_000_000)


def test_size_of_text_and_nested_values(spark):
    rows = spark.range(10).select(
        F.repeat(F.lit("x"), 1000).alias("text"), F.sequence(F.lit(1), F.lit(100)).alias("numbers"),
        F.array(F.struct(F.lit(1).alias("a"), F.lit(2).alias("b"))).alias("pairs"),
        F.array(F.array(F.lit(1))).alias("deep"), F.create_map(F.lit("k"), F.lit(1)).alias("map"), F.struct(F.lit("y").alias("z")).alias("s"))
    assert 10 * (1000 + 100 * 8) < scale.byte_size(rows) < 10 * 8000
    assert scale.byte_size(rows.limit(0)) == 0


def test_null_keys_meet_on_every_path(spark, monkeypatch):
    left = spark.createDataFrame([(None, 1), ("a", 2), ("b", 3), (None, 4)], "k string, v int")
    right = spark.createDataFrame([(None, 10), ("a", 20)], "k string, w int")
    want = [("a", 2, 20), ("b", 3, None), (None, 1, 10), (None, 4, 10)]
    for limit, rows in ((scale.BROADCAST_BYTES, scale.GROUP_ROWS), (0, scale.GROUP_ROWS), (0, 1)):
        got = scale.join_dimension(left, right, ["k"], "left", broadcast_bytes=limit, group_rows=rows).collect()
        assert sorted(map(tuple, got), key=lambda r: r[1]) == sorted(want, key=lambda r: r[1])
