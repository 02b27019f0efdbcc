"""Summaries and plot-ready tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ratewell import scale
from ratewell.functions.lines import known
from ratewell.operators.ordering import quantile_table, value_counts

QUARTILES = {"min": 0.0, "q1": 0.25, "median": 0.5, "q3": 0.75, "max": 1.0}


def five_number(df: DataFrame, keys: list[str], value: str, group_rows: int | None = None) -> DataFrame:
    """Minimum, quartiles, median, maximum, mean and count."""
    return quantile_table(df, keys, value, QUARTILES, mean="mean", count="n", group_rows=group_rows)


def frequency(df: DataFrame, by: list[str]) -> DataFrame:
    """Rows per group."""
    return df.groupBy(*by).agg(F.count(F.lit(1)).alias("n"))


def _box(counts: DataFrame, keys: list[str], value: str, group_rows: int | None) -> DataFrame:
    box = quantile_table(
        counts, keys, value, {k: QUARTILES[k] for k in ("q1", "median", "q3")}, group_rows=group_rows, counts=counts)
    reach = (F.col("q3") - F.col("q1")) * 1.5
    return box.withColumn("_lower", F.col("q1") - reach).withColumn("_upper", F.col("q3") + reach)


def box_stats(df: DataFrame, keys: list[str], value: str, group_rows: int | None = None) -> DataFrame:
    """Box-plot table: hinges, median, whisker ends within 1.5 IQR, outlier count.

    All of it comes from the counts of distinct values, so the rows are read once.
    """
    counts = scale.settle(value_counts(df, keys, value))
    rows = scale.join_dimension(counts, _box(counts, keys, value, group_rows), keys, group_rows=group_rows)
    inside = F.col(value).between(F.col("_lower"), F.col("_upper"))
    return rows.groupBy(*keys, "q1", "median", "q3").agg(
        F.min(F.when(inside, F.col(value))).alias("whisker_lo"),
        F.max(F.when(inside, F.col(value))).alias("whisker_hi"),
        F.sum(F.when(~inside, F.col("_count")).otherwise(0)).alias("n_outliers"),
    )


def box_outliers(df: DataFrame, keys: list[str], value: str, group_rows: int | None = None) -> DataFrame:
    """Rows beyond the whiskers."""
    box = _box(scale.settle(value_counts(df, keys, value)), keys, value, group_rows)
    rows = scale.join_dimension(df.where(known(value).isNotNull()), box, keys, group_rows=group_rows)
    return rows.where(~F.col(value).between(F.col("_lower"), F.col("_upper"))).select(*df.columns)


def density_histogram(df: DataFrame, facet: list[str], value: str, bins: int = 30) -> DataFrame:
    """Density per facet over bins shared by all facets.

    Bins are (max - min) / (bins - 1) wide, the first centred on the minimum, and
    hold their right edge.
    """
    rows = df.where(known(value).isNotNull())
    # Two numbers for the whole table.
    low, high = rows.agg(F.min(value), F.max(value)).first()
    if low is None:
        low = high = 0.0
    width = float(high - low) / (bins - 1) or 1.0
    left = float(low) - width / 2
    place = F.ceil((F.col(value) - F.lit(left)) / F.lit(width) - 1e-8) - 1
    counts = (
        rows.withColumn("bin", F.greatest(F.lit(0), F.least(F.lit(bins - 1), place)).cast("int"))
        .groupBy(*facet, "bin").agg(F.count(F.lit(1)).alias("count"))
    )
    totals = counts.groupBy(*facet).agg(F.sum("count").alias("_n"))
    return (
        scale.join_dimension(counts, totals, facet)
        .withColumn("centre", F.lit(float(low)) + F.col("bin") * F.lit(width))
        .withColumn("density", F.col("count") / (F.col("_n") * F.lit(width)))
        .drop("_n")
    )
