"""Rates per enzyme, per protein and relative to a reference."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ratewell import scale
from ratewell.functions.lines import known


def enzyme_nmol(volume_ul: Column | float, mg_per_ml: Column | float, g_per_mol: Column | float) -> Column:
    """Amount of enzyme in a volume of a stock."""
    volume, stock, weight = (c if isinstance(c, Column) else F.lit(float(c)) for c in (volume_ul, mg_per_ml, g_per_mol))
    return F.try_divide(volume * (1 / 1000) * stock * (1 / 1000) * F.lit(1e9), weight)


def per_enzyme(rates: DataFrame, nmol: Column | float, divisor: float = 1.0, rate: str = "max_slope") -> DataFrame:
    """Rate per nmol of enzyme; ``divisor`` converts the time unit first."""
    amount = nmol if isinstance(nmol, Column) else F.lit(float(nmol))
    return (
        rates.withColumn("sec_slope", F.col(rate) / F.lit(float(divisor)))
        .withColumn("nm_slope", F.try_divide(F.col("sec_slope"), amount))
    )


def scaled_rates(rates: DataFrame, per_nmol: float, rate: str = "max_slope") -> DataFrame:
    """Rate per hour of half-minute reads, per nmol by a fixed factor, and its log10 (NULL below or at 0)."""
    return (
        rates.withColumn("hr_slope", F.col(rate) * 2 * 60)
        .withColumn("nm_slope", F.col(rate) * F.lit(float(per_nmol)))
        .withColumn("log_slope", F.log10("nm_slope"))
    )


def per_protein(
    rates: DataFrame, protein: DataFrame, on: str, sample: str, concentration: str, rate: str = "max_slope"
) -> DataFrame:
    """Rate over protein concentration (nM to uM), joined on the lower-case sample name.

    A sample listed twice would double its rates, so it is refused.
    """
    table = scale.settle(protein.select(F.lower(sample).alias(on), F.col(concentration).alias("_protein")))
    if not table.groupBy(on).count().where("count > 1").isEmpty():
        raise ValueError(f"{sample} names a sample twice")
    return (
        scale.join_dimension(rates, table, [on], "left", settled=True)
        .withColumn(rate, F.try_divide(F.col(rate), F.col("_protein") / 1000))
        .drop("_protein")
    )


def reference_means(df: DataFrame, by: list[str], group: str, names: list[str], value: str, out: str) -> DataFrame:
    """Mean of the named reference groups."""
    return df.where(F.col(group).isin(names)).groupBy(*by, group).agg(F.avg(known(value)).alias(out))


def fold_change(
    df: DataFrame, by: list[str], is_reference: Column, value: str, reference: str = "reference_mean"
) -> DataFrame:
    """Value over the mean of the reference rows with the same key; NULL without a reference."""
    means = df.where(is_reference).groupBy(*by).agg(F.avg(known(value)).alias(reference))
    return scale.join_dimension(df, means, by, "left").withColumn(
        "fold_change", F.try_divide(F.col(value), F.col(reference)))
