"""Replicates, blanks and control series."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ratewell import scale
from ratewell.functions.lines import known
from ratewell.functions.text import token


def replicate_stats(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Mean, sample sd and count per key, without NaN; the sd of one value is NULL."""
    number = known(value)
    return df.groupBy(*keys).agg(
        F.avg(number).alias("mean"), F.stddev_samp(number).alias("sd"), F.count(number).alias("n"))


def attach_stats(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Replicate statistics on every row."""
    return scale.join_dimension(df, replicate_stats(df, keys, value), keys)


def subtract_control(
    df: DataFrame, on: list[str], series: str, value: str, pairs: list[tuple[str, str, str]], out: str = "mean"
) -> DataFrame:
    """Series minus its control at the same time, for pairs ``(sample, control, out_name)``.

    Repeats of a series are averaged first; a missing side gives NULL. Both sides
    are averaged in the same aggregation, so there is no join of series.
    """
    roles = scale.small_table(
        df.sparkSession,
        [row for s, c, name in pairs for row in ((s, name, "sample"), (c, name, "control"))],
        f"{series} string, id string, _role string",
    )
    sides = {r: F.avg(F.when(F.col("_role") == r, known(value))) for r in ("sample", "control")}
    return (
        df.join(roles, series)
        .groupBy(*on, "id").agg((sides["sample"] - sides["control"]).alias(out))
    )


def subtract_blank(df: DataFrame, on: list[str], is_blank: Column, value: str, out: str = "corrected") -> DataFrame:
    """Samples minus the mean blank of their group; groups without a blank or a sample drop."""
    flagged = df.withColumn("_blank", F.coalesce(is_blank, F.lit(False)))
    blanks = flagged.where("_blank").groupBy(*on).agg(F.avg(known(value)).alias("_mean"))
    return (
        scale.join_dimension(flagged.where(~F.col("_blank")), blanks, on)
        .withColumn(out, F.col(value) - F.col("_mean"))
        .drop("_blank", "_mean")
    )


def distinct_substrates(df: DataFrame, label: str, position: int = 2, sep: str = "_") -> DataFrame:
    """Lower-case substrates named in the labels."""
    name = F.lower(token(label, sep, position)).alias("substrate")
    return df.select(name).where(F.col("substrate").isNotNull()).distinct()
