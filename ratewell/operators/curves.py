"""Condition-response curves from rate tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ratewell import scale
from ratewell.functions.lines import known
from ratewell.functions.text import first_number, half_unit
from ratewell.operators.cleaning import cast_text, drop_header_rows


def clean_rates(rates: DataFrame, rate: str = "max_slope", drop: tuple[str, ...] = ("file_name",)) -> DataFrame:
    """Rate rows without provenance, repeated headers and repeats of a whole row."""
    rows = drop_header_rows(rates.drop(*drop), rate, rate)
    return cast_text(rows, [rate]).distinct()


def response_curve(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Curve points: mean, sample sd, mean - sd, mean + sd, count, over the values that are neither NULL nor NaN."""
    number = known(value)
    return (
        df.groupBy(*keys).agg(
            F.avg(number).alias("mean"), F.stddev_samp(number).alias("sd"), F.count(number).alias("n"))
        .withColumn("lo", F.col("mean") - F.col("sd"))
        .withColumn("hi", F.col("mean") + F.col("sd"))
    )


def ph_curve(rates: DataFrame, condition: str, value: str) -> DataFrame:
    """Curve over pH read from a condition text, with 85 meaning 8.5."""
    return response_curve(rates.withColumn("ph", half_unit(first_number(condition))), ["ph"], value)


def temperature_curve(rates: DataFrame, condition: str, value: str, keys: list[str] | None = None) -> DataFrame:
    """Curve over temperature read from a condition text, one per further key."""
    return response_curve(rates.withColumn("temperature", first_number(condition)), [*(keys or []), "temperature"], value)


def amount_from_file_name(df: DataFrame, date: str, file_name: str = "file_name", out: str = "amount") -> DataFrame:
    """Enzyme amount: the first number in the file name once the date is out."""
    return df.withColumn(out, first_number(F.regexp_replace(file_name, date, "")))


def pick_series(rates: DataFrame, series: str, amounts: dict[str, float], out: str = "enzyme_ul") -> DataFrame:
    """Give each replicate series the enzyme volume it stands for; others drop."""
    table = scale.small_table(rates.sparkSession, list(amounts.items()), f"{series} string, {out} double")
    return rates.join(table, series)
