"""Writers of rate, layout and catalogue tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ratewell.functions.text import token


def write_rates(rates: DataFrame, path: str, partition_by: list[str] | None = None, fmt: str = "csv") -> None:
    """Rates from fast to slow, in folders per assay if asked.

    With folders the rows are grouped by folder and rate by a range shuffle, so a
    large assay is written by several tasks. Only folders that the rates have rows for are replaced, once
    all tasks are done; folders of other assays or amounts stay. Without folders the whole path is replaced.
    """
    fastest = F.col("max_slope").desc()
    ordered = (rates.orderBy(fastest) if not partition_by else
               rates.repartitionByRange(*partition_by, fastest).sortWithinPartitions(*partition_by, fastest))
    writer = ordered.write.mode("overwrite").format(fmt)
    if fmt == "csv":
        writer = writer.option("header", True)
    if partition_by:
        writer = writer.option("partitionOverwriteMode", "dynamic").partitionBy(*partition_by)
    writer.save(path)


def write_normalised(rates: DataFrame, path: str, amount: str = "enzyme_ul") -> None:
    """Normalised rates in one folder per enzyme amount; amounts written before stay."""
    write_rates(rates, path, [amount])


def write_layout_check(pairs: DataFrame, path: str) -> None:
    """Instrument and template names by position."""
    columns = pairs.select("plate_id", "position", "instrument_name", "template_name")
    columns.orderBy("plate_id", "position").write.mode("overwrite").option("header", True).csv(path)


def catalogue(rates: DataFrame, marker: str = "4NP_") -> DataFrame:
    """Catalogue of slopes over many assays, date and substrate taken from the file name."""
    tail = token("file_name", marker, -1)
    return rates.select(
        token(F.element_at(F.split("file_name", "/"), -1), "_", 1).alias("date"),
        "file_name", "org",
        F.bround("max_slope", 4).alias("max_slope"),
        F.bround("r2", 4).alias("r2"),
        F.regexp_replace(tail, r"(_[0-9])?_all_data_calculated_slopes\.csv", "").alias("substrate"),
    )


def write_catalogue(table: DataFrame, path: str) -> None:
    """Write the catalogue."""
    table.write.mode("overwrite").option("header", True).csv(path)
