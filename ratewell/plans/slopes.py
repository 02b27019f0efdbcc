"""Catalogue of the slopes of many assays."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ratewell import schemas
from ratewell.operators import report
from ratewell.sources.scans import scan_table
from ratewell.sources.sinks import catalogue

LABELLED_ABOVE = 0.2


def slope_catalogue(
    spark: SparkSession, paths: str | list[str], include: str = "_calculated_slopes.csv", exclude: str | None = None
) -> dict[str, DataFrame]:
    """All slope files of two substrates: summary, counts, box plot, labels and the catalogue."""
    rows = scan_table(spark, paths, schemas.RATES, include=include, exclude=exclude)
    rows = rows.withColumn("substrate", F.when(
        F.col("file_name").contains("butyrate"), "butyrate").otherwise("trimethylacetate"))
    return {
        "summary": report.five_number(rows, ["substrate"], "max_slope"),
        "counts": report.frequency(rows, ["substrate"]),
        "box": report.box_stats(rows, ["substrate"], "max_slope"),
        "labels": rows.where(F.col("max_slope") > LABELLED_ABOVE).select("substrate", "org", "max_slope"),
        "catalogue": catalogue(rows),
    }
