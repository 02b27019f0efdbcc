"""Response curves from folders of rate files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ratewell import schemas
from ratewell.operators import curves, normalize
from ratewell.sources.scans import scan_headerless, scan_table

# Molecular weight of the enzyme (g/mol) and its stocks (mg/mL): fixed values.
G_PER_MOL = 52652.53
STOCK_MG_PER_ML = 0.22
HEATED_STOCK_MG_PER_ML = 0.48
# Factor per nmol of enzyme of the log curve: fixed value.
LOG_CURVE_PER_NMOL = 27.02703

CONDITION_COLUMNS = ["org", "max_slope", "r2", "intercept", "condition"]
NORMALISED = "org string, max_slope double, r2 double, intercept double, condition string, sec_slope double, nm_slope double"


def ph_curve(
    spark: SparkSession, paths: str | list[str], volume_ul: float | None = 20.0,
    mg_per_ml: float = STOCK_MG_PER_ML, include: str | None = None, exclude: str | None = None, divisor: float = 1.0,
) -> DataFrame:
    """pH curve over rate files per pH, of rates per nmol enzyme or plain (``volume_ul=None``)."""
    rows = scan_headerless(spark, paths, CONDITION_COLUMNS, include, exclude)
    rates = curves.clean_rates(rows)
    if volume_ul is None:
        return curves.ph_curve(rates, "condition", "max_slope")
    amount = normalize.enzyme_nmol(volume_ul, mg_per_ml, G_PER_MOL)
    return curves.ph_curve(normalize.per_enzyme(rates, amount, divisor), "condition", "nm_slope")


def stability_curve(
    spark: SparkSession, paths: str | list[str], label: str, volume_ul: float = 10.0,
    mg_per_ml: float = HEATED_STOCK_MG_PER_ML, include: str | None = None, exclude: str | None = None,
) -> DataFrame:
    """Rates left after heating over the temperature named in the series label."""
    rows = scan_table(spark, paths, schemas.RATES, include=include, exclude=exclude).where(F.col("org").rlike(label))
    amount = normalize.enzyme_nmol(volume_ul, mg_per_ml, G_PER_MOL)
    return curves.temperature_curve(normalize.per_enzyme(curves.clean_rates(rows), amount), "org", "nm_slope")


def normalised_rates(
    spark: SparkSession, paths: str | list[str], volumes: dict[str, float], mg_per_ml: float = STOCK_MG_PER_ML,
    include: str | None = None, exclude: str | None = None, divisor: float = 1.0,
) -> DataFrame:
    """Rates per nmol of enzyme for all series at once; ``volumes`` says what volume a series stands for."""
    rows = scan_table(spark, paths, schemas.CONDITION_RATES, include=include, exclude=exclude)
    picked = curves.pick_series(curves.clean_rates(rows), "org", volumes)
    return normalize.per_enzyme(picked, normalize.enzyme_nmol(F.col("enzyme_ul"), mg_per_ml, G_PER_MOL), divisor)


def temperature_curves(rates: DataFrame) -> DataFrame:
    """One temperature curve per enzyme volume."""
    return curves.temperature_curve(rates, "condition", "nm_slope", ["enzyme_ul"])


def log_temperature_curve(
    spark: SparkSession, paths: str | list[str], include: str | None = None, exclude: str | None = None
) -> DataFrame:
    """Temperature curve of the log10 rate."""
    rows = scan_table(spark, paths, schemas.CONDITION_RATES, include=include, exclude=exclude)
    rates = normalize.scaled_rates(curves.clean_rates(rows), LOG_CURVE_PER_NMOL)
    return curves.temperature_curve(rates, "condition", "log_slope")


def curve_family(
    spark: SparkSession, paths: str | list[str], date: str, include: str | None = None, exclude: str | None = "_5_|_1_"
) -> DataFrame:
    """Temperature curves over files of normalised rates, the enzyme amount taken from the file name."""
    rows = scan_table(spark, paths, NORMALISED, include=include, exclude=exclude)
    return curves.temperature_curve(curves.amount_from_file_name(rows, date), "condition", "nm_slope", ["amount"])
