"""Sheets with stacked sections, HPLC fields and chromatograms."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ratewell import scale
from ratewell.functions.text import token
from ratewell.operators.controls import attach_stats
from ratewell.operators.ordering import running_total


def number_sections(
    rows: DataFrame, sheet: list[str], order: list[str], is_marker: Column, group_rows: int | None = None
) -> DataFrame:
    """Add ``section``: how many marker rows the sheet has had; rows before the first are 0."""
    marker = F.coalesce(is_marker, F.lit(False)).cast("int")
    return running_total(rows, sheet, order, marker, "section", group_rows=group_rows)


def section_table(
    rows: DataFrame, sheet: list[str], row: str, cells: str, is_marker: Column, group_rows: int | None = None
) -> DataFrame:
    """Split sheets at their marker rows and melt each section.

    A marker row opens a section and names its columns; the first cell of every
    other row is the time. One row per data cell comes out:
    sheet, section, row, time, variable, value.
    """
    numbered = number_sections(
        rows.withColumn("_marker", F.coalesce(is_marker, F.lit(False))), sheet, [row], F.col("_marker"), group_rows)
    opened = numbered.where(F.col("section") > 0)
    headers = opened.where("_marker").select(*sheet, "section", F.col(cells).alias("_names"))
    data = scale.join_dimension(opened.where(~F.col("_marker")), headers, [*sheet, "section"], group_rows=group_rows)
    pairs = F.slice(F.arrays_zip(F.col("_names").alias("variable"), F.col(cells).alias("value")), 2, F.size("_names"))
    return (
        data.select(*sheet, "section", row, F.get(cells, F.lit(0)).alias("time"), F.explode(pairs).alias("_cell"))
        .select(*sheet, "section", row, "time", "_cell.variable", "_cell.value")
        .where(F.col("variable").isNotNull())
    )


def hplc_fields(cells: DataFrame, variable: str = "variable", time: str = "time", value: str = "value") -> DataFrame:
    """Enzyme, replicate, compound, hours, concentration and composite id of HPLC cells."""
    return (
        cells.withColumns({
            "enzyme": token(variable, "_", 1),
            "biorep": token(variable, "_", 2),
            "compound": token(variable, "_", 3),
            "time_hrs": token(time, "h", 1).try_cast("double"),
            "conc": F.trim(token(value, " ", 1)).try_cast("double"),
        })
        .withColumn("idvar", F.concat_ws("_", "enzyme", time, "compound"))
    )


def time_course(fields: DataFrame) -> DataFrame:
    """HPLC cells with the mean and sd of their enzyme, time and compound."""
    return attach_stats(fields, ["idvar"], "conc")


def trace_window(
    trace: DataFrame, time: str, upper: float, shown: tuple[float, float] | None = None
) -> DataFrame:
    """Chromatogram before ``upper`` minutes, clipped to the shown range if given."""
    kept = trace.where(F.col(time) < upper)
    return kept if shown is None else kept.where(F.col(time).between(*shown))
