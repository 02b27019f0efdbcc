"""HPLC time courses and chromatogram overlays from exported sheets."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ratewell import schemas
from ratewell.functions.text import first_match
from ratewell.operators import sections
from ratewell.sources.scans import scan_after_header, scan_cells

# Section markers, left-out series and sample classes of the assay: fixed values.
MARKERS = "DH|EV|p006"
LEFT_OUT = "p006_2_MB"
SAMPLE_CLASSES = [
    ("t1", " enzyme_0.25h"), ("t2", " enzyme_1.10h"), ("t3", " enzyme_17.6h"), ("t5", " enzyme_24.0h"),
    ("LBIIpt6", " enzyme_40.4h"), ("LBIIpbt6", "boiled_enzyme_40.4h"),
]


def hplc_time_course(
    spark: SparkSession, paths: str | list[str], columns: int, drop_enzymes: tuple[str, ...] = ("EV",),
    drop_ids: str | None = None, markers: str = MARKERS, left_out: tuple[str, ...] = (LEFT_OUT,),
) -> DataFrame:
    """Concentrations of all sections with the mean and sd per enzyme, time and compound."""
    rows = scan_cells(spark, paths, columns)
    first = F.get("cells", F.lit(1))
    cells = sections.section_table(rows.where(first.isNotNull()), ["file_name"], "line_no", "cells", first.rlike(markers))
    fields = sections.hplc_fields(cells)
    kept = fields.where(~F.col("enzyme").isin(*drop_enzymes)) if drop_enzymes else fields
    kept = kept.where(~F.col("variable").isin(*left_out)) if left_out else kept
    if drop_ids is not None:
        kept = kept.where(~F.col("idvar").rlike(drop_ids))
    return sections.time_course(kept)


def chromatogram_overlay(
    spark: SparkSession, paths: str | list[str], exclude: str | None = None,
    upper: float = 10.0, shown: tuple[float, float] | None = (3.0, 10.0), skip: int = 76,
    classes: list[tuple[str, str]] = SAMPLE_CLASSES,
) -> DataFrame:
    """Traces of many files, classed by file name and cut to the shown time."""
    trace = scan_after_header(spark, paths, schemas.CHROMATOGRAM, skip, exclude=exclude)
    classed = trace.withColumn("sample", first_match("file_name", classes))
    return sections.trace_window(classed, "time_min", upper, shown)
