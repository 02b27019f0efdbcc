"""From exported sheets to labelled reads: the front of every plate analysis."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ratewell import scale
from ratewell.functions.clock import clock_seconds, whole_minutes
from ratewell.operators import cleaning, layout
from ratewell.operators.ordering import previous_value, running_total
from ratewell.sources import scans

DAY = 24 * 60 * 60


def sheet_minutes(
    reads: DataFrame, time: str = "time_text", out: str = "minutes", longest: int | None = None
) -> DataFrame:
    """Whole minutes since the first read of each plate, from the clock times of its sheet.

    A clock that goes back has passed midnight. ``longest`` is the caller's promise on the reads per
    plate; without it plates of very many reads are found by counting and numbered in slices.
    """
    plate, order = ["plate_id"], ["read_idx"]
    clocks = reads.withColumn("_clock", clock_seconds(time))
    steps = previous_value(clocks, plate, order, "_clock", "_before", longest=longest)
    next_day = F.when(F.col("_clock") < F.col("_before"), 1).otherwise(0)
    days = running_total(steps, plate, order, next_day, "_days", longest=longest)
    first = clocks.groupBy(*plate).agg(F.min_by("_clock", "read_idx").alias("_first"))
    seconds = F.col("_clock") + DAY * F.col("_days") - F.col("_first")
    return scale.join_dimension(days, first, plate).withColumn(out, whole_minutes(seconds)).drop(
        "_clock", "_before", "_days", "_first")


def labelled_reads(
    spark: SparkSession, reads: str | list[str], templates: str | list[str], header_line: int, last_line: int,
    first_column: int = 1, rows: int = 8, columns: int = 12, plate: Column | str = "file_name",
    include: str | None = None, exclude: str | None = None,
) -> DataFrame:
    """Long reads (plate_id, label, minutes, read_idx, absorbance) of all plates of a folder.

    Sheets of reads and of labels belong together by ``plate``. Reads with an empty cell are
    left out, and so are wells without a label.
    """
    wide = scans.scan_plate_reads(
        spark, reads, header_line, last_line, first_column, rows * columns, include, exclude, plate)
    complete = cleaning.drop_incomplete_reads(sheet_minutes(wide, longest=last_line - header_line))
    grid = scans.scan_label_grid(spark, templates, columns, plate)
    template = layout.flatten_grid(grid, ["plate_id"], "grid_row", [f"c{i}" for i in range(1, columns + 1)])
    long = layout.explode_wells(complete, ["plate_id", "minutes", "read_idx"], out="absorbance")
    return layout.label_wells(long, template, ["plate_id"]).drop("well_idx")
