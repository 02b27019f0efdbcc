"""Scans of plate exports, rate tables and chromatograms."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ratewell import scale
from ratewell.functions.text import clean_names


def keep_files(df: DataFrame, include: str | None = None, exclude: str | None = None,
               file_name: str = "file_name") -> DataFrame:
    """Keep rows of files whose name matches ``include`` and not ``exclude``."""
    if include is not None:
        df = df.where(F.col(file_name).rlike(include))
    if exclude is not None:
        df = df.where(~F.col(file_name).rlike(exclude))
    return df


def scan_table(
    spark: SparkSession, paths: str | list[str], schema: T.StructType | str, sep: str = ",", header: bool = True,
    include: str | None = None, exclude: str | None = None,
) -> DataFrame:
    """Delimited files with a declared schema; ``file_name`` says where a row is from."""
    rows = spark.read.schema(schema).option("sep", sep).option("header", header).csv(paths)
    return keep_files(rows.select("*", F.col("_metadata.file_name").alias("file_name")), include, exclude)


def scan_headerless(
    spark: SparkSession, paths: str | list[str], names: list[str],
    include: str | None = None, exclude: str | None = None,
) -> DataFrame:
    """Delimited files as text columns, header lines still among the rows."""
    schema = T.StructType([T.StructField(n, T.StringType()) for n in names])
    return scan_table(spark, paths, schema, header=False, include=include, exclude=exclude)


def scan_provenance(
    spark: SparkSession, pattern: str, include: str | None = None, exclude: str | None = None
) -> DataFrame:
    """One row per Parquet row with its file and ``source`` (the table file or folder); no column is read."""
    rows = spark.read.schema("_none string").parquet(pattern).select(
        F.col("_metadata.file_name").alias("file_name"),
        F.regexp_extract("_metadata.file_path", r"/([^/]+)\.parquet", 1).alias("source"))
    return keep_files(rows, include, exclude)


def numbered_lines(
    spark: SparkSession, paths: str | list[str], include: str | None = None, exclude: str | None = None
) -> DataFrame:
    """Text lines with their 1-based line number in the file: ``file_name``, ``file_path``, ``line_no``, ``value``.

    Files stay splittable: ids rise by one inside a file block, which lies in one task, so
    a line's number is the line count of the blocks before it and its distance from the
    block's first id. Lines travel only if the table of blocks is too large to broadcast.
    Files are filtered ahead of the ids, alike in both scans, so blocks are packed the same way.
    """
    files = spark.read.text(paths).select("value", *[
        F.col(f"_metadata.{c}").alias(n) for c, n in (("file_name", "file_name"), ("file_path", "_path"), ("file_block_start", "_block"))])
    lines = keep_files(files, include, exclude).withColumn("_pos", F.monotonically_increasing_id())
    earlier = (Window.partitionBy("_path").orderBy("_block")
               .rowsBetween(Window.unboundedPreceding, -1))
    starts = (
        lines.groupBy("_path", "_block").agg(F.count(F.lit(1)).alias("_lines"), F.min("_pos").alias("_first"))
        .withColumn("_start", F.coalesce(F.sum("_lines").over(earlier), F.lit(0)) - F.col("_first") + 1)
        .drop("_lines", "_first")
    )
    return (
        scale.join_dimension(lines, starts, ["_path", "_block"])
        .select("file_name", F.col("_path").alias("file_path"), (F.col("_start") + F.col("_pos")).alias("line_no"), "value")
    )


def scan_cells(
    spark: SparkSession, paths: str | list[str], columns: int, sep: str = ",",
    first_line: int | None = None, last_line: int | None = None,
    include: str | None = None, exclude: str | None = None,
) -> DataFrame:
    """Rectangle of a sheet export: ``file_name``, ``file_path``, ``line_no``, ``cells`` (text)."""
    lines = numbered_lines(spark, paths, include, exclude)
    if first_line is not None:
        lines = lines.where(F.col("line_no") >= first_line)
    if last_line is not None:
        lines = lines.where(F.col("line_no") <= last_line)
    schema = ", ".join(f"c{i} string" for i in range(columns))
    parsed = F.from_csv("value", F.lit(schema), {"sep": sep})
    return (
        lines.withColumn("_row", parsed)
        .select("file_name", "file_path", "line_no", F.array(*[F.col(f"_row.c{i}") for i in range(columns)]).alias("cells"))
    )


def scan_plate_reads(
    spark: SparkSession, paths: str | list[str], header_line: int, last_line: int, first_column: int = 1,
    wells: int = 96, include: str | None = None, exclude: str | None = None, plate: Column | str = "file_name",
) -> DataFrame:
    """Wide plate reads from a sheet export; the cell rectangle starts with its header line.

    Its columns are read time, temperature and the wells in plate order. ``plate``, an
    expression on ``file_name`` and ``file_path``, names the plate.
    """
    plate = F.col(plate) if isinstance(plate, str) else plate
    cells = scan_cells(spark, paths, first_column + 2 + wells, first_line=header_line + 1, last_line=last_line,
                       include=include, exclude=exclude)
    return cells.select(
        plate.alias("plate_id"),
        (F.col("line_no") - header_line - 1).alias("read_idx"),
        F.get("cells", F.lit(first_column)).alias("time_text"),
        F.get("cells", F.lit(first_column + 1)).try_cast("double").alias("temperature_c"),
        F.transform(F.slice("cells", first_column + 3, wells), lambda w: w.try_cast("double")).alias("wells"),
    )


def scan_instrument_names(
    spark: SparkSession, paths: str | list[str], header_line: int, first_column: int = 1, wells: int = 96,
) -> DataFrame:
    """Column names the instrument wrote, by position."""
    header = scan_cells(spark, paths, first_column + 2 + wells, first_line=header_line, last_line=header_line)
    return header.select(
        F.col("file_name").alias("plate_id"),
        F.posexplode(F.slice("cells", first_column + 1, wells + 2)).alias("position", "instrument_name"))


def scan_label_grid(
    spark: SparkSession, paths: str | list[str], columns: int = 12, plate: Column | str = "file_name"
) -> DataFrame:
    """Plate template sheets: ``plate_id``, 0-based ``grid_row`` and one label column per plate column.

    The header line and the row-letter column go; ``NA`` and empty cells are NULL.
    """
    plate = F.col(plate) if isinstance(plate, str) else plate
    cells = scan_cells(spark, paths, columns + 1, first_line=2)
    label = [F.get("cells", F.lit(i)) for i in range(1, columns + 1)]
    return cells.select(
        plate.alias("plate_id"), (F.col("line_no") - 2).alias("grid_row"),
        *[F.when(~c.isin("NA", ""), c).alias(f"c{i}") for i, c in enumerate(label, 1)])


def scan_after_header(
    spark: SparkSession, paths: str | list[str], schema: T.StructType, skip: int = 76, sep: str = ",",
    include: str | None = None, exclude: str | None = None,
) -> DataFrame:
    """Files with ``skip`` preamble lines, then a header line, then typed rows."""
    lines = numbered_lines(spark, paths, include, exclude).where(F.col("line_no") > skip + 1)
    parsed = F.from_csv("value", F.lit(schema.simpleString()[len("struct<"):-1].replace(":", " ")), {"sep": sep})
    names = clean_names(schema.fieldNames())
    return lines.withColumn("_row", parsed).select(
        "file_name", "line_no", *[F.col(f"_row.{f}").alias(n) for f, n in zip(schema.fieldNames(), names)])
