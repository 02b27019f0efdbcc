"""Cleaning of read and rate tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ratewell import scale
from ratewell.functions.lines import known
from ratewell.functions.text import clean_names, contains_any


def normalise_header(df: DataFrame) -> DataFrame:
    """Rename all columns to clean snake case names."""
    return df.toDF(*clean_names(df.columns))


def keep_columns_containing(df: DataFrame, needles: list[str]) -> DataFrame:
    """Columns whose name holds one of the texts, ignoring case."""
    return df.select(*[c for c in df.columns if any(n.lower() in c.lower() for n in needles)])


def drop_columns_containing(df: DataFrame, needles: list[str]) -> DataFrame:
    """Drop columns whose name holds one of the texts, ignoring case."""
    return df.drop(*[c for c in df.columns if any(n.lower() in c.lower() for n in needles)])


def drop_labels_containing(df: DataFrame, label: str, needles: list[str]) -> DataFrame:
    """Long form of dropping columns by substring."""
    return df.where(~contains_any(F.col(label), needles))


def cast_text(df: DataFrame, columns: list[str], to: str = "double") -> DataFrame:
    """Cast text columns; what is not a number becomes NULL, and so does the text NaN."""
    numbers = {c: F.col(c).try_cast(to) for c in columns}
    return df.withColumns({c: known(v) if to in ("double", "float") else v for c, v in numbers.items()})


def drop_header_rows(df: DataFrame, column: str, header: str) -> DataFrame:
    """Drop repeated header rows, known by the header text in a column; NULL stays."""
    return df.where(F.coalesce(~F.col(column).contains(header), F.lit(True)))


def drop_incomplete_reads(reads: DataFrame, wells: str = "wells") -> DataFrame:
    """Drop wide reads with any empty column or any empty well."""
    return reads.na.drop("any").where(~F.exists(wells, lambda w: w.isNull()))


def drop_incomplete_long(df: DataFrame, read: list[str], value: str) -> DataFrame:
    """Long form: drop all wells of a read in which any well is empty; a NULL in ``read`` is a value like others."""
    gaps = df.where(F.col(value).isNull()).select(*read).distinct()
    return scale.join_dimension(df, gaps, read, "left_anti")


def melt(df: DataFrame, ids: list[str], values: list[str], variable: str = "variable", value: str = "value") -> DataFrame:
    """Wide to long."""
    return df.unpivot(ids, values, variable, value)


def spread(df: DataFrame, ids: list[str], variable: str, names: list, value: str) -> DataFrame:
    """Long to wide for a known list of series, averaging the repeats that are numbers."""
    return df.groupBy(*ids).pivot(variable, names).agg(F.avg(known(value)))
