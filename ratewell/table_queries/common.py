"""Shared pieces of the table queries."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ratewell.functions.clock import seconds_between
from ratewell.scale import ensure_checkpoint_dir


class Query(NamedTuple):
    """A Spark query and its checking SQL (None where no SQL can state it)."""

    run: Callable[[SparkSession, str], DataFrame]
    sql: str | None


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """One of the driver's tables."""
    return spark.read.parquet(f"{folder}/{name}.parquet")


def scratch_folder(spark: SparkSession) -> str:
    """A new folder beside the checkpoints, where all executors can read and write."""
    ensure_checkpoint_dir(spark)
    return f"{spark.sparkContext.getCheckpointDir()}/{uuid.uuid4()}"


def rounded(places: dict[str, int]) -> dict[str, Column]:
    """Rounded columns, so that the last bits of a sum do not count."""
    return {name: F.round(name, digits) for name, digits in places.items()}


def minutes_of(ts: str = "ts") -> Column:
    """Minutes since the start of 2024."""
    return seconds_between(F.lit("2024-01-01").cast("timestamp_ntz"), F.col(ts)) / 60


def events(spark: SparkSession, folder: str) -> DataFrame:
    """Events as reads with minutes."""
    return table(spark, folder, "events").withColumn("minutes", minutes_of())


READS_SQL = """
  SELECT event_id, ts, user_id, event_type, value,
         (epoch_us(ts) - epoch_us(TIMESTAMP '2024-01-01')) / 1e6 / 60 AS minutes
  FROM events"""


def fits_sql(source: str, keys: str, order: str, x: str, y: str, window: int) -> str:
    """Sliding fits over a named relation."""
    return f"""
  SELECT {keys}, window_start, n, slope, intercept,
         CASE WHEN syy = 0 THEN NULL ELSE r2 END AS r2
  FROM (SELECT {keys}, row_number() OVER (PARTITION BY {keys} ORDER BY {order}) AS window_start,
               count(*) OVER w AS c, CAST(regr_count({y}, {x}) OVER w AS BIGINT) AS n,
               regr_slope({y}, {x}) OVER w AS slope, regr_intercept({y}, {x}) OVER w AS intercept,
               regr_r2({y}, {x}) OVER w AS r2, regr_syy({y}, {x}) OVER w AS syy
        FROM {source}
        WINDOW w AS (PARTITION BY {keys} ORDER BY {order} ROWS BETWEEN CURRENT ROW AND {window} FOLLOWING))
  WHERE c = {window + 1}"""


def best_sql(source: str, keys: str, gate: str = "TRUE") -> str:
    """Steepest windows of a named relation of fits, ties kept."""
    return f"""
  SELECT {keys}, slope AS max_slope, r2, intercept, window_start
  FROM (SELECT *, rank() OVER (PARTITION BY {keys} ORDER BY slope DESC) AS place
        FROM {source} WHERE slope IS NOT NULL AND NOT isnan(slope) AND {gate})
  WHERE place = 1"""
