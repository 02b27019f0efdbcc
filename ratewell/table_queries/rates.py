"""Sliding fits and rates on events."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ratewell.operators import rates
from ratewell.table_queries.common import READS_SQL, Query, best_sql, events, fits_sql, rounded

ORDER = ["ts", "event_id"]
FIT = {"slope": 6, "intercept": 4, "r2": 6}
RATE = {"max_slope": 6, "intercept": 4, "r2": 6}
FIT_SQL = "round(slope, 6) AS slope, round(intercept, 4) AS intercept, round(r2, 6) AS r2"
RATE_SQL = "round(max_slope, 6) AS max_slope, round(intercept, 4) AS intercept, round(r2, 6) AS r2"
WINDOWS = {"click": 5, "view": 5, "purchase": 4, "signup": 13, "error": 20}


def trimmed_sql(keys: str, lo: int, hi: int) -> str:
    return f"""SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY {keys} ORDER BY ts, event_id) AS place
      FROM ({READS_SQL})) WHERE place BETWEEN {lo} AND {hi}"""


def sliding_fit_all(spark: SparkSession, folder: str) -> DataFrame:
    fits = rates.sliding_fit(events(spark, folder), ["user_id"], ORDER, "minutes", "value", 5)
    return fits.withColumns(rounded(FIT))


def _max_rate(spark: SparkSession, folder: str) -> DataFrame:
    reads = rates.trim_reads(events(spark, folder), ["user_id"], ORDER, 1, 30)
    fits = rates.sliding_fit(reads, ["user_id"], ORDER, "minutes", "value", 5, longest=30)
    return rates.best_window(fits, ["user_id"], longest=30)


def max_rate(spark: SparkSession, folder: str) -> DataFrame:
    return _max_rate(spark, folder).withColumns(rounded(RATE))


MAX_RATE_SQL = f"""WITH reads AS ({trimmed_sql('user_id', 1, 30)}),
fits AS ({fits_sql('reads', 'user_id', 'ts, event_id', 'minutes', 'value', 5)}),
best AS ({best_sql('fits', 'user_id')})
SELECT user_id, {RATE_SQL}, window_start FROM best"""

GATED = ["user_id", "event_type"]


def _gated(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    reads = rates.trim_reads(events(spark, folder), GATED, ORDER, 2, 40)
    fits = rates.sliding_fit(reads, GATED, ORDER, "minutes", "value", 4, longest=39)
    return reads, rates.best_window(fits, GATED, min_r2=0.5, min_slope=0.0, longest=39)


def max_rate_gated(spark: SparkSession, folder: str) -> DataFrame:
    return _gated(spark, folder)[1].withColumns(rounded(RATE))


GATED_CTE = f"""WITH reads AS ({trimmed_sql('user_id, event_type', 2, 40)}),
fits AS ({fits_sql('reads', 'user_id, event_type', 'ts, event_id', 'minutes', 'value', 4)}),
best AS ({best_sql('fits', 'user_id, event_type', 'r2 >= 0.5 AND slope > 0')})"""


def rate_with_reads(spark: SparkSession, folder: str) -> DataFrame:
    reads, best = _gated(spark, folder)
    tagged = rates.attach_rates(reads.select(*GATED, "event_id", "value"), best, GATED, "event_type")
    return tagged.select("event_id", *GATED, "value", "winners",
                         F.coalesce("window_start", F.lit(0)).alias("window_start"),
                         *[c.alias(n) for n, c in rounded({"max_slope": 6, "r2": 6}).items()])


def best_window_first(spark: SparkSession, folder: str) -> DataFrame:
    """Whole-number values and evenly spaced reads, so that equal slopes do occur."""
    reads = rates.trim_reads(events(spark, folder), ["user_id"], ORDER, 1, 30, out="place")
    steps = reads.withColumn("level", F.floor(F.col("value") / 25))
    fits = rates.sliding_fit(steps, ["user_id"], ["place"], "place", "level", 1, longest=30)
    return rates.best_window(fits, ["user_id"], ties="first").select(
        "user_id", "window_start", F.round("max_slope", 6).alias("max_slope"))


def elapsed_minutes(spark: SparkSession, folder: str) -> DataFrame:
    reads = events(spark, folder).drop("minutes")
    return rates.elapsed_minutes(reads, ["user_id"], "ts").select("event_id", "user_id", "minutes")


def force_last_minute(spark: SparkSession, folder: str) -> DataFrame:
    reads = events(spark, folder).withColumn("minutes", F.bround("minutes", 0))
    return rates.force_last_minute(reads, ["event_type"]).select("event_id", "event_type", "minutes")


def window_by_condition(spark: SparkSession, folder: str) -> DataFrame:
    fits = rates.sliding_fit_by(
        events(spark, folder), "event_type", WINDOWS, ["user_id"], ORDER, "minutes", "value")
    return fits.withColumns(rounded(FIT))


def _by_condition_sql() -> str:
    parts = []
    for name, width in WINDOWS.items():
        source = f"(SELECT * FROM ({READS_SQL}) WHERE event_type = '{name}')"
        fits = fits_sql(source, "event_type, user_id", "ts, event_id", "minutes", "value", width)
        parts.append(f'SELECT event_type, user_id, window_start, n, {FIT_SQL}, CAST({width} AS INTEGER) AS "window" FROM ({fits})')
    return "\nUNION ALL\n".join(parts)


def top_rates(spark: SparkSession, folder: str) -> DataFrame:
    return rates.sorted_rates(_max_rate(spark, folder), "user_id").select(
        "user_id", F.round("max_slope", 6).alias("max_slope"))


def fitted_rate_lines(spark: SparkSession, folder: str) -> DataFrame:
    """Reads of each series with the line of its steepest window."""
    reads = rates.trim_reads(events(spark, folder), ["user_id"], ORDER, 1, 30)
    lines = rates.attach_rates(reads, _max_rate(spark, folder), ["user_id"], "user_id")
    return lines.where(F.col("max_slope").isNotNull()).select(
        "event_id", "user_id",
        F.round(F.col("intercept") + F.col("max_slope") * F.col("minutes"), 4).alias("line"))


def max_rate_nan(spark: SparkSession, folder: str) -> DataFrame:
    """Every seventh value is NaN, which counts as missing."""
    reads = rates.trim_reads(events(spark, folder), ["user_id"], ORDER, 1, 30).withColumn(
        "y", F.when(F.col("event_id") % 7 == 0, F.lit(float("nan"))).otherwise(F.col("value")))
    fits = rates.sliding_fit(reads, ["user_id"], ORDER, "minutes", "y", 5, longest=30)
    best = rates.best_window(fits, ["user_id"], min_r2=0.1, min_slope=0.0, longest=30)
    return best.withColumns(rounded(RATE))


def rates_flat_series(spark: SparkSession, folder: str) -> DataFrame:
    """Whole series of equal values: every window wins, and every read still comes once."""
    reads = events(spark, folder).withColumn("level", F.lit(1.0))
    best = rates.best_window(rates.sliding_fit(reads, ["user_id"], ORDER, "minutes", "level", 5), ["user_id"])
    return rates.attach_rates(reads, best, ["user_id"], "user_id").select(
        "event_id", "user_id", "max_slope", "window_start", "n_winners")


QUERIES = {
    "sliding_fit_all": Query(sliding_fit_all, f"""WITH reads AS ({READS_SQL}),
fits AS ({fits_sql('reads', 'user_id', 'ts, event_id', 'minutes', 'value', 5)})
SELECT user_id, window_start, n, {FIT_SQL} FROM fits"""),
    "max_rate": Query(max_rate, MAX_RATE_SQL),
    "max_rate_gated": Query(max_rate_gated, f"""{GATED_CTE}
SELECT user_id, event_type, {RATE_SQL}, window_start FROM best"""),
    "rate_with_reads": Query(rate_with_reads, f"""{GATED_CTE}
SELECT r.event_id, r.user_id, r.event_type, r.value,
       CASE WHEN b.max_slope IS NULL THEN ' inactive' ELSE r.event_type END AS winners,
       coalesce(b.window_start, 0) AS window_start,
       round(b.max_slope, 6) AS max_slope, round(b.r2, 6) AS r2
FROM reads r LEFT JOIN (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY window_start) AS nth FROM best) b
  ON r.user_id = b.user_id AND r.event_type = b.event_type AND b.nth = 1"""),
    "best_window_first": Query(best_window_first, f"""WITH reads AS (
  SELECT user_id, place, floor(value / 25) AS level FROM ({trimmed_sql('user_id', 1, 30)})),
fits AS ({fits_sql('reads', 'user_id', 'place', 'place', 'level', 1)}),
ranked AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY slope DESC, window_start) AS p FROM fits)
SELECT user_id, window_start, round(slope, 6) AS max_slope FROM ranked WHERE p = 1"""),
    "elapsed_minutes": Query(elapsed_minutes, """
SELECT event_id, user_id,
       round_even((epoch_us(ts) - min(epoch_us(ts)) OVER (PARTITION BY user_id)) / 1e6 / 60.0::DOUBLE, 0) AS minutes
FROM events"""),
    "force_last_minute": Query(force_last_minute, f"""WITH r AS (
  SELECT event_id, event_type, round_even(minutes, 0) AS minutes FROM ({READS_SQL}))
SELECT event_id, event_type,
       CASE WHEN minutes = max(minutes) OVER (PARTITION BY event_type) THEN 60.0::DOUBLE ELSE minutes END AS minutes
FROM r"""),
    "window_by_condition": Query(window_by_condition, _by_condition_sql()),
    "top_rates": Query(top_rates, f"""WITH reads AS ({trimmed_sql('user_id', 1, 30)}),
fits AS ({fits_sql('reads', 'user_id', 'ts, event_id', 'minutes', 'value', 5)}),
best AS ({best_sql('fits', 'user_id')})
SELECT user_id, round(max_slope, 6) AS max_slope FROM best ORDER BY best.max_slope DESC, user_id"""),
    "fitted_rate_lines": Query(fitted_rate_lines, f"""WITH reads AS ({trimmed_sql('user_id', 1, 30)}),
fits AS ({fits_sql('reads', 'user_id', 'ts, event_id', 'minutes', 'value', 5)}),
best AS ({best_sql('fits', 'user_id')})
SELECT r.event_id, r.user_id, round(b.intercept + b.max_slope * r.minutes, 4) AS line
FROM reads r JOIN (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY window_start) AS nth FROM best) b
  ON r.user_id = b.user_id AND b.nth = 1"""),
    "max_rate_nan": Query(max_rate_nan, f"""WITH reads AS (
  SELECT user_id, ts, event_id, minutes, CASE WHEN event_id % 7 = 0 THEN NULL ELSE value END AS y
  FROM ({trimmed_sql('user_id', 1, 30)})),
fits AS ({fits_sql('reads', 'user_id', 'ts, event_id', 'minutes', 'y', 5)}),
best AS ({best_sql('fits', 'user_id', 'r2 >= 0.1 AND slope > 0')})
SELECT user_id, {RATE_SQL}, window_start FROM best"""),
    "rates_flat_series": Query(rates_flat_series, """
WITH sizes AS (SELECT user_id, count(*) AS n FROM events GROUP BY user_id)
SELECT event_id, e.user_id, CASE WHEN n > 5 THEN 0.0::DOUBLE END AS max_slope, CASE WHEN n > 5 THEN CAST(1 AS BIGINT) END AS window_start,
       CASE WHEN n > 5 THEN n - 5 END AS n_winners
FROM events e JOIN sizes s ON e.user_id = s.user_id"""),
}
