"""Standard curves, replicates, blanks and controls."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ratewell.functions.text import token
from ratewell.operators import calibrate, cleaning, controls
from ratewell.table_queries.common import Query, events, rounded, table

X, Y, KEY = "l_quantity", "l_extendedprice", ["l_returnflag"]
# Critical t of a 95 % band for many degrees of freedom, given by the caller.
T_CRITICAL = 1.96
# Calibration coefficients without a fit: fixed values.
FIXED_B, FIXED_M = 0.1136175, 0.04623074
PAIRS = [("click", "error", "mean_1"), ("view", "error", "mean_2"), ("purchase", "signup", "mean_3")]

LINE_CTE = """WITH s AS (
  SELECT l_returnflag, regr_slope(l_extendedprice, l_quantity) AS m, regr_intercept(l_extendedprice, l_quantity) AS b,
         regr_r2(l_extendedprice, l_quantity) AS r2, CAST(regr_count(l_extendedprice, l_quantity) AS BIGINT) AS n,
         regr_sxx(l_extendedprice, l_quantity) AS sxx, regr_syy(l_extendedprice, l_quantity) AS syy,
         regr_sxy(l_extendedprice, l_quantity) AS sxy, regr_avgx(l_extendedprice, l_quantity) AS mx,
         min(l_quantity) AS x_min, max(l_quantity) AS x_max
  FROM lineitem GROUP BY l_returnflag),
line AS (SELECT *, sqrt((syy - sxy * sxy / sxx) / (n - 2)) AS s FROM s)"""


def _fit(spark: SparkSession, folder: str) -> DataFrame:
    return calibrate.fit_line(table(spark, folder, "lineitem"), KEY, X, Y)


def standard_curve(spark: SparkSession, folder: str) -> DataFrame:
    digits = {"b": 4, "m": 6, "r2": 8, "residual_se": 4, "se_m": 6, "se_b": 4, "t_m": 4, "t_b": 4, "f": 3, "adj_r2": 8}
    return _fit(spark, folder).withColumns(rounded(digits)).select(*KEY, "n", *digits)


def fitted_line(spark: SparkSession, folder: str) -> DataFrame:
    digits = {"x": 6, "fit": 4, "lower": 4, "upper": 4}
    band = calibrate.fitted_line(_fit(spark, folder), points=50, t_critical=T_CRITICAL)
    return band.withColumns(rounded(digits)).select(*KEY, "point", *digits)


def _small_fits(spark: SparkSession, folder: str) -> DataFrame:
    """One line per order, of those with 3, 4 or 6 items: 1, 2 or 4 degrees of freedom have closed forms."""
    fits = calibrate.fit_line(table(spark, folder, "lineitem"), ["l_orderkey"], X, Y)
    return fits.where(F.col("n").isin(3, 4, 6) & F.col("t_m").isNotNull())


def fit_p_values(spark: SparkSession, folder: str) -> DataFrame:
    return calibrate.with_p_values(_small_fits(spark, folder)).select("l_orderkey", "n", *[F.round(c, 9).alias(c) for c in ("p_m", "p_b", "p_f")])


def fitted_band(spark: SparkSession, folder: str) -> DataFrame:
    """95 % band of each order's line at both ends of its range."""
    band = calibrate.fitted_line(_small_fits(spark, folder), points=2, level=0.95)
    return band.select("l_orderkey", "point", *[F.round(c, 3).alias(c) for c in ("lower", "upper")])


SMALL_CTE = """WITH s AS (
  SELECT l_orderkey, regr_slope(l_extendedprice, l_quantity) AS m, regr_intercept(l_extendedprice, l_quantity) AS b,
         CAST(count(*) AS BIGINT) AS n, regr_sxx(l_extendedprice, l_quantity) AS sxx, regr_syy(l_extendedprice, l_quantity) AS syy,
         regr_sxy(l_extendedprice, l_quantity) AS sxy, avg(l_quantity) AS mx, min(l_quantity) AS x_min, max(l_quantity) AS x_max
  FROM lineitem GROUP BY l_orderkey HAVING count(*) IN (3, 4, 6) AND regr_sxx(l_extendedprice, l_quantity) > 0),
line AS (SELECT *, sqrt((syy - m * sxy) / (n - 2)) AS s FROM s WHERE syy - m * sxy > 0),
t AS (SELECT *, abs(m) / (s / sqrt(sxx)) AS t_m, abs(b) / (s * sqrt(1 / n + mx * mx / sxx)) AS t_b FROM line)"""


def _tail_sql(t: str) -> str:
    """Two-sided tails in closed form for 1, 2 and 4 degrees of freedom."""
    return f"""CASE n WHEN 3 THEN 2 / pi() * atan2(1, {t}) WHEN 4 THEN 1 - {t} / sqrt(2 + {t} * {t})
  ELSE 1 - {t} / sqrt(4 + {t} * {t}) * (1 + 2 / (4 + {t} * {t})) END"""


# 95 % critical values from the quantile functions for 1, 2 and 4 degrees of freedom.
CRITICAL_SQL = """CASE n WHEN 3 THEN tan(pi() * 0.475::DOUBLE) WHEN 4 THEN 0.95::DOUBLE * sqrt(2 / (1 - 0.95::DOUBLE * 0.95))
  ELSE 2 * sqrt(cos(acos(sqrt(4 * 0.025::DOUBLE * 0.975)) / 3) / sqrt(4 * 0.025::DOUBLE * 0.975) - 1) END"""

P_VALUES_SQL = f"""{SMALL_CTE}
SELECT l_orderkey, n, round({_tail_sql('t_m')}, 9) AS p_m, round({_tail_sql('t_b')}, 9) AS p_b, round({_tail_sql('t_m')}, 9) AS p_f FROM t"""

BAND_SQL = f"""{SMALL_CTE},
grid AS (SELECT *, CAST(unnest([0, 1]) AS INTEGER) AS point, {CRITICAL_SQL} AS c FROM line),
x AS (SELECT *, CASE point WHEN 0 THEN x_min ELSE x_max END AS x FROM grid),
h AS (SELECT *, b + m * x AS fit, c * s * sqrt(1 / n + (x - mx) * (x - mx) / sxx) AS half FROM x)
SELECT l_orderkey, point, round(fit - half, 3) AS lower, round(fit + half, 3) AS upper FROM h"""


def calibrated(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "lineitem").select("l_orderkey", "l_linenumber", *KEY, Y)
    return calibrate.apply_calibration(rows, _fit(spark, folder), KEY, Y).withColumns(rounded({"nmol": 4}))


def calibrated_fixed(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "lineitem").select("l_orderkey", "l_linenumber", "l_discount")
    return calibrate.apply_fixed(rows, FIXED_B, FIXED_M, "l_discount").withColumns(rounded({"nmol": 6}))


def dose_from_label(spark: SparkSession, folder: str) -> DataFrame:
    dose = calibrate.dose_from_label(F.col("p_brand"), position=-1, sep="#")
    digits = {"ul": 6, "mm": 6, "nm": 4, "nmol": 6}
    return table(spark, folder, "part").select(
        "p_partkey", token("p_name", " ", -1).alias("kind"), *[F.round(dose[c], d).alias(c) for c, d in digits.items()])


def replicate_stats(spark: SparkSession, folder: str) -> DataFrame:
    reads = events(spark, folder).withColumn("day", F.to_date("ts").cast("string"))
    return controls.replicate_stats(reads, ["event_type", "day"], "value").withColumns(rounded({"mean": 8, "sd": 8}))


def replicate_attach(spark: SparkSession, folder: str) -> DataFrame:
    reads = events(spark, folder).withColumn("idvar", F.concat_ws("_", "event_type", F.to_date("ts").cast("string")))
    return controls.attach_stats(reads.select("event_id", "idvar", "value"), ["idvar"], "value").withColumns(
        rounded({"mean": 8, "sd": 8}))


def paired_control(spark: SparkSession, folder: str) -> DataFrame:
    reads = events(spark, folder).withColumn("day", F.to_date("ts").cast("string"))
    return controls.subtract_control(reads, ["day"], "event_type", "value", PAIRS).withColumns(rounded({"mean": 8}))


PAIRED_SQL = "\nUNION ALL\n".join(
    f"""SELECT CAST(CAST(ts AS DATE) AS VARCHAR) AS day, '{name}' AS id,
       round(avg(value) FILTER (WHERE event_type = '{sample}') - avg(value) FILTER (WHERE event_type = '{control}'), 8) AS mean
FROM events WHERE event_type IN ('{sample}', '{control}') GROUP BY 1""" for sample, control, name in PAIRS)


def blank_corrected(spark: SparkSession, folder: str) -> DataFrame:
    reads = events(spark, folder).withColumn("hour", F.date_trunc("hour", "ts").cast("timestamp_ntz"))
    corrected = controls.subtract_blank(reads, ["hour"], F.col("event_type") == "error", "value")
    return corrected.select("event_id", "event_type", F.round("corrected", 8).alias("corrected"))


def progress_curve(spark: SparkSession, folder: str) -> DataFrame:
    """Replicate mean, sd and error bounds by hour and series."""
    reads = events(spark, folder).withColumn("hour", F.floor(F.col("minutes") / 60))
    stats = controls.replicate_stats(reads, ["event_type", "hour"], "value")
    return stats.withColumns({"lo": F.col("mean") - F.col("sd"), "hi": F.col("mean") + F.col("sd")}).withColumns(
        rounded({"mean": 8, "sd": 8, "lo": 8, "hi": 8}))


def pivot_series(spark: SparkSession, folder: str) -> DataFrame:
    reads = events(spark, folder).withColumn("day", F.to_date("ts").cast("string"))
    names = ["click", "error", "purchase", "signup", "view"]
    return cleaning.spread(reads, ["day"], "event_type", names, "value").withColumns(rounded({n: 8 for n in names}))


def wide_melt(spark: SparkSession, folder: str) -> DataFrame:
    measures = ["l_quantity", "l_discount", "l_tax", "l_extendedprice"]
    rows = table(spark, folder, "lineitem").select("l_orderkey", "l_linenumber", *measures)
    long = cleaning.melt(rows, ["l_orderkey", "l_linenumber"], measures)
    return cleaning.drop_labels_containing(long, "variable", ["TAX"])


def drop_incomplete(spark: SparkSession, folder: str) -> DataFrame:
    marks = table(spark, folder, "labels").select(F.col("doc_id").alias("event_id"), "quality", "toxic")
    joined = table(spark, folder, "events").join(marks, "event_id", "left")
    return joined.na.drop("any").select("event_id", "user_id", "value", "quality", "toxic")


def drop_incomplete_long(spark: SparkSession, folder: str) -> DataFrame:
    """Reads of an hour and user go if one of them has no value; some hours are unknown."""
    reads = events(spark, folder).select(
        "event_id", F.when(F.hour("ts") > 2, F.hour("ts")).alias("hour"), F.col("user_id") % 50,
        F.when(F.col("event_id") % 97 != 0, F.col("value")).alias("value")).toDF("event_id", "hour", "plate", "value")
    return cleaning.drop_incomplete_long(reads, ["hour", "plate"], "value").select("event_id", "hour", "plate")


def pivot_series_nan(spark: SparkSession, folder: str) -> DataFrame:
    """Every fifth value is NaN, which counts as missing."""
    reads = events(spark, folder).withColumn("day", F.to_date("ts").cast("string")).withColumn(
        "y", F.when(F.col("event_id") % 5 == 0, F.lit(float("nan"))).otherwise(F.col("value")))
    names = ["click", "error"]
    return cleaning.spread(reads, ["day"], "event_type", names, "y").withColumns(rounded({n: 8 for n in names}))


def header_row_cleanup(spark: SparkSession, folder: str) -> DataFrame:
    text = table(spark, folder, "events").select(*[F.col(c).cast("string").alias(c) for c in ("event_id", "event_type", "value")])
    header = spark.createDataFrame([("event_id", "event_type", "value")], text.schema)
    kept = cleaning.drop_header_rows(text.unionByName(header), "value", "value")
    return cleaning.cast_text(cleaning.cast_text(kept, ["value"]), ["event_id"], "bigint")


def standard_curve_nan(spark: SparkSession, folder: str) -> DataFrame:
    """Some standards read NaN and some doses are NaN; both count as missing."""
    rows = table(spark, folder, "lineitem").select(
        *KEY, F.when(F.col("l_linenumber") == 5, F.lit(float("nan"))).otherwise(F.col(X)).alias(X),
        F.when(F.col("l_orderkey") % 11 == 0, F.lit(float("nan"))).otherwise(F.col(Y)).alias(Y))
    return calibrate.fit_line(rows, KEY, X, Y).withColumns(rounded({"b": 4, "m": 6, "r2": 8})).select(*KEY, "n", "b", "m", "r2")


def uncalibrated_plate(spark: SparkSession, folder: str) -> DataFrame:
    """Rows whose key has no line keep their place, with no amount; a NULL key has a line of its own."""
    rows = table(spark, folder, "lineitem").select(
        "l_orderkey", "l_linenumber", F.nullif("l_returnflag", F.lit("N")).alias("flag"), X, Y)
    line = calibrate.fit_line(rows.where("flag IS NULL OR flag = 'A'"), ["flag"], X, Y)
    return calibrate.apply_calibration(rows, line, ["flag"], Y).select(
        "l_orderkey", "l_linenumber", "flag", F.round("nmol", 4).alias("nmol"))


def attach_null_group(spark: SparkSession, folder: str) -> DataFrame:
    """Replicate statistics reach rows whose key is NULL."""
    reads = table(spark, folder, "events").select("event_id", F.nullif("event_type", F.lit("view")).alias("kind"), "value")
    return controls.attach_stats(reads, ["kind"], "value").withColumns(rounded({"mean": 8, "sd": 8}))


QUERIES = {
    "fit_p_values": Query(fit_p_values, P_VALUES_SQL),
    "fitted_band": Query(fitted_band, BAND_SQL),
    "standard_curve_nan": Query(standard_curve_nan, """
WITH r AS (SELECT l_returnflag, l_quantity AS x, l_extendedprice AS y FROM lineitem WHERE l_linenumber <> 5 AND l_orderkey % 11 <> 0)
SELECT l_returnflag, CAST(regr_count(y, x) AS BIGINT) AS n, round(regr_intercept(y, x), 4) AS b, round(regr_slope(y, x), 6) AS m,
       round(regr_r2(y, x), 8) AS r2 FROM r GROUP BY l_returnflag"""),
    "uncalibrated_plate": Query(uncalibrated_plate, """
WITH r AS (SELECT l_orderkey, l_linenumber, nullif(l_returnflag, 'N') AS flag, l_quantity AS x, l_extendedprice AS y FROM lineitem),
line AS (SELECT flag, regr_slope(y, x) AS m, regr_intercept(y, x) AS b FROM r WHERE flag IS NULL OR flag = 'A' GROUP BY flag)
SELECT l_orderkey, l_linenumber, r.flag, round((y - b) / m, 4) AS nmol
FROM r LEFT JOIN line ON r.flag IS NOT DISTINCT FROM line.flag"""),
    "attach_null_group": Query(attach_null_group, """
SELECT event_id, kind, value, round(avg(value) OVER g, 8) AS mean, round(stddev_samp(value) OVER g, 8) AS sd, count(value) OVER g AS n
FROM (SELECT event_id, nullif(event_type, 'view') AS kind, value FROM events) WINDOW g AS (PARTITION BY kind)"""),
    "standard_curve": Query(standard_curve, f"""{LINE_CTE}
SELECT l_returnflag, n, round(b, 4) AS b, round(m, 6) AS m, round(r2, 8) AS r2, round(s, 4) AS residual_se,
       round(s / sqrt(sxx), 6) AS se_m, round(s * sqrt(1.0 / n + mx * mx / sxx), 4) AS se_b,
       round(m / (s / sqrt(sxx)), 4) AS t_m, round(b / (s * sqrt(1.0 / n + mx * mx / sxx)), 4) AS t_b,
       round(power(m / (s / sqrt(sxx)), 2), 3) AS f, round(1 - (1 - r2) * (n - 1) / (n - 2), 8) AS adj_r2
FROM line"""),
    "fitted_line": Query(fitted_line, f"""{LINE_CTE},
grid AS (SELECT line.*, CAST(p AS INTEGER) AS point, x_min + (x_max - x_min) / 49 * p AS x
         FROM line, (SELECT unnest(range(50)) AS p))
SELECT l_returnflag, point, round(x, 6) AS x, round(b + m * x, 4) AS fit,
       round(b + m * x - {T_CRITICAL}::DOUBLE * s * sqrt(1.0 / n + (x - mx) * (x - mx) / sxx), 4) AS lower,
       round(b + m * x + {T_CRITICAL}::DOUBLE * s * sqrt(1.0 / n + (x - mx) * (x - mx) / sxx), 4) AS upper
FROM grid"""),
    "calibrated": Query(calibrated, f"""{LINE_CTE}
SELECT l_orderkey, l_linenumber, l.l_returnflag, l_extendedprice, round((l_extendedprice - b) / m, 4) AS nmol
FROM lineitem l JOIN line ON l.l_returnflag = line.l_returnflag"""),
    "calibrated_fixed": Query(calibrated_fixed, f"""
SELECT l_orderkey, l_linenumber, l_discount,
       round((l_discount - {FIXED_B}::DOUBLE) / {FIXED_M}::DOUBLE, 6) AS nmol FROM lineitem"""),
    "dose_from_label": Query(dose_from_label, """
SELECT p_partkey, split_part(p_name, ' ', -1) AS kind, round(ul, 6) AS ul, round(ul * 0.04::DOUBLE, 6) AS mm,
       round(ul * 0.04::DOUBLE * 1e6, 4) AS nm, round(ul * 8, 6) AS nmol
FROM (SELECT *, TRY_CAST(split_part(p_brand, '#', -1) AS DOUBLE) AS ul FROM part)"""),
    "replicate_stats": Query(replicate_stats, """
SELECT event_type, CAST(CAST(ts AS DATE) AS VARCHAR) AS day, round(avg(value), 8) AS mean, round(stddev_samp(value), 8) AS sd, count(value) AS n
FROM events GROUP BY 1, 2"""),
    "replicate_attach": Query(replicate_attach, """
SELECT event_id, idvar, value, round(avg(value) OVER g, 8) AS mean, round(stddev_samp(value) OVER g, 8) AS sd,
       count(value) OVER g AS n
FROM (SELECT *, event_type || '_' || CAST(CAST(ts AS DATE) AS VARCHAR) AS idvar FROM events)
WINDOW g AS (PARTITION BY idvar)"""),
    "paired_control": Query(paired_control, PAIRED_SQL),
    "blank_corrected": Query(blank_corrected, """
WITH blank AS (SELECT date_trunc('hour', ts) AS hour, avg(value) AS mean FROM events WHERE event_type = 'error' GROUP BY 1)
SELECT event_id, event_type, round(value - mean, 8) AS corrected
FROM events JOIN blank ON date_trunc('hour', ts) = hour WHERE event_type <> 'error'"""),
    "progress_curve": Query(progress_curve, """
WITH g AS (SELECT event_type, CAST(floor((epoch_us(ts) - epoch_us(TIMESTAMP '2024-01-01')) / 1e6 / 60 / 60) AS BIGINT) AS hour,
                  avg(value) AS mean, stddev_samp(value) AS sd, count(value) AS n FROM events GROUP BY 1, 2)
SELECT event_type, hour, round(mean, 8) AS mean, round(sd, 8) AS sd, n, round(mean - sd, 8) AS lo, round(mean + sd, 8) AS hi FROM g"""),
    "pivot_series": Query(pivot_series, """
SELECT CAST(CAST(ts AS DATE) AS VARCHAR) AS day, """ + ", ".join(
        f"round(avg(value) FILTER (WHERE event_type = '{n}'), 8) AS {n}"
        for n in ("click", "error", "purchase", "signup", "view")) + " FROM events GROUP BY 1"),
    "wide_melt": Query(wide_melt, "\nUNION ALL\n".join(
        f"SELECT l_orderkey, l_linenumber, '{c}' AS variable, {c} AS value FROM lineitem"
        for c in ("l_quantity", "l_discount", "l_extendedprice"))),
    "drop_incomplete": Query(drop_incomplete, """
SELECT event_id, user_id, value, quality, toxic FROM events JOIN labels ON event_id = doc_id
WHERE value IS NOT NULL AND quality IS NOT NULL AND toxic IS NOT NULL AND props IS NOT NULL
  AND event_type IS NOT NULL AND user_id IS NOT NULL AND ts IS NOT NULL"""),
    "drop_incomplete_long": Query(drop_incomplete_long, """WITH r AS (
  SELECT event_id, CAST(CASE WHEN hour(ts) > 2 THEN hour(ts) END AS INTEGER) AS hour, user_id % 50 AS plate,
         CASE WHEN event_id % 97 <> 0 THEN value END AS value FROM events)
SELECT event_id, hour, plate FROM (SELECT *, count(*) OVER w = count(value) OVER w AS whole FROM r WINDOW w AS (PARTITION BY hour, plate))
WHERE whole"""),
    "pivot_series_nan": Query(pivot_series_nan, """
SELECT CAST(CAST(ts AS DATE) AS VARCHAR) AS day,
       round(avg(value) FILTER (WHERE event_type = 'click' AND event_id % 5 <> 0), 8) AS click,
       round(avg(value) FILTER (WHERE event_type = 'error' AND event_id % 5 <> 0), 8) AS error FROM events GROUP BY 1"""),
    "header_row_cleanup": Query(header_row_cleanup, "SELECT event_id, event_type, value FROM events"),
}
