"""Summaries and plot-ready tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ratewell.operators import report
from ratewell.table_queries.common import Query, rounded, table

BOX_CTE = """WITH q AS (
  SELECT o_orderpriority, quantile_cont(o_totalprice, 0.25) AS q1, quantile_cont(o_totalprice, 0.5) AS median,
         quantile_cont(o_totalprice, 0.75) AS q3 FROM scaled GROUP BY 1),
r AS (SELECT s.*, q1, median, q3, o_totalprice BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1) AS inside
      FROM scaled s JOIN q ON s.o_orderpriority = q.o_orderpriority)"""
# Cubed prices have a long tail, so that there are outliers.
SCALED_CTE = """WITH scaled AS (
  SELECT o_orderkey, o_orderpriority, power(o_totalprice / 100000, 3) AS o_totalprice FROM orders),"""
SCALED_BOX = SCALED_CTE + BOX_CTE[len("WITH"):]


def _scaled(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "orders").select(
        "o_orderkey", "o_orderpriority", F.pow(F.col("o_totalprice") / 100000, F.lit(3)).alias("o_totalprice"))


def five_number(spark: SparkSession, folder: str) -> DataFrame:
    summary = report.five_number(table(spark, folder, "orders"), ["o_orderstatus"], "o_totalprice")
    return summary.withColumns(rounded({c: 4 for c in ("min", "q1", "median", "q3", "max", "mean")}))


def frequency(spark: SparkSession, folder: str) -> DataFrame:
    return report.frequency(table(spark, folder, "orders"), ["o_orderpriority", "o_orderstatus"])


def box_stats(spark: SparkSession, folder: str) -> DataFrame:
    box = report.box_stats(_scaled(spark, folder), ["o_orderpriority"], "o_totalprice")
    return box.withColumns(rounded({c: 6 for c in ("q1", "median", "q3", "whisker_lo", "whisker_hi")}))


def box_outliers(spark: SparkSession, folder: str) -> DataFrame:
    rows = report.box_outliers(_scaled(spark, folder), ["o_orderpriority"], "o_totalprice")
    return rows.withColumns(rounded({"o_totalprice": 6}))


def outlier_labels(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "orders").where(F.col("o_totalprice") > 400000)
    return rows.select("o_orderstatus", "o_totalprice", F.col("o_orderkey").cast("string").alias("label"))


def density_histogram(spark: SparkSession, folder: str) -> DataFrame:
    bars = report.density_histogram(table(spark, folder, "lineitem"), ["l_returnflag"], "l_extendedprice")
    return bars.withColumns(rounded({"centre": 4, "density": 12}))


def histogram_null_facet(spark: SparkSession, folder: str) -> DataFrame:
    """A NULL facet has its bars; NaN values are left out."""
    rows = table(spark, folder, "lineitem").select(
        F.nullif("l_returnflag", F.lit("N")).alias("flag"),
        F.when(F.col("l_linenumber") == 4, F.lit(float("nan"))).otherwise(F.col("l_extendedprice")).alias("price"))
    return report.density_histogram(rows, ["flag"], "price").withColumns(rounded({"centre": 4, "density": 12}))


def box_null_group(spark: SparkSession, folder: str) -> DataFrame:
    rows = _scaled(spark, folder).withColumn("priority", F.nullif("o_orderpriority", F.lit("2-HIGH")))
    box = report.box_stats(rows, ["priority"], "o_totalprice")
    return box.withColumns(rounded({c: 6 for c in ("q1", "median", "q3", "whisker_lo", "whisker_hi")}))


QUERIES = {
    "histogram_null_facet": Query(histogram_null_facet, """
WITH r AS (SELECT nullif(l_returnflag, 'N') AS flag, l_extendedprice AS price FROM lineitem WHERE l_linenumber <> 4),
g AS (SELECT min(price) AS lo, (max(price) - min(price)) / 29 AS w FROM r),
b AS (SELECT flag, lo, w, CAST(greatest(0, least(29, ceil((price - (lo - w / 2)) / w - 1e-8) - 1)) AS INTEGER) AS bin FROM r, g),
c AS (SELECT flag, bin, lo, w, count(*) AS "count" FROM b GROUP BY ALL)
SELECT flag, bin, "count", round(lo + bin * w, 4) AS centre,
       round("count" / (sum("count") OVER (PARTITION BY flag) * w), 12) AS density FROM c"""),
    "box_null_group": Query(box_null_group, """
WITH s AS (SELECT nullif(o_orderpriority, '2-HIGH') AS priority, power(o_totalprice / 100000, 3) AS v FROM orders),
q AS (SELECT priority, quantile_cont(v, 0.25) AS q1, quantile_cont(v, 0.5) AS median, quantile_cont(v, 0.75) AS q3 FROM s GROUP BY 1),
r AS (SELECT s.*, q1, median, q3, v BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1) AS inside
      FROM s JOIN q ON s.priority IS NOT DISTINCT FROM q.priority)
SELECT priority, round(q1, 6) AS q1, round(median, 6) AS median, round(q3, 6) AS q3, round(min(v) FILTER (WHERE inside), 6) AS whisker_lo,
       round(max(v) FILTER (WHERE inside), 6) AS whisker_hi, count(*) FILTER (WHERE NOT inside) AS n_outliers
FROM r GROUP BY priority, q1, median, q3"""),
    "five_number": Query(five_number, """
SELECT o_orderstatus, round(avg(o_totalprice), 4) AS mean, count(o_totalprice) AS n, round(min(o_totalprice), 4) AS min,
       round(quantile_cont(o_totalprice, 0.25), 4) AS q1, round(quantile_cont(o_totalprice, 0.5), 4) AS median,
       round(quantile_cont(o_totalprice, 0.75), 4) AS q3, round(max(o_totalprice), 4) AS max
FROM orders GROUP BY o_orderstatus"""),
    "frequency": Query(frequency, "SELECT o_orderpriority, o_orderstatus, count(*) AS n FROM orders GROUP BY 1, 2"),
    "box_stats": Query(box_stats, f"""{SCALED_BOX}
SELECT o_orderpriority, round(q1, 6) AS q1, round(median, 6) AS median, round(q3, 6) AS q3,
       round(min(o_totalprice) FILTER (WHERE inside), 6) AS whisker_lo,
       round(max(o_totalprice) FILTER (WHERE inside), 6) AS whisker_hi,
       count(*) FILTER (WHERE NOT inside) AS n_outliers
FROM r GROUP BY o_orderpriority, q1, median, q3"""),
    "box_outliers": Query(box_outliers, f"""{SCALED_BOX}
SELECT o_orderkey, o_orderpriority, round(o_totalprice, 6) AS o_totalprice FROM r WHERE NOT inside"""),
    "outlier_labels": Query(outlier_labels, """
SELECT o_orderstatus, o_totalprice, CAST(o_orderkey AS VARCHAR) AS label FROM orders WHERE o_totalprice > 400000"""),
    "density_histogram": Query(density_histogram, """
WITH g AS (SELECT min(l_extendedprice) AS lo, (max(l_extendedprice) - min(l_extendedprice)) / 29 AS w FROM lineitem),
b AS (SELECT l_returnflag, lo, w,
        CAST(greatest(0, least(29, ceil((l_extendedprice - (lo - w / 2)) / w - 1e-8) - 1)) AS INTEGER) AS bin
      FROM lineitem, g),
c AS (SELECT l_returnflag, bin, lo, w, count(*) AS "count" FROM b GROUP BY ALL)
SELECT l_returnflag, bin, "count", round(lo + bin * w, 4) AS centre,
       round("count" / (sum("count") OVER (PARTITION BY l_returnflag) * w), 12) AS density
FROM c"""),
}
