"""Normalised rates and response curves."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ratewell import scale
from ratewell.functions.text import half_unit
from ratewell.operators import curves, normalize
from ratewell.operators.cleaning import cast_text
from ratewell.table_queries.common import Query, rounded, table

PER_NMOL = 27.02703


def per_enzyme_rate(spark: SparkSession, folder: str) -> DataFrame:
    parts = table(spark, folder, "part").select(F.col("p_partkey").alias("l_partkey"), "p_retailprice")
    rows = table(spark, folder, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_quantity", "l_discount", "l_extendedprice")
    amount = normalize.enzyme_nmol(F.col("l_quantity"), F.col("l_discount"), F.sqrt("p_retailprice") * 1000)
    scaled = normalize.per_enzyme(
        scale.join_dimension(rows, parts, ["l_partkey"], settled=True), amount, divisor=120, rate="l_extendedprice")
    return scaled.withColumns(rounded({"sec_slope": 6, "nm_slope": 4})).select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_quantity", "l_extendedprice", "sec_slope", "nm_slope")


def log_rate(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_quantity", (F.col("l_discount") - 0.05).alias("rate"))
    return normalize.scaled_rates(rows, PER_NMOL, "rate").select(
        "l_orderkey", "l_linenumber", "l_quantity",
        *[c.alias(n) for n, c in rounded({"hr_slope": 6, "nm_slope": 6}).items()],
        F.when(F.abs("rate") > 1e-9, F.round("log_slope", 6)).alias("log_slope"))


def dim_normalised(spark: SparkSession, folder: str) -> DataFrame:
    rates = (
        table(spark, folder, "lineitem").groupBy("l_suppkey").agg(F.max("l_extendedprice").alias("max_slope"))
        .withColumn("colony", F.concat(F.lit("supplier#"), F.lpad(F.col("l_suppkey").cast("string"), 9, "0")))
    )
    return normalize.per_protein(rates, table(spark, folder, "supplier"), "colony", "s_name", "s_acctbal").withColumns(
        rounded({"max_slope": 4})).select("l_suppkey", "colony", "max_slope")


def fold_change(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "orders").select("o_orderkey", "o_orderpriority", "o_orderstatus", "o_totalprice")
    changed = normalize.fold_change(rows, ["o_orderpriority"], F.col("o_orderstatus") == "F", "o_totalprice")
    return changed.withColumns(rounded({"reference_mean": 4, "fold_change": 6}))


def reference_means(spark: SparkSession, folder: str) -> DataFrame:
    """Mean rate and mean fold change of two reference groups."""
    rows = table(spark, folder, "orders").select("o_orderpriority", "o_orderstatus", "o_totalprice")
    changed = normalize.fold_change(rows, ["o_orderpriority"], F.col("o_orderstatus") == "F", "o_totalprice")
    by, names = ["o_orderpriority"], ["F", "O"]
    slope = normalize.reference_means(rows, by, "o_orderstatus", names, "o_totalprice", "mean_slope")
    change = normalize.reference_means(changed, by, "o_orderstatus", names, "fold_change", "mean_fc")
    return slope.join(change, [*by, "o_orderstatus"]).withColumns(rounded({"mean_slope": 4, "mean_fc": 6}))


CURVE = {"mean": 6, "sd": 6, "lo": 6, "hi": 6}


def response_curve(spark: SparkSession, folder: str) -> DataFrame:
    return curves.temperature_curve(table(spark, folder, "part"), "p_brand", "p_retailprice").withColumns(rounded(CURVE))


def response_curve_nan(spark: SparkSession, folder: str) -> DataFrame:
    """Prices come as text, every eleventh as the text NaN."""
    text = F.when(F.col("p_partkey") % 11 == 0, F.lit("NaN")).otherwise(F.col("p_retailprice").cast("string"))
    parts = cast_text(table(spark, folder, "part").withColumn("price", text), ["price"])
    return curves.temperature_curve(parts, "p_brand", "price").withColumns(rounded(CURVE))


def half_unit_repair(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "part").select("p_partkey", "p_size", half_unit("p_size").alias("ph"))


def ph_curve(spark: SparkSession, folder: str) -> DataFrame:
    parts = table(spark, folder, "part").withColumn("condition", F.concat(F.lit("pH"), F.col("p_size"), F.lit("_")))
    return curves.ph_curve(parts, "condition", "p_retailprice").withColumns(rounded(CURVE))


def curve_family(spark: SparkSession, folder: str) -> DataFrame:
    """One curve per enzyme volume; each part kind stands for a volume."""
    volumes = {"bolt": 20.0, "ring": 2.0, "widget": 10.0}
    parts = table(spark, folder, "part").withColumn("org", F.element_at(F.split("p_name", " "), -1))
    picked = curves.pick_series(parts, "org", volumes)
    return curves.temperature_curve(picked, "p_brand", "p_retailprice", ["enzyme_ul"]).withColumns(rounded(CURVE))


def clean_rates(spark: SparkSession, folder: str) -> DataFrame:
    """Rates read twice as text under other file names: provenance goes, repeats collapse."""
    rows = table(spark, folder, "orders").select(
        F.col("o_custkey").alias("org"), F.col("o_totalprice").cast("string").alias("max_slope"), "o_orderpriority")
    again = rows.withColumn("file_name", F.lit("a")).unionByName(rows.withColumn("file_name", F.lit("b")))
    return curves.clean_rates(again)


CURVE_SQL = """round(avg(p_retailprice), 6) AS mean, round(stddev_samp(p_retailprice), 6) AS sd, count(*) AS n,
  round(avg(p_retailprice) - stddev_samp(p_retailprice), 6) AS lo, round(avg(p_retailprice) + stddev_samp(p_retailprice), 6) AS hi"""
BRAND_NUMBER = "CAST(regexp_extract(p_brand, '[0-9]+') AS DOUBLE)"

def fold_change_null_key(spark: SparkSession, folder: str) -> DataFrame:
    """Rows with a NULL key find the reference of the NULL key."""
    rows = table(spark, folder, "orders").select(
        "o_orderkey", F.nullif("o_orderpriority", F.lit("2-HIGH")).alias("priority"), "o_orderstatus", "o_totalprice")
    changed = normalize.fold_change(rows, ["priority"], F.col("o_orderstatus") == "F", "o_totalprice")
    return changed.withColumns(rounded({"reference_mean": 4, "fold_change": 6}))


QUERIES = {
    "fold_change_null_key": Query(fold_change_null_key, """
WITH r AS (SELECT o_orderkey, nullif(o_orderpriority, '2-HIGH') AS priority, o_orderstatus, o_totalprice FROM orders),
m AS (SELECT priority, avg(o_totalprice) AS mean FROM r WHERE o_orderstatus = 'F' GROUP BY priority)
SELECT o_orderkey, r.priority, o_orderstatus, o_totalprice, round(mean, 4) AS reference_mean, round(o_totalprice / mean, 6) AS fold_change
FROM r LEFT JOIN m ON r.priority IS NOT DISTINCT FROM m.priority"""),
    "per_enzyme_rate": Query(per_enzyme_rate, """
SELECT l_orderkey, l_linenumber, l_partkey, l_quantity, l_extendedprice, round(l_extendedprice / 120, 6) AS sec_slope,
       CASE WHEN l_discount = 0 OR l_quantity = 0 THEN NULL ELSE
         round((l_extendedprice / 120) / (l_quantity * (1 / 1000::DOUBLE) * l_discount * (1 / 1000::DOUBLE) * 1e9 / (sqrt(p_retailprice) * 1000)), 4)
       END AS nm_slope
FROM lineitem JOIN part ON l_partkey = p_partkey"""),
    "log_rate": Query(log_rate, f"""
SELECT l_orderkey, l_linenumber, l_quantity, round(rate * 2 * 60, 6) AS hr_slope, round(rate * {PER_NMOL}::DOUBLE, 6) AS nm_slope,
       CASE WHEN rate > 1e-9 THEN round(log10(rate * {PER_NMOL}::DOUBLE), 6) END AS log_slope
FROM (SELECT *, l_discount - 0.05::DOUBLE AS rate FROM lineitem)"""),
    "dim_normalised": Query(dim_normalised, """
SELECT l_suppkey, colony, CASE WHEN s_acctbal <> 0 THEN round(top / (s_acctbal / 1000), 4) END AS max_slope
FROM (SELECT l_suppkey, max(l_extendedprice) AS top, 'supplier#' || lpad(CAST(l_suppkey AS VARCHAR), 9, '0') AS colony
      FROM lineitem GROUP BY l_suppkey) LEFT JOIN supplier ON colony = lower(s_name)"""),
    "fold_change": Query(fold_change, """
WITH ref AS (SELECT o_orderpriority, avg(o_totalprice) AS r FROM orders WHERE o_orderstatus = 'F' GROUP BY 1)
SELECT o_orderkey, o.o_orderpriority, o_orderstatus, o_totalprice, round(r, 4) AS reference_mean,
       round(o_totalprice / r, 6) AS fold_change
FROM orders o LEFT JOIN ref ON o.o_orderpriority = ref.o_orderpriority"""),
    "reference_means": Query(reference_means, """
WITH ref AS (SELECT o_orderpriority, avg(o_totalprice) AS r FROM orders WHERE o_orderstatus = 'F' GROUP BY 1)
SELECT o.o_orderpriority, o_orderstatus, round(avg(o_totalprice), 4) AS mean_slope, round(avg(o_totalprice / r), 6) AS mean_fc
FROM orders o JOIN ref ON o.o_orderpriority = ref.o_orderpriority WHERE o_orderstatus IN ('F', 'O') GROUP BY 1, 2"""),
    "response_curve": Query(response_curve, f"SELECT {BRAND_NUMBER} AS temperature, {CURVE_SQL} FROM part GROUP BY 1"),
    "response_curve_nan": Query(response_curve_nan, f"""
SELECT {BRAND_NUMBER} AS temperature, {CURVE_SQL.replace('p_retailprice', 'price').replace('count(*)', 'count(price)')}
FROM (SELECT p_brand, CASE WHEN p_partkey % 11 <> 0 THEN p_retailprice END AS price FROM part) GROUP BY 1"""),
    "half_unit_repair": Query(half_unit_repair, """
SELECT p_partkey, p_size, CASE WHEN p_size BETWEEN 10 AND 99 AND p_size % 10 = 5 THEN p_size / 10.0::DOUBLE
       ELSE CAST(p_size AS DOUBLE) END AS ph FROM part"""),
    "ph_curve": Query(ph_curve, f"""
SELECT CASE WHEN p_size BETWEEN 10 AND 99 AND p_size % 10 = 5 THEN p_size / 10.0::DOUBLE ELSE CAST(p_size AS DOUBLE) END AS ph,
       {CURVE_SQL} FROM part GROUP BY 1"""),
    "curve_family": Query(curve_family, f"""
SELECT CASE split_part(p_name, ' ', -1) WHEN 'bolt' THEN 20.0::DOUBLE WHEN 'ring' THEN 2.0::DOUBLE ELSE 10.0::DOUBLE END AS enzyme_ul,
       {BRAND_NUMBER} AS temperature, {CURVE_SQL}
FROM part WHERE split_part(p_name, ' ', -1) IN ('bolt', 'ring', 'widget') GROUP BY 1, 2"""),
    "clean_rates": Query(clean_rates, """
SELECT DISTINCT o_custkey AS org, o_totalprice AS max_slope, o_orderpriority FROM orders"""),
}
