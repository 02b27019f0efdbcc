"""Scans and sinks: tables written in the shapes of the instruments' files and read back."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ratewell.operators import cleaning, curves
from ratewell.plans.assays import StandardSettings, standard_curve
from ratewell.sources import scans, sinks
from ratewell.table_queries.common import Query, rounded, scratch_folder, table

PREAMBLE = ["Instrument, x", "Sample: a, b"]


def _lines(rows: DataFrame, part: Column, order: str, value: Column, first: list[str], path: str) -> None:
    """One text file per value of ``part``: the ``first`` lines, then a line per row in order."""
    body = rows.select(part.alias("part"), F.lit(1).alias("_body"), F.col(order).cast("long").alias("_order"), value.alias("value"))
    head = rows.select(part.alias("part")).distinct().select(
        "part", F.lit(0).alias("_body"), F.posexplode(F.array(*[F.lit(x) for x in first])).alias("_order", "value"))
    lines = head.withColumn("_order", F.col("_order").cast("long")).unionByName(body)
    lines.repartition("part").sortWithinPartitions("part", "_body", "_order").select("part", "value").write.partitionBy("part").text(path)


def scan_past_preamble(spark: SparkSession, folder: str) -> DataFrame:
    """Traces with preamble and header lines."""
    path = scratch_folder(spark)
    orders = table(spark, folder, "orders").select("o_orderkey", "o_totalprice", "o_orderstatus")
    line = F.concat_ws(",", "o_orderkey", "o_totalprice")
    _lines(orders, F.col("o_orderstatus"), "o_orderkey", line, [*PREAMBLE, "time (min),value (mAU)"], path)
    schema = T.StructType([T.StructField("time_min", T.LongType()), T.StructField("value_m_au", T.DoubleType())])
    return scans.scan_after_header(spark, path, schema, skip=len(PREAMBLE)).select("line_no", "time_min", "value_m_au")


def scan_tabs(spark: SparkSession, folder: str) -> DataFrame:
    path = scratch_folder(spark)
    table(spark, folder, "customer").select("c_custkey", "c_name", "c_acctbal").write.option("sep", "\t").option("header", True).csv(path)
    return scans.scan_table(spark, path, "c_custkey long, c_name string, c_acctbal double", sep="\t").drop("file_name")


def scan_without_header(spark: SparkSession, folder: str) -> DataFrame:
    """Files whose header lines stay among the rows until they are told apart."""
    path = scratch_folder(spark)
    table(spark, folder, "supplier").select("s_suppkey", "s_name", "s_acctbal").write.option("header", True).csv(path)
    rows = scans.scan_headerless(spark, path, ["key", "name", "balance"]).drop("file_name")
    kept = cleaning.drop_header_rows(rows, "name", "s_name")
    return cleaning.cast_text(cleaning.cast_text(kept, ["balance"]), ["key"], "bigint")


def normalised_round_trip(spark: SparkSession, folder: str) -> DataFrame:
    """Normalised rates in one folder per enzyme amount, in two runs; the second writes one amount of the first again."""
    path = scratch_folder(spark)
    rates = table(spark, folder, "lineitem").select(
        F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey").alias("org"), F.col("l_extendedprice").alias("max_slope"),
        (F.col("l_linenumber") * 5).cast("int").alias("enzyme_ul"))
    early = F.col("enzyme_ul") <= 15
    sinks.write_normalised(rates.where(early).withColumn("max_slope", F.when(F.col("enzyme_ul") == 15, 0.0).otherwise(F.col("max_slope"))), path)
    sinks.write_normalised(rates.where(~early | (F.col("enzyme_ul") == 15)), path)
    return scans.scan_table(spark, path, "org string, max_slope double, enzyme_ul int").drop("file_name")


def layout_check_round_trip(spark: SparkSession, folder: str) -> DataFrame:
    path = scratch_folder(spark)
    pairs = table(spark, folder, "nation").select(
        F.col("n_regionkey").cast("string").alias("plate_id"), F.col("n_nationkey").cast("long").alias("position"),
        F.col("n_name").alias("instrument_name"), F.concat(F.lit("NA "), F.col("n_name")).alias("template_name"))
    sinks.write_layout_check(pairs, path)
    return scans.scan_table(
        spark, path, "plate_id string, position long, instrument_name string, template_name string").drop("file_name")


def catalogue_round_trip(spark: SparkSession, folder: str) -> DataFrame:
    path = scratch_folder(spark)
    orders = table(spark, folder, "orders").select(
        F.concat(F.lit("out/"), F.date_format("o_orderdate", "yyyyMMdd"), F.lit("_x_4NP_"), F.col("o_orderstatus"),
                 F.lit("_all_data_calculated_slopes.csv")).alias("file_name"),
        F.col("o_orderkey").cast("string").alias("org"), (F.col("o_totalprice") / 7).alias("max_slope"), F.lit(0.5).alias("r2"))
    sinks.write_catalogue(sinks.catalogue(orders), path)
    back = scans.scan_table(spark, path, "date string, file string, org string, max_slope double, r2 double, substrate string")
    return back.select("date", "org", "max_slope", "substrate")


def headers_and_columns(spark: SparkSession, folder: str) -> DataFrame:
    """Headers as instruments write them, cleaned; columns kept by a part of their name."""
    rows = table(spark, folder, "lineitem").select(
        F.col("l_orderkey").alias("Order Key"), F.col("l_linenumber").alias("Line.Number"), F.col("l_tax").alias("T° 410"),
        F.col("l_discount").alias("discountRate"), F.col("l_quantity").alias("405 (nm)"))
    return cleaning.keep_columns_containing(cleaning.normalise_header(rows), ["ORDER", "number", "rate", "x405"])


def standards_but_one(spark: SparkSession, folder: str) -> DataFrame:
    """A standard curve that leaves one level out."""
    reads = table(spark, folder, "lineitem").select(
        "l_returnflag", F.concat(F.lit("stdcurve_"), F.col("l_quantity").cast("int").cast("string")).alias("label"),
        F.col("l_extendedprice").alias("absorbance"))
    line = standard_curve(reads, ["l_returnflag"], StandardSettings(exclude="stdcurve_5$"))
    return line.withColumns(rounded({"b": 4, "m": 6})).select("l_returnflag", "n", "b", "m")


def amount_from_name(spark: SparkSession, folder: str) -> DataFrame:
    """Amounts in file names next to a date, averaged per amount."""
    rows = table(spark, folder, "orders").select(
        F.concat(F.lit("20230623_lact_"), (F.col("o_custkey") % 7 + 1).cast("string"), F.lit("_slopes.csv")).alias("file_name"), "o_totalprice")
    named = curves.amount_from_file_name(rows, "20230623")
    return curves.response_curve(named, ["amount"], "o_totalprice").select("amount", F.round("mean", 4).alias("mean"), F.round("sd", 4).alias("sd"))


QUERIES = {
    "scan_past_preamble": Query(scan_past_preamble, """
SELECT 3 + row_number() OVER (PARTITION BY o_orderstatus ORDER BY o_orderkey) AS line_no, o_orderkey AS time_min, o_totalprice AS value_m_au
FROM orders"""),
    "scan_tabs": Query(scan_tabs, "SELECT c_custkey, c_name, c_acctbal FROM customer"),
    "scan_without_header": Query(scan_without_header, 'SELECT s_suppkey AS "key", s_name AS name, s_acctbal AS balance FROM supplier'),
    "normalised_round_trip": Query(normalised_round_trip, """
SELECT l_orderkey || '-' || l_linenumber || '-' || l_partkey AS org, l_extendedprice AS max_slope, CAST(l_linenumber * 5 AS INTEGER) AS enzyme_ul
FROM lineitem"""),
    "layout_check_round_trip": Query(layout_check_round_trip, """
SELECT CAST(n_regionkey AS VARCHAR) AS plate_id, CAST(n_nationkey AS BIGINT) AS position, n_name AS instrument_name,
       'NA ' || n_name AS template_name FROM nation"""),
    "catalogue_round_trip": Query(catalogue_round_trip, """
SELECT strftime(o_orderdate, '%Y%m%d') AS date, CAST(o_orderkey AS VARCHAR) AS org, round_even(o_totalprice / 7, 4) AS max_slope,
       o_orderstatus AS substrate FROM orders"""),
    "headers_and_columns": Query(headers_and_columns, """
SELECT l_orderkey AS order_key, l_linenumber AS line_number, l_discount AS discount_rate, l_quantity AS x405_nm FROM lineitem"""),
    "standards_but_one": Query(standards_but_one, """
SELECT l_returnflag, CAST(regr_count(y, x) AS BIGINT) AS n, round(regr_intercept(y, x), 4) AS b, round(regr_slope(y, x), 6) AS m
FROM (SELECT l_returnflag, 8 * l_quantity AS x, l_extendedprice AS y FROM lineitem WHERE l_quantity <> 5) GROUP BY 1"""),
    "amount_from_name": Query(amount_from_name, """
SELECT CAST(o_custkey % 7 + 1 AS DOUBLE) AS amount, round(avg(o_totalprice), 4) AS mean, round(stddev_samp(o_totalprice), 4) AS sd
FROM orders GROUP BY 1"""),
}
