"""Sections, fields, traces, classes and file provenance."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ratewell import scale, schemas
from ratewell.functions.text import first_match, token
from ratewell.operators import controls, sections
from ratewell.sources import scans, sinks
from ratewell.table_queries.common import Query, events, scratch_folder, table

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
          "documents", "embeddings", "pages", "benchmark", "labels", "conversations"]
CLASSES = [("^si", "early"), ("^e", "late"), ("i", "middle")]


def section_split(spark: SparkSession, folder: str) -> DataFrame:
    """Each user turn opens a section and names the column of the turns that follow."""
    turns = table(spark, folder, "conversations").withColumn("cells", F.array("role", F.md5("text")))
    return sections.section_table(turns, ["conv_id"], "turn", "cells", F.col("role") == "user")


def section_numbers(spark: SparkSession, folder: str) -> DataFrame:
    turns = table(spark, folder, "conversations").select("conv_id", "turn", "role")
    return sections.number_sections(turns, ["conv_id"], ["turn"], F.col("role") == "user")


def provenance_scan(spark: SparkSession, folder: str) -> DataFrame:
    rows = scans.scan_provenance(spark, f"{folder}/*.parquet", include=r"\.parquet$", exclude="~|setup|Bradford|screenshot")
    return rows.groupBy("source").agg(F.count(F.lit(1)).alias("n"))


def parsed_fields(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "customer")
    return rows.select(
        "c_custkey",
        token("c_name", "#", 1).alias("kind"), F.coalesce(token("c_name", "#", 3), F.lit("none")).alias("absent"),
        token("c_name", "#", -1).try_cast("double").alias("number"),
        F.coalesce(token("c_mktsegment", "E", 1).try_cast("double"), F.lit(-1.0)).alias("not_a_number"),
        F.trim(F.concat(F.lit("  "), F.col("c_mktsegment"), F.lit(" "))).alias("segment"),
        F.concat_ws("_", "c_mktsegment", F.col("c_nationkey").cast("string")).alias("idvar"))


def substrates(spark: SparkSession, folder: str) -> DataFrame:
    return controls.distinct_substrates(table(spark, folder, "part"), "p_name", 2, " ")


def hplc_time_course(spark: SparkSession, folder: str) -> DataFrame:
    """Part rows written as HPLC cells, parsed back and averaged per enzyme, time and compound."""
    cells = table(spark, folder, "part").select(
        "p_partkey",
        F.concat_ws("_", F.regexp_replace("p_type", " ", "-"), F.lit("1"), token("p_name", " ", -1)).alias("variable"),
        F.concat(F.col("p_size").cast("string"), F.lit("h")).alias("time"),
        F.concat(F.col("p_retailprice").cast("string"), F.lit(" uM")).alias("value"))
    course = sections.time_course(sections.hplc_fields(cells))
    return course.select("p_partkey", "enzyme", "compound", "time_hrs", "conc", "idvar",
                         F.round("mean", 6).alias("mean"), F.round("sd", 6).alias("sd"), "n")


def trace_window(spark: SparkSession, folder: str) -> DataFrame:
    trace = events(spark, folder).where(F.col("event_type") != "error")
    shown = sections.trace_window(trace, "minutes", 40000.0, (3000.0, 30000.0))
    return shown.select("event_id", "event_type", F.round("minutes", 9).alias("minutes"), "value")


def classify_first_match(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "events").select(
        "event_id", "event_type", first_match("event_type", CLASSES, "other").alias("sample"))


def catalogue(spark: SparkSession, folder: str) -> DataFrame:
    """Orders and line items as slope files of two assays, stacked and catalogued."""
    orders = table(spark, folder, "orders").select(
        F.concat(F.lit("out/"), F.date_format("o_orderdate", "yyyyMMdd"), F.lit("_x_4NP_"), F.col("o_orderstatus"),
                 F.lit("_1_all_data_calculated_slopes.csv")).alias("file_name"),
        F.col("o_orderkey").alias("org"), (F.col("o_totalprice") / 7).alias("max_slope"),
        (F.col("o_custkey") / 7).alias("r2"))
    items = table(spark, folder, "lineitem").select(
        F.concat(F.lit("out/"), F.date_format("l_shipdate", "yyyyMMdd"), F.lit("_x_4NP_"), F.col("l_returnflag"),
                 F.lit("_all_data_calculated_slopes.csv")).alias("file_name"),
        F.col("l_orderkey").alias("org"), (F.col("l_extendedprice") / 7).alias("max_slope"),
        (F.col("l_partkey") / 7).alias("r2"))
    return sinks.catalogue(orders.unionByName(items))


def numbered_lines(spark: SparkSession, folder: str) -> DataFrame:
    """Customers written as text files in key order, read back with line numbers.

    Keys are consecutive, so in every file the key minus its line number is constant.
    """
    path = scratch_folder(spark)
    rows = table(spark, folder, "customer").select("c_custkey", "c_name")
    ordered = rows.repartitionByRange(4, "c_custkey").sortWithinPartitions("c_custkey")
    ordered.write.option("header", False).csv(path)
    lines = scans.numbered_lines(spark, path, include="csv$").withColumn(
        "c_custkey", token("value", ",", 1).cast("bigint"))
    starts = lines.groupBy("file_name").agg(F.min("c_custkey").alias("first"))
    joined = scale.join_dimension(lines, starts, ["file_name"])
    return joined.select("c_custkey", token("value", ",", 2).alias("c_name"),
                         (F.col("c_custkey") - F.col("line_no") == F.col("first") - 1).alias("in_place"))


def rates_round_trip(spark: SparkSession, folder: str) -> DataFrame:
    """Line item prices as rates per flag: written in folders, scanned back with a schema."""
    path = scratch_folder(spark)
    rates = table(spark, folder, "lineitem").select(
        F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey").alias("org"),
        F.col("l_extendedprice").alias("max_slope"), F.col("l_discount").alias("r2"),
        F.col("l_tax").alias("intercept"), "l_returnflag")
    sinks.write_rates(rates, path, ["l_returnflag"])
    schema = T.StructType([*schemas.RATES.fields, T.StructField("l_returnflag", T.StringType())])
    back = scans.scan_table(spark, path, schema, include="csv$")
    return back.drop("file_name")


QUERIES = {
    "numbered_lines": Query(numbered_lines, "SELECT c_custkey, c_name, TRUE AS in_place FROM customer"),
    "rates_round_trip": Query(rates_round_trip, """
SELECT l_orderkey || '-' || l_linenumber || '-' || l_partkey AS org, l_extendedprice AS max_slope, l_discount AS r2,
       l_tax AS intercept, l_returnflag FROM lineitem"""),
    "section_split": Query(section_split, """
WITH s AS (SELECT *, CAST(count(*) FILTER (WHERE role = 'user') OVER (PARTITION BY conv_id ORDER BY turn) AS BIGINT) AS section
           FROM conversations)
SELECT d.conv_id, d.section, d.turn, d.role AS time, md5(h.text) AS variable, md5(d.text) AS value
FROM s d JOIN s h ON d.conv_id = h.conv_id AND d.section = h.section AND h.role = 'user'
WHERE d.role <> 'user'"""),
    "section_numbers": Query(section_numbers, """
SELECT conv_id, turn, role, CAST(count(*) FILTER (WHERE role = 'user') OVER (PARTITION BY conv_id ORDER BY turn) AS BIGINT) AS section
FROM conversations"""),
    "provenance_scan": Query(provenance_scan, "\nUNION ALL\n".join(
        f"SELECT '{t}' AS source, count(*) AS n FROM {t}" for t in TABLES)),
    "parsed_fields": Query(parsed_fields, """
SELECT c_custkey, split_part(c_name, '#', 1) AS kind, 'none' AS absent,
       TRY_CAST(split_part(c_name, '#', -1) AS DOUBLE) AS number,
       coalesce(TRY_CAST(split_part(c_mktsegment, 'E', 1) AS DOUBLE), -1.0::DOUBLE) AS not_a_number,
       c_mktsegment AS segment, c_mktsegment || '_' || CAST(c_nationkey AS VARCHAR) AS idvar
FROM customer"""),
    "substrates": Query(substrates, "SELECT DISTINCT lower(split_part(p_name, ' ', 2)) AS substrate FROM part"),
    "hplc_time_course": Query(hplc_time_course, """
WITH p AS (SELECT p_partkey, replace(p_type, ' ', '-') AS enzyme, split_part(p_name, ' ', -1) AS compound, p_size, p_retailprice,
                  replace(p_type, ' ', '-') || '_' || p_size || 'h_' || split_part(p_name, ' ', -1) AS idvar FROM part)
SELECT p_partkey, enzyme, compound, CAST(p_size AS DOUBLE) AS time_hrs, p_retailprice AS conc, idvar,
       round(avg(p_retailprice) OVER g, 6) AS mean, round(stddev_samp(p_retailprice) OVER g, 6) AS sd, count(*) OVER g AS n
FROM p WINDOW g AS (PARTITION BY idvar)"""),
    "trace_window": Query(trace_window, """
SELECT event_id, event_type, round(minutes, 9) AS minutes, value
FROM (SELECT *, (epoch_us(ts) - epoch_us(TIMESTAMP '2024-01-01')) / 1e6 / 60 AS minutes FROM events)
WHERE event_type <> 'error' AND minutes < 40000 AND minutes BETWEEN 3000 AND 30000"""),
    "classify_first_match": Query(classify_first_match, """
SELECT event_id, event_type, CASE WHEN event_type LIKE 'si%' THEN 'early' WHEN event_type LIKE 'e%' THEN 'late'
       WHEN event_type LIKE '%i%' THEN 'middle' ELSE 'other' END AS sample FROM events"""),
    "catalogue": Query(catalogue, """
SELECT strftime(o_orderdate, '%Y%m%d') AS date,
       'out/' || strftime(o_orderdate, '%Y%m%d') || '_x_4NP_' || o_orderstatus || '_1_all_data_calculated_slopes.csv' AS file_name,
       o_orderkey AS org, round_even(o_totalprice / 7, 4) AS max_slope, round_even(o_custkey / 7::DOUBLE, 4) AS r2,
       o_orderstatus AS substrate FROM orders
UNION ALL
SELECT strftime(l_shipdate, '%Y%m%d'),
       'out/' || strftime(l_shipdate, '%Y%m%d') || '_x_4NP_' || l_returnflag || '_all_data_calculated_slopes.csv',
       l_orderkey, round_even(l_extendedprice / 7, 4), round_even(l_partkey / 7::DOUBLE, 4), l_returnflag FROM lineitem"""),
}
