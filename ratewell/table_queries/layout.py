"""Wells, labels and templates on embeddings and parts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ratewell.functions.text import strip_replicate
from ratewell.operators import layout
from ratewell.table_queries.common import Query, table

COLUMNS = 8
# 1-based well ranges without a label, per plate kind: fixed values.
MASKS = [(0, 49, 72), (1, 25, 96), (2, 1, 24), (3, 1, 48), (4, 73, 96)]
WELLS_SQL = """SELECT vec_id, label, CAST(i AS INTEGER) AS well_idx, CAST(embedding[i + 1] AS DOUBLE) AS value,
  chr(CAST(65 + i // 8 AS INTEGER)) || CAST(i % 8 + 1 AS VARCHAR) AS well
FROM (SELECT *, unnest(range(len(embedding))) AS i FROM embeddings)"""


def _wells(spark: SparkSession, folder: str) -> DataFrame:
    reads = table(spark, folder, "embeddings").withColumn("wells", F.col("embedding").cast("array<double>"))
    wells = layout.explode_wells(reads, ["vec_id", "label"])
    return wells.withColumn("well", layout.well_name(F.col("well_idx"), COLUMNS))


def well_unpivot(spark: SparkSession, folder: str) -> DataFrame:
    """Wells of every read with the label of their template position."""
    wells = _wells(spark, folder)
    # The last plate column of the template is left without labels.
    names = [F.lit(f"w{c}" if c < COLUMNS - 1 else None).cast("string").alias(f"c{c}") for c in range(COLUMNS)]
    plates = table(spark, folder, "embeddings").select(F.col("label").alias("plate")).distinct()
    grid = plates.select("plate", F.explode(F.sequence(F.lit(0), F.lit(7))).alias("grid_row"), *names)
    template = layout.flatten_grid(grid, ["plate"], "grid_row", [f"c{c}" for c in range(COLUMNS)])
    labelled = layout.label_wells(wells.withColumnRenamed("label", "plate"), template, ["plate"])
    return labelled.select("vec_id", "plate", "well_idx", "well", "label", F.round("value", 6).alias("value"))


def plate_layout(spark: SparkSession, folder: str) -> DataFrame:
    masks = spark.createDataFrame(MASKS, "label int, lo int, hi int")
    kept = layout.mask_wells(_wells(spark, folder), masks, "label")
    return kept.select(
        "vec_id", "label", "well_idx",
        layout.cyclic_replicate(F.col("well"), F.col("well_idx")).alias("replicate"))


def template_rows(spark: SparkSession, folder: str) -> DataFrame:
    return layout.keep_grid_rows(_wells(spark, folder), 3, 4, COLUMNS).select("vec_id", "well", "well_idx")


def wells_near_match(spark: SparkSession, folder: str) -> DataFrame:
    picked = layout.wells_near_match(_wells(spark, folder), ["vec_id"], F.col("value") > 0.2)
    return picked.select("vec_id", "well_idx", "well")


def layout_check(spark: SparkSession, folder: str) -> DataFrame:
    wells = _wells(spark, folder).withColumnRenamed("well_idx", "position")
    instrument = wells.where(F.col("position") > 0).withColumn("instrument_name", F.col("well"))
    template = wells.where(F.col("value") >= 0).withColumn(
        "template_name", F.concat(F.lit("s"), F.col("label").cast("string")))
    pairs = layout.layout_check(instrument, template, ["vec_id"], "position")
    return pairs.na.fill("", ["instrument_name", "template_name"])


def _wells_without_plate(spark: SparkSession, folder: str) -> DataFrame:
    """Wells in which every seventh plate has no id, which makes one more plate of all of these."""
    wells = _wells(spark, folder)
    return wells.groupBy(F.when(F.col("vec_id") % 7 != 0, F.col("vec_id")).alias("plate"), "well_idx").agg(F.max("value").alias("value"))


def layout_check_null_plate(spark: SparkSession, folder: str) -> DataFrame:
    wells = _wells_without_plate(spark, folder).withColumnRenamed("well_idx", "position").withColumn("name", F.col("position").cast("string"))
    instrument = wells.where(F.col("position") > 0).withColumnRenamed("name", "instrument_name")
    template = wells.where(F.col("value") >= 0).withColumnRenamed("name", "template_name")
    return layout.layout_check(instrument, template, ["plate"], "position").select("plate", "position", "state")


def wells_near_match_null_plate(spark: SparkSession, folder: str) -> DataFrame:
    near = layout.wells_near_match(_wells_without_plate(spark, folder), ["plate"], F.col("value") > 0.3)
    return near.select("plate", "well_idx")


NULL_PLATE_SQL = f"""w AS (SELECT CASE WHEN vec_id % 7 <> 0 THEN vec_id END AS plate, well_idx, max(value) AS value
  FROM ({WELLS_SQL}) GROUP BY ALL)"""


def label_dedupe(spark: SparkSession, folder: str) -> DataFrame:
    parts = table(spark, folder, "part").select("p_partkey", "p_type", "p_name")
    numbered = layout.unique_labels(parts, ["p_type"], "p_name", ["p_partkey"])
    return numbered.select("p_partkey", "p_type", "unique_label", strip_replicate("unique_label").alias("collapsed"))


def tag_matching(spark: SparkSession, folder: str) -> DataFrame:
    parts = table(spark, folder, "part").select("p_partkey", "p_type", "p_name")
    return layout.tag_matching(parts, ["p_type"], "p_name", ["p_partkey"], "ring")


MASK_SQL = "SELECT * FROM (VALUES " + ", ".join(map(str, MASKS)) + ") AS t(label, lo, hi)"

QUERIES = {
    "well_unpivot": Query(well_unpivot, f"""
SELECT vec_id, label AS plate, well_idx, well, 'w' || CAST(well_idx % 8 AS VARCHAR) AS label, round(value, 6) AS value
FROM ({WELLS_SQL}) WHERE well_idx % 8 <> 7"""),
    "plate_layout": Query(plate_layout, f"""
SELECT vec_id, w.label, well_idx, well || '_rep' || CAST(well_idx % 3 + 1 AS VARCHAR) AS replicate
FROM ({WELLS_SQL}) w WHERE NOT EXISTS (
  SELECT 1 FROM ({MASK_SQL}) m WHERE m.label = w.label AND w.well_idx + 1 BETWEEN m.lo AND m.hi)"""),
    "template_rows": Query(template_rows, f"""
SELECT vec_id, well, well_idx FROM ({WELLS_SQL}) WHERE well_idx // 8 BETWEEN 2 AND 3"""),
    "wells_near_match": Query(wells_near_match, f"""WITH w AS ({WELLS_SQL}),
f AS (SELECT vec_id, min(well_idx) AS first FROM w WHERE value > 0.2 GROUP BY vec_id),
g AS (SELECT w.*, first, coalesce(lag(value, 3) OVER (PARTITION BY w.vec_id ORDER BY well_idx) > 0.2, FALSE) AS behind
      FROM w JOIN f ON w.vec_id = f.vec_id)
SELECT vec_id, well_idx, well FROM g
WHERE value > 0.2 OR behind OR well_idx BETWEEN first - 12 AND first - 7"""),
    "layout_check": Query(layout_check, f"""WITH w AS ({WELLS_SQL})
SELECT vec_id, well_idx AS position, CASE WHEN well_idx > 0 THEN well ELSE '' END AS instrument_name,
       CASE WHEN value >= 0 THEN 's' || CAST(label AS VARCHAR) ELSE '' END AS template_name,
       CASE WHEN value < 0 THEN 'no template' WHEN well_idx = 0 THEN 'no well' ELSE 'paired' END AS state
FROM w WHERE well_idx > 0 OR value >= 0"""),
    "layout_check_null_plate": Query(layout_check_null_plate, f"""WITH {NULL_PLATE_SQL}
SELECT plate, well_idx AS position,
       CASE WHEN value < 0 THEN 'no template' WHEN well_idx = 0 THEN 'no well' ELSE 'paired' END AS state
FROM w WHERE well_idx > 0 OR value >= 0"""),
    "wells_near_match_null_plate": Query(wells_near_match_null_plate, f"""WITH {NULL_PLATE_SQL},
g AS (SELECT *, min(CASE WHEN value > 0.3 THEN well_idx END) OVER (PARTITION BY plate) AS first,
             coalesce(lag(value, 3) OVER (PARTITION BY plate ORDER BY well_idx) > 0.3, FALSE) AS behind FROM w)
SELECT plate, well_idx FROM g
WHERE first IS NOT NULL AND (value > 0.3 OR behind OR well_idx BETWEEN first - 12 AND first - 7)"""),
    "label_dedupe": Query(label_dedupe, """
SELECT p_partkey, p_type, unique_label, regexp_replace(unique_label, '\\.[0-9]', '', 'g') AS collapsed
FROM (SELECT p_partkey, p_type, CASE WHEN k = 1 THEN p_name ELSE p_name || '.' || CAST(k - 1 AS VARCHAR) END AS unique_label
      FROM (SELECT *, row_number() OVER (PARTITION BY p_type, p_name ORDER BY p_partkey) AS k FROM part))"""),
    "tag_matching": Query(tag_matching, """
SELECT p_partkey, p_type,
       CASE WHEN p_name LIKE '%ring%' THEN p_name || '_' || CAST((place - 1) % 3 + 1 AS VARCHAR) ELSE p_name END AS p_name
FROM (SELECT *, CAST(count(*) FILTER (WHERE p_name LIKE '%ring%') OVER (PARTITION BY p_type ORDER BY p_partkey) AS BIGINT) AS place
      FROM part)"""),
}
