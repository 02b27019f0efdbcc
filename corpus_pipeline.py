"""From documents to packed sequences in five stages; each stage's result is written and read again."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ratewell.llm import jaccard_join, line_dedup, packing, quality_gbt, toxicity
from ratewell.llm.common import held_out, table
from ratewell.llm.queries import Query, vocabulary_path
from ratewell.scale import ensure_checkpoint_dir, join_dimension, settle

MAX_TOXICITY = 0.5
MIN_QUALITY = 0.3
#: Bytes of an Arrow batch between Spark and its Python workers. Tasks hold several on both sides, outside the heap.
BATCH_BYTES = 4 * 1024 * 1024

#: The classifiers and the cut of repeated runs have no statement in SQL.
ORACLE_SQL = None


Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def small_batches(stage: Stage) -> Stage:
    """The same stage in a session whose Arrow batches are bounded by BATCH_BYTES, not by 10,000 rows of any size.

    The setting stays, since the stage's rows are made when they are written.
    """
    @wraps(stage)
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)
        return stage(spark, docs, sf_dir)

    return run_stage


@small_batches
def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity stays below MAX_TOXICITY."""
    return _classified(spark, docs, sf_dir, toxicity, "toxic").where(F.col("_score") < MAX_TOXICITY).select(*docs.columns)


@small_batches
def drop_poor(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose quality reaches MIN_QUALITY."""
    return _classified(spark, docs, sf_dir, quality_gbt, "quality").where(F.col("_score") >= MIN_QUALITY).select(*docs.columns)


def _classified(spark: SparkSession, docs: DataFrame, sf_dir: str, method, label: str) -> DataFrame:
    model = method.fit(docs, table(spark, sf_dir, "labels"), ~held_out(F.col("doc_id"), 5, 0), label)
    return method.score(docs, model, out="_score")


@small_batches
def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without runs of lines that an earlier document has; those that are nothing else go."""
    cleaned = line_dedup.dedup_lines(docs)
    emptied = (F.col("removed_words") > 0) & ~F.coalesce(F.col("text").rlike("[^\\x20\\x09-\\x0D]"), F.lit(False))
    n_chars = F.when(F.col("removed_words") > 0, F.length("text")).otherwise(F.col("n_chars")).cast("long")
    return cleaned.where(~emptied).withColumn("n_chars", n_chars).select(*docs.columns)


@small_batches
def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies the document with the smallest id, no id last; one of rows with the same id and text.

    A row is known by a code of its id and text, so what repeats an id is decided by its own text. Texts without words
    are linked with nothing and stay.
    """
    coded = docs.withColumn("_row", F.xxhash64("doc_id", "text"))
    found = jaccard_join.jaccard_components(coded.select(F.col("_row").alias("doc_id"), "text")).where("n_shingles > 0")
    rows = settle(found.select(F.col("doc_id").alias("_row"), "component_id").join(
        coded.groupBy("_row").agg(F.min("doc_id").alias("doc_id"), F.count(F.lit(1)).alias("_n")), "_row").distinct())
    first = F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "_row", "_n")).alias("_first")
    stay = settle(rows.groupBy("component_id").agg(first).select("_first.*"))
    others = join_dimension(rows, stay.select("_row"), ["_row"], "left_anti", settled=True).select("_row")
    repeated = stay.where("_n > 1").select("_row")
    kept = join_dimension(coded, others, ["_row"], "left_anti")
    once = join_dimension(kept, repeated, ["_row"], "left_anti", settled=True)
    one_each = join_dimension(kept, repeated, ["_row"], "left_semi", settled=True).dropDuplicates(["_row"])
    return once.unionByName(one_each).select(*docs.columns)


@small_batches
def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of sequences of at most 2048 tokens."""
    return packing.pack(docs, vocabulary_path())


STAGES: list[tuple[str, Stage]] = [
    ("toxicity", drop_toxic),
    ("quality classifier", drop_poor),
    ("line dedup", drop_repeated_lines),
    ("n-gram Jaccard join", drop_near_copies),
    ("packing", pack),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, their results in the shared checkpoint folder."""
    ensure_checkpoint_dir(spark)
    folder = f"{spark.sparkContext.getCheckpointDir()}/{uuid.uuid4()}"
    docs = table(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{i}")
        docs = spark.read.parquet(f"{folder}/{i}")
    return docs


QUERY = Query(run, ORACLE_SQL)
