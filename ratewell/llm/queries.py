"""The operators as queries on the given tables, with checking SQL where SQL can state them."""

from __future__ import annotations

from collections.abc import Callable
from typing import NamedTuple

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ratewell.llm import (
    bpe, conversation_trie, jaccard_join, katz, line_dedup, merkle, packing, quality_gbt, quality_rules, simhash, token_counts, toxicity,
    url_filter,
)
from ratewell.llm.check_sql import MERKLE_SQL, TRIE_SQL
from ratewell.llm.common import held_out, table


class Query(NamedTuple):
    """A Spark query and its checking SQL (None where no SQL can state it)."""

    run: Callable[[SparkSession, str], DataFrame]
    sql: str | None


# Fixed values of the URL filter's contract.
URL_RULES = [
    ("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow"),
]


def vocabulary_path() -> str:
    return public_tokenizers.path("byte_bpe_50k.json")


def word_vocabulary() -> str:
    return bpe.vocabulary(public_tokenizers.path("word_bpe_49k.json"))


def _classified(spark: SparkSession, folder: str, method, label: str, threshold: float) -> DataFrame:
    """Fit on the labelled rows that are not held out, score every document."""
    docs = table(spark, folder, "documents").select("doc_id", "text")
    out = held_out(F.col("doc_id"), 5, 0)
    model = method.fit(docs, table(spark, folder, "labels"), ~out, label)
    return method.score(docs, model).select(
        "doc_id", out.alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted")
    )


def toxicity_query(spark: SparkSession, folder: str) -> DataFrame:
    return _classified(spark, folder, toxicity, "toxic", 0.5)


def quality_query(spark: SparkSession, folder: str) -> DataFrame:
    return _classified(spark, folder, quality_gbt, "quality", 0.3)


def simhash_query(spark: SparkSession, folder: str) -> DataFrame:
    return simhash.simhash(table(spark, folder, "documents"))


def bpe_query(spark: SparkSession, folder: str) -> DataFrame:
    return bpe.encode_digests(table(spark, folder, "documents"), vocabulary_path())


def url_filter_query(spark: SparkSession, folder: str) -> DataFrame:
    rules = spark.createDataFrame(URL_RULES, "host string, path string, action string")
    pages = table(spark, folder, "pages").select("page_id", "url")
    return url_filter.judge(pages, rules).select("page_id", "host", "path", "rule", "verdict")


URL_FILTER_SQL = """
WITH rest AS (
  SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest
  FROM pages),
parts AS (
  SELECT page_id,
         translate(regexp_extract(rest, '^[^/?#]*', 0), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path
  FROM rest),
rules(rule_host, rule_path, action) AS (
  VALUES ('net', '/', 'block'), ('example.net', '/en/', 'allow'), ('example.com', '/de/', 'block'), ('org', '/fr/', 'allow')),
fits AS (
  SELECT page_id, rule_host || rule_path AS rule, action,
         row_number() OVER (PARTITION BY page_id ORDER BY length(rule_host || rule_path) DESC) AS place
  FROM parts JOIN rules
    ON (host = rule_host OR ends_with(host, '.' || rule_host)) AND starts_with(path, rule_path))
SELECT p.page_id, p.host, p.path, f.rule, coalesce(f.action, 'allow') AS verdict
FROM parts p LEFT JOIN fits f ON f.page_id = p.page_id AND f.place = 1"""


def katz_query(spark: SparkSession, folder: str) -> DataFrame:
    return katz.score_documents(table(spark, folder, "documents"), held_out(F.col("doc_id"), 7, 2))


def packing_query(spark: SparkSession, folder: str) -> DataFrame:
    return packing.pack(table(spark, folder, "documents"), vocabulary_path())


def quality_rules_query(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text")
    return quality_rules.quality_rules(docs).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept",
        F.round("quality_posterior", 9).alias("quality_posterior"),
    )


def jaccard_query(spark: SparkSession, folder: str) -> DataFrame:
    found = jaccard_join.jaccard_components(table(spark, folder, "documents"))
    return found.select("doc_id", "n_shingles", "component_id")


JACCARD_SQL = r"""
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(
           translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
           '[^\x20\x09-\x0D]+') AS w
  FROM documents),
shingles AS (
  SELECT DISTINCT doc_id, array_to_string(w[i : i + 4], ' ') AS s
  FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i FROM words WHERE len(w) > 0)),
sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
shared AS (
  SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS common
  FROM shingles a JOIN shingles b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY 1, 2),
links AS (
  SELECT x, y FROM shared JOIN sizes p ON p.doc_id = x JOIN sizes q ON q.doc_id = y
  WHERE 100 * common >= 75 * (p.n + q.n - common)),
reach(x, y) AS (SELECT x, y FROM links UNION SELECT r.x, l.y FROM reach r JOIN links l ON l.x = r.y)
SELECT d.doc_id, coalesce(any_value(n), 0) AS n_shingles, least(d.doc_id, min(y)) AS component_id
FROM documents d LEFT JOIN sizes s ON s.doc_id = d.doc_id LEFT JOIN reach r ON r.x = d.doc_id GROUP BY d.doc_id"""


def line_dedup_query(spark: SparkSession, folder: str) -> DataFrame:
    cleaned = line_dedup.dedup_lines(table(spark, folder, "documents").select("doc_id", "text"))
    return cleaned.select("doc_id", "removed_words", "text")


def merkle_query(spark: SparkSession, folder: str) -> DataFrame:
    return merkle.document_manifest(table(spark, folder, "documents"), held_out(F.col("doc_id"), 5, 0))


def token_counts_query(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select(
        "doc_id", "text", F.octet_length(F.coalesce("text", F.lit(""))).cast("long").alias("n_bytes"))
    counted = token_counts.count_tokens(docs, word_vocabulary(), ["doc_id", "n_bytes"])
    return counted.withColumn("over_limit", F.col("n_tokens") > 2048)


def conversation_trie_query(spark: SparkSession, folder: str) -> DataFrame:
    turns = table(spark, folder, "conversations")
    return conversation_trie.prefix_nodes(conversation_trie.with_family_heads(turns))


QUERIES = {
    "op1_toxicity": Query(toxicity_query, None),
    "op2_simhash": Query(simhash_query, None),
    "op3_bpe": Query(bpe_query, None),
    "op4_url_filter": Query(url_filter_query, URL_FILTER_SQL),
    "op5_katz": Query(katz_query, None),
    "op6_packing": Query(packing_query, None),
    "op7_quality_rules": Query(quality_rules_query, None),
    "op8_jaccard": Query(jaccard_query, JACCARD_SQL),
    "op9_quality": Query(quality_query, None),
    "op10_line_dedup": Query(line_dedup_query, None),
    "op11_merkle": Query(merkle_query, MERKLE_SQL),
    "op12_token_counts": Query(token_counts_query, None),
    "op13_conversation_trie": Query(conversation_trie_query, TRIE_SQL),
}
