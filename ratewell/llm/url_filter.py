"""URL filter: host-suffix and path-prefix expressions meet rules on short hash prefixes.

Each URL is expanded into the expressions that a rule could have: its last k host
labels with the first n characters of its path, for each (k, n) among the rules. The
join is on the first eight hex digits of the expression's SHA-256; the whole digest
confirms, and the longest rule wins (then the longer host, then block).

Null URLs and URLs without ``://`` have an empty host and path and meet no rule that has a
host. Equal URLs are judged once and share the verdict; an empty table gives an empty one.
Hosts of any length cost the same, since only suffixes that rules can have are built.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ratewell.scale import join_dimension, match_keys

PREFIX_DIGITS = 8


def url_host(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z in lower case."""
    host = F.regexp_extract(_rest(url), "^[^/?#]*", 0)
    return F.translate(host, string.ascii_uppercase, string.ascii_lowercase)


def url_path(url: Column) -> Column:
    """After the host up to ``?``, ``#`` or the end."""
    return F.regexp_extract(_rest(url), "^[^/?#]*([^?#]*)", 1)


def _rest(url: Column) -> Column:
    url = F.coalesce(url, F.lit(""))
    return F.when(F.locate("://", url) > 0, F.substring(url, F.locate("://", url) + 3, F.length(url))).otherwise("")


def _labels(host: Column) -> Column:
    return F.length(host) - F.length(F.replace(host, F.lit("."), F.lit(""))) + 1


def hashed_rules(rules: DataFrame) -> DataFrame:
    """Rules (host, path, action) with digest and prefix; null parts count as empty, repeats once, block before allow."""
    rule = F.concat("host", "path")
    return (
        rules.select(F.coalesce("host", F.lit("")).alias("host"), F.coalesce("path", F.lit("")).alias("path"), "action")
        .groupBy("host", "path").agg(F.max("action").alias("action"))
        .select(
            rule.alias("rule"), "action", F.sha2(rule, 256).alias("rule_digest"),
            F.length(rule).alias("rule_length"), F.length("host").alias("host_length"),
            _labels(F.col("host")).alias("labels"), F.length("path").alias("path_length"),
        )
        .withColumn("prefix", F.substring("rule_digest", 1, PREFIX_DIGITS))
    )


def judge(pages: DataFrame, rules: DataFrame, url: str = "url", default: str = "allow") -> DataFrame:
    """All columns of ``pages`` with host, path, rule (null if none fits) and verdict.

    ``rules`` has host, path and action (``block`` or ``allow``). The distinct (label count,
    path length) pairs of the rules are fetched; URL lengths bound their number. Columns of
    ``pages`` named like an added column are replaced.
    """
    hashed = hashed_rules(rules)
    shapes = [tuple(row) for row in hashed.select("labels", "path_length").distinct().orderBy("labels", "path_length").collect()]
    added = ("host", "path", "rule", "verdict")
    judged = pages.withColumns({"_host": url_host(F.col(url)), "_path": url_path(F.col(url))})
    judged = judged.drop(*added).withColumnsRenamed({"_host": "host", "_path": "path"})
    if not shapes:
        return judged.withColumns({"rule": F.lit(None).cast("string"), "verdict": F.lit(default)})
    expressions = F.array(*[
        F.when(
            (_labels(F.col("host")) >= labels) & (F.length("path") >= length),
            F.concat(F.substring_index("host", ".", -labels), F.substring("path", 1, length)),
        )
        for labels, length in shapes
    ])
    places = (
        judged.select("host", "path").distinct()
        .withColumn("expression", F.explode(F.array_compact(expressions)))
        .withColumn("digest", F.sha2("expression", 256))
        .withColumn("prefix", F.substring("digest", 1, PREFIX_DIGITS))
    )
    best = (
        join_dimension(places, hashed, ["prefix"])
        .where(F.col("digest") == F.col("rule_digest"))
        .groupBy("host", "path")
        .agg(F.max(F.struct("rule_length", "host_length", "action", "rule")).alias("best"))
        .select("host", "path", "best.rule", F.col("best.action").alias("verdict"))
    )
    return match_keys(judged, best, ["host", "path"], "left").withColumn("verdict", F.coalesce("verdict", F.lit(default)))
