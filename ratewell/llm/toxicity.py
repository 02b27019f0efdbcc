"""Toxicity: a linear classifier over word features, regularised by counterfactual swaps.

Sentences of labelled documents that name a group get a twin in which every identity term
is replaced by the next term of its list. The fit adds a penalty on the squared
difference of the two scores, so a neutral mention of a group neither raises nor lowers the
score. Features are the words of a text and their first four and five letters, present or not.

Statistics of features are summed in Spark; the fit runs on at most ``train_docs``
labelled documents (those of the smallest hashed ids), a documented bound. Null and empty texts have no feature
and get the bias alone. Rows without a label, or with a null id, never train; repeated
labels of one id count as the largest. Without labels of both classes the score is the share
of class 1. An empty table gives an empty result.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ratewell.llm.common import CACHE_WORDS, share, shared_value
from ratewell.scale import settle

TRAIN_DOCS = 20_000
MAX_FEATURES = 4096
SENTENCE = re.compile(r"[.!?]\s+|\n")
EDGES = re.compile(r"^\W+|\W+$")
# Lists of terms that may stand for one another in a sentence; a parameter.
IDENTITY_TERMS = (
    ("women", "men", "girls", "boys"),
    ("woman", "man", "girl", "boy"),
    ("christian", "muslim", "jewish", "hindu", "buddhist", "atheist"),
    ("christians", "muslims", "jews", "hindus", "buddhists", "atheists"),
    ("black", "white", "asian", "latino", "african", "european"),
    ("gay", "straight", "lesbian", "bisexual", "transgender"),
    ("immigrants", "refugees", "locals", "foreigners"),
    ("disabled", "deaf", "blind", "elderly"),
)


class ToxicityModel(NamedTuple):
    """Weights by feature code and the bias of the score's log-odds."""

    weights: dict[int, float]
    bias: float


class FeatureCodes(dict):
    """Feature codes of each word, kept for words seen before up to a bound; ``only`` restricts them."""

    def __init__(self, only: dict[int, object] | None = None) -> None:
        self.only = only

    def __missing__(self, word: str) -> tuple[int, ...]:
        if len(self) >= CACHE_WORDS:
            self.clear()
        core = EDGES.sub("", word)
        names = {core, "4 " + core[:4], "5 " + core[:5]} if core else set()
        codes = sorted(xxhash.xxh3_64_intdigest(n) >> 1 for n in names)
        found = self[word] = tuple(c for c in codes if self.only is None or c in self.only)
        return found

    def of(self, text: str) -> set[int]:
        return {c for codes in map(self.__getitem__, set(text.lower().split())) for c in codes}


def swap_terms(sentence: str, terms: tuple[tuple[str, ...], ...]) -> str:
    """The lower-cased sentence with every identity term replaced by the next of its list."""
    after = {word: group[(i + 1) % len(group)] for group in terms for i, word in enumerate(group)}
    return re.sub(r"\w+", lambda m: after.get(m[0], m[0]), sentence.lower())


def sentence_twins(text: str, codes: FeatureCodes, terms: tuple[tuple[str, ...], ...]) -> list[tuple[set, set]]:
    """Features of each sentence that names a group and of its twin, where they differ."""
    named = {word for group in terms for word in group}
    if named.isdisjoint(re.findall(r"\w+", text.lower())):
        return []
    pairs = [(codes.of(s), codes.of(swap_terms(s, terms))) for s in SENTENCE.split(text)]
    return [(a, b) for a, b in pairs if a != b]


def training_rows(
    docs: DataFrame, labels: DataFrame, label: str, train: Column, text: str, train_docs: int
) -> DataFrame:
    """(_label, _text) of at most ``train_docs`` labelled documents that ``train`` admits."""
    chosen = (
        labels.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull() & train)
        .groupBy("doc_id").agg(F.max(label).cast("int").alias("_label"))
        .orderBy(F.xxhash64("doc_id"), "doc_id").limit(train_docs)
    )
    # At most train_docs pairs of numbers are broadcast.
    return docs.select("doc_id", F.coalesce(F.col(text), F.lit("")).alias("_text")).join(
        F.broadcast(chosen), "doc_id"
    ).select("_label", "_text")


def _feature_counts(rows: DataFrame) -> DataFrame:
    def counted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        codes = FeatureCodes()
        for batch in batches:
            found = [np.fromiter(f := codes.of(t), np.int64, len(f)) for t in batch["_text"]]
            all_codes = np.concatenate([np.empty(0, np.int64), *found])
            marks = np.repeat(batch["_label"].to_numpy(), [len(f) for f in found])
            feature, place = np.unique(all_codes, return_inverse=True)
            yield pd.DataFrame({
                "feature": feature, "n": np.bincount(place, minlength=len(feature)),
                "positive": np.bincount(place, marks, minlength=len(feature)).astype(np.int64),
            })

    return (
        rows.mapInPandas(counted, "feature long, n long, positive long")
        .groupBy("feature").agg(F.sum("n").alias("n"), F.sum("positive").alias("positive"))
    )


def fit_weights(
    label: np.ndarray, features: list[np.ndarray], twins: list[tuple[np.ndarray, np.ndarray]], size: int,
    counterfactual: float = 1.0, l1: float = 2e-5, l2: float = 1e-5, rounds: int = 600,
) -> tuple[np.ndarray, float]:
    """Weights and bias: mean log loss + counterfactual * mean squared score change + l1 and l2."""
    n = len(label)
    row, col = np.repeat(np.arange(n), [len(f) for f in features]), np.concatenate([np.empty(0, np.int64), *features])
    pair = np.repeat(np.arange(len(twins)), [len(a) + len(b) for a, b in twins])
    pair_col = np.concatenate([np.empty(0, np.int64), *[x for ab in twins for x in ab]])
    sign = np.concatenate([np.empty(0), *[np.repeat([1.0, -1.0], [len(a), len(b)]) for a, b in twins]])
    w, b = np.zeros(size), math.log((label.sum() + 0.5) / (n - label.sum() + 0.5))
    mean, square, rate = np.zeros(size + 1), np.zeros(size + 1), 0.05
    for t in range(1, rounds + 1):
        p = 1 / (1 + np.exp(-np.clip(np.bincount(row, w[col], minlength=n) + b, -30, 30)))
        error = (p - label) / n
        grad = np.append(np.bincount(col, error[row], minlength=size) + l2 * w, error.sum())
        if len(twins):
            change = np.bincount(pair, sign * w[pair_col], minlength=len(twins))
            grad[:size] += 2 * counterfactual / len(twins) * np.bincount(pair_col, sign * change[pair], minlength=size)
        mean, square = 0.9 * mean + 0.1 * grad, 0.999 * square + 0.001 * grad**2
        step = rate * (mean / (1 - 0.9**t)) / (np.sqrt(square / (1 - 0.999**t)) + 1e-10)
        w, b = w - step[:size], b - step[size]
        w = np.sign(w) * np.maximum(np.abs(w) - rate * l1, 0)
    return w, float(b)


def fit(
    docs: DataFrame, labels: DataFrame, train: Column, label: str = "toxic", text: str = "text",
    train_docs: int = TRAIN_DOCS, terms: tuple[tuple[str, ...], ...] = IDENTITY_TERMS, counterfactual: float = 1.0,
    min_z: float = 4.5, max_features: int = MAX_FEATURES,
) -> ToxicityModel:
    """Choose features whose count in class 1 is far from chance, then fit their weights."""
    rows = settle(training_rows(docs, labels, label, train, text, train_docs))  # read three times
    n, positive = rows.agg(F.count("*"), F.coalesce(F.sum("_label"), F.lit(0))).first()
    if positive in (0, n):
        share = (positive + 0.01) / (n + 1)
        return ToxicityModel({}, math.log(share / (1 - share)))
    share = positive / n
    z = (F.col("positive") - share * F.col("n")) / F.sqrt(F.lit(share * (1 - share)) * F.col("n"))
    chosen = (
        _feature_counts(rows).where(F.col("n") >= 4).withColumn("z", F.abs(z)).where(F.col("z") >= min_z)
        .orderBy(F.desc("z"), "feature").limit(max_features).collect()
    )
    place = {row["feature"]: i for i, row in enumerate(chosen)}

    def coded(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        codes = FeatureCodes(place)
        for batch in batches:
            twins = [sentence_twins(t, codes, terms) for t in batch["_text"]]
            yield pd.DataFrame({
                "label": batch["_label"],
                "features": [sorted(place[c] for c in codes.of(t)) for t in batch["_text"]],
                "left": [[sorted(place[c] for c in a) for a, _ in pairs] for pairs in twins],
                "right": [[sorted(place[c] for c in b) for _, b in pairs] for pairs in twins],
            })

    schema = "label int, features array<long>, left array<array<long>>, right array<array<long>>"
    # At most train_docs rows of at most max_features numbers reach the driver.
    sample = rows.mapInPandas(coded, schema).collect()
    twins = [(np.array(a, int), np.array(b, int)) for r in sample for a, b in zip(r["left"], r["right"])]
    weights, bias = fit_weights(
        np.array([r["label"] for r in sample], float), [np.array(r["features"], int) for r in sample], twins,
        len(place), counterfactual,
    )
    return ToxicityModel({c: float(weights[i]) for c, i in place.items() if weights[i]}, bias)


def score(docs: DataFrame, model: ToxicityModel, text: str = "text", out: str = "score") -> DataFrame:
    """All columns with the probability of class 1; a column named ``out`` is replaced."""
    shared = share(docs.sparkSession, model)
    kept = [f for f in docs.schema.fields if f.name != out]
    schema = T.StructType([*kept, T.StructField(out, T.DoubleType())])

    def scored(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        weights, bias = shared_value(shared)
        codes = FeatureCodes(weights)
        for batch in batches:
            odds = [bias + sum(weights[c] for c in sorted(codes.of(t))) if t else bias for t in batch[text]]
            yield batch.assign(**{out: 1 / (1 + np.exp(-np.clip(np.array(odds, float), -500, 500)))})

    return docs.select(*[F.col(f"`{f.name}`") for f in kept]).mapInPandas(scored, schema)
