"""Quality classifier: histogram gradient-boosted trees over document statistics.

Statistics of whole texts are measured in Spark tasks. The trees are grown on
the driver from at most ``train_docs`` labelled rows of statistics (those of the smallest
hashed ids), over histograms of at most ``bins`` bins, and flattened into arrays that a
task walks for all its rows at once.

Null and empty texts have statistics of 0 and a score like any other. Rows without a
label, or with a null id, never train; repeated labels of one id count as the largest. Without
labels of both classes the score is the share of class 1. An empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ratewell.llm.common import CACHE_WORDS, share, shared_value
from ratewell.llm.toxicity import TRAIN_DOCS, training_rows

STATISTICS = (
    "log_words", "word_length", "longest_word", "upper", "digits", "symbols", "bars", "marks", "stops", "beyond_ascii",
    "upper_words", "ends", "letterless", "adjacent", "distinct", "log_lines", "dup_lines", "repeated_pairs",
)
_KIND = np.zeros(256, np.uint8)
for _kind, _bytes in enumerate((range(65, 91), range(48, 58), b"#*$%&<>", b"|", b"!", b".,;:?", range(128, 256)), 1):
    _KIND[list(_bytes)] = _kind


class WordKinds(dict):
    """Whether a word is in capitals (1), ends a sentence (2), has no letter (4); bounded."""

    def __missing__(self, word: str) -> int:
        if len(self) >= CACHE_WORDS:
            self.clear()
        ends = word[-1] in ".!?"
        kind = self[word] = word.isupper() + 2 * ends + 4 * (not any(map(str.isalpha, word)))
        return kind


def statistics(text: str | None, kinds: WordKinds) -> list[float]:
    """The numbers of STATISTICS for one whole text."""
    words = (text or "").split()
    if not words:
        return [0.0] * len(STATISTICS)
    letters = np.frombuffer(text.encode(), np.uint8)
    by_kind = np.bincount(_KIND[letters], minlength=8)
    n = len(words)
    word_kind = np.bincount(np.fromiter(map(kinds.__getitem__, words), np.uint8, n), minlength=8)
    lines = [line for line in text.split("\n") if line.strip()]
    pairs = list(zip(words, words[1:]))
    lengths = np.fromiter(map(len, words), np.int64, n)
    return [
        math.log1p(n), float(lengths.mean()), float(lengths.max()), *(by_kind[1:] / len(letters)).tolist(),
        word_kind[1::2].sum() / n, word_kind[[2, 3, 6, 7]].sum() / n, word_kind[4:].sum() / n,
        sum(map(str.__eq__, words, words[1:])) / n, len(set(words)) / n,
        math.log1p(len(lines)), 1 - len(set(lines)) / len(lines), 1 - len(set(pairs)) / max(1, len(pairs)),
    ]


def measure(texts: pd.Series, kinds: WordKinds) -> np.ndarray:
    return np.array([statistics(t, kinds) for t in texts], float).reshape(-1, len(STATISTICS))


class Trees(NamedTuple):
    """Complete trees in arrays: split feature and threshold by [tree, node], value by [tree, leaf]."""

    feature: np.ndarray
    threshold: np.ndarray
    leaf: np.ndarray
    bias: float

    def log_odds(self, x: np.ndarray) -> np.ndarray:
        """All rows walk all trees together, one level at a time."""
        trees = np.arange(len(self.leaf))
        rows = np.arange(len(x))[:, None]
        node = np.zeros((len(x), len(trees)), np.int64)
        while len(trees) and len(x) and node[0, 0] < self.feature.shape[1]:
            right = x[rows, self.feature[trees, node]] > self.threshold[trees, node]
            node = 2 * node + 1 + right
        return self.bias + self.leaf[trees, node - self.feature.shape[1]].sum(axis=1)


def grow(
    x: np.ndarray, y: np.ndarray, rounds: int = 80, depth: int = 4, rate: float = 0.15, bins: int = 64, smooth: float = 2.0
) -> Trees:
    """Boost complete trees of ``depth`` levels on the log loss; a node without gain sends all rows left."""
    n, features = x.shape
    if n == 0 or y.min() == y.max():
        share = (float(y.sum()) + 0.5) / (n + 1)
        return Trees(np.zeros((0, 2**depth - 1), int), np.zeros((0, 2**depth - 1)), np.zeros((0, 2**depth)), math.log(share / (1 - share)))
    edges = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, bins)[1:-1])) for f in range(features)]
    binned = np.stack([np.searchsorted(e, x[:, f], side="left") for f, e in enumerate(edges)], axis=1)
    width = max(len(e) for e in edges) + 1
    bias = math.log(y.mean() / (1 - y.mean()))
    odds = np.full(n, bias)
    inner = 2**depth - 1
    feature, threshold, leaf = np.zeros((rounds, inner), int), np.full((rounds, inner), np.inf), np.zeros((rounds, inner + 1))
    for t in range(rounds):
        p = 1 / (1 + np.exp(-odds))
        g, h = y - p, p * (1 - p)
        node = np.zeros(n, np.int64)
        for level in range(depth):
            first, size = 2**level - 1, 2**level
            best = np.full(size, 1e-6)
            for f in range(features):
                cell = (node - first) * width + binned[:, f]
                gs = np.bincount(cell, g, minlength=size * width).reshape(size, width).cumsum(axis=1)
                hs = np.bincount(cell, h, minlength=size * width).reshape(size, width).cumsum(axis=1)
                ga, ha = gs[:, -1:], hs[:, -1:]
                gain = gs**2 / (hs + smooth) + (ga - gs) ** 2 / (ha - hs + smooth) - ga**2 / (ha + smooth)
                gain = gain[:, : len(edges[f])]
                if gain.shape[1] == 0:
                    continue
                at = gain.argmax(axis=1)
                better = gain[np.arange(size), at] > best
                best = np.where(better, gain[np.arange(size), at], best)
                feature[t, first : first + size][better] = f
                threshold[t, first : first + size][better] = edges[f][at[better]]
            right = x[np.arange(n), feature[t, node]] > threshold[t, node]
            node = 2 * node + 1 + right
        place = node - inner
        leaf[t] = rate * np.bincount(place, g, minlength=inner + 1) / (np.bincount(place, h, minlength=inner + 1) + smooth)
        odds += leaf[t][place]
    return Trees(feature, threshold, leaf, bias)


def fit(
    docs: DataFrame, labels: DataFrame, train: Column, label: str = "quality", text: str = "text",
    train_docs: int = TRAIN_DOCS,
) -> Trees:
    """Grow trees on the statistics of at most ``train_docs`` labelled documents."""
    rows = training_rows(docs, labels, label, train, text, train_docs)

    def measured(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        kinds = WordKinds()
        for batch in batches:
            yield pd.DataFrame({"label": batch["_label"], "x": list(measure(batch["_text"], kinds))})

    # At most train_docs rows of len(STATISTICS) numbers; sorted, so that the order of tasks does not count.
    sample = sorted(tuple(r) for r in rows.mapInPandas(measured, "label int, x array<double>").collect())
    x = np.array([r[1] for r in sample], float).reshape(-1, len(STATISTICS))
    return grow(x, np.array([r[0] for r in sample], float))


def score(docs: DataFrame, trees: Trees, text: str = "text", out: str = "score") -> DataFrame:
    """All columns with the probability of class 1; a column named ``out`` is replaced."""
    shared = share(docs.sparkSession, trees)
    kept = [f for f in docs.schema.fields if f.name != out]
    schema = T.StructType([*kept, T.StructField(out, T.DoubleType())])

    def scored(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        kinds, trees = WordKinds(), shared_value(shared)
        for batch in batches:
            odds = trees.log_odds(measure(batch[text], kinds))
            yield batch.assign(**{out: 1 / (1 + np.exp(-np.clip(odds, -500, 500)))})

    return docs.select(*[F.col(f"`{f.name}`") for f in kept]).mapInPandas(scored, schema)
