"""Quality rules under weak supervision: rules vote or abstain, EM weighs them.

Each rule votes good (1), bad (-1) or abstains (0). Expectation-maximisation over the
counts of vote patterns (at most 3 to the number of rules) estimates, per rule and class,
how often each vote falls; the posterior of the good class replaces all-must-pass.

A null text has no words and no lines, and all rules abstain; repeated rows are documents of
their own; an empty table gives an empty result. Extra columns stay; those named like an added
one are replaced.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ratewell.scale import settle

SYMBOLS = re.compile(r"[#*$%&|<>]")
BLANKS = re.compile(r"[\x20\x09-\x0D]")
WORDS = re.compile(r"[^\x20\x09-\x0D]+")
STATISTICS = (
    "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
    "n_lines", "n_upper_words", "n_ends", "n_distinct", "n_marks", "n_letterless", "n_adjacent",
)


def repeated_words(words: list[str], size: int = 3) -> int:
    """Words in windows of ``size`` words that occur twice or more, the first occurrence included."""
    windows = list(zip(*(words[i:] for i in range(size))))
    if len(set(windows)) == len(windows):
        return 0
    counts, covered, reached = Counter(windows), 0, 0
    for i, window in enumerate(windows):
        if counts[window] > 1:
            covered += i + size - max(i, reached)
            reached = i + size
    return covered


def document_statistics(text: str | None) -> tuple[int, ...]:
    """The counts of STATISTICS for one whole text."""
    if text is None:
        return (0,) * len(STATISTICS)
    words = WORDS.findall(text)
    lines = [line for line in text.split("\n") if WORDS.search(line)]
    return (
        len(words), len(text) - len(BLANKS.findall(text)), len(SYMBOLS.findall(text)), len(lines) - len(set(lines)),
        repeated_words(words), len(lines), sum(map(str.isupper, words)),
        sum(w[-1] in ".!?" for w in words), len(set(words)), text.count("!"),
        sum(not any(map(str.isalpha, w)) for w in words), sum(map(str.__eq__, words, words[1:])),
    )


def with_statistics(docs: DataFrame, text: str = "text") -> DataFrame:
    """All columns but the text, with the statistics of each whole text."""
    kept = [f for f in docs.schema.fields if f.name != text and f.name not in STATISTICS]
    source = docs.select(*[F.col(f"`{f.name}`") for f in kept], F.col(text).alias("_text"))
    schema = T.StructType([*kept, *[T.StructField(name, T.LongType()) for name in STATISTICS]])

    def measured(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = np.array([document_statistics(t) for t in batch.pop("_text")], np.int64).reshape(-1, len(STATISTICS))
            for i, name in enumerate(STATISTICS):
                batch[name] = found[:, i]
            yield batch

    return source.mapInPandas(measured, schema)


def _vote(share: Column, good: Column, bad: Column) -> Column:
    return F.when(share.isNull(), 0).when(good, 1).when(bad, -1).otherwise(0).cast("int")


def default_votes() -> dict[str, Column]:
    """Votes over the statistics; a share without a base abstains."""
    def share(part: str, base: str = "n_words") -> Column:
        return F.when(F.col(base) > 0, F.col(part) / F.col(base))

    symbols, dense, letterless = share("n_symbols"), share("n_symbols", "word_chars"), share("n_letterless")
    upper, marks, ends = share("n_upper_words"), share("n_marks"), share("n_ends")
    repeats, adjacent, distinct = share("n_repeat_words"), share("n_adjacent"), share("n_distinct")
    lines = share("n_dup_lines", "n_lines")
    return {
        "vote_symbols": _vote(symbols, symbols <= 0.02, symbols >= 0.1),
        "vote_dense_symbols": _vote(dense, dense <= 0.005, dense >= 0.03),
        "vote_letterless": _vote(letterless, letterless <= 0.03, letterless >= 0.15),
        "vote_upper": _vote(upper, upper <= 0.1, upper >= 0.4),
        "vote_marks": _vote(marks, marks <= 0.02, marks >= 0.3),
        "vote_ends": _vote(ends, ends.between(0.02, 0.4), (ends < 0.005) | (ends > 0.6)),
        "vote_repeats": _vote(repeats, repeats <= 0.05, repeats >= 0.3),
        "vote_adjacent": _vote(adjacent, adjacent <= 0.02, adjacent >= 0.2),
        "vote_distinct": _vote(distinct, distinct >= 0.35, distinct < 0.15),
        "vote_lines": _vote(lines, (F.col("n_lines") >= 2) & (lines <= 0.05), lines > 0.5),
    }


def fit_votes(patterns: np.ndarray, counts: np.ndarray, rounds: int = 100) -> tuple[float, np.ndarray]:
    """Prior of the good class and P(vote | class) as [rule, class, vote + 1], by expectation-maximisation.

    The start names the classes: bad votes are rare in the good class and common in the
    other. Each vote gets a small count beforehand, so that nothing has probability 0.
    """
    rules = patterns.shape[1] if patterns.ndim == 2 else 0
    seen = np.stack([patterns == v for v in (-1, 0, 1)], axis=2).astype(float) if len(counts) else np.zeros((0, rules, 3))
    prior = 0.8
    tables = np.tile(np.array([[0.02, 0.2, 0.78], [0.4, 0.2, 0.4]]), (rules, 1, 1))
    for _ in range(rounds):
        odds = math.log(prior / (1 - prior)) + np.einsum("prv,rv->p", seen, np.log(tables[:, 0] / tables[:, 1]))
        good = 1 / (1 + np.exp(-np.clip(odds, -500, 500)))
        weights = np.stack([good * counts, (1 - good) * counts])
        prior = float((weights[0].sum() + 8) / (weights.sum() + 10))
        tables = np.einsum("cp,prv->rcv", weights, seen) + 1.0
        tables /= tables.sum(axis=2, keepdims=True)
    return prior, tables


def with_posterior(measured: DataFrame, votes: dict[str, Column] | None = None) -> DataFrame:
    """Votes and ``quality_posterior``, the probability of the good class given all votes.

    The pattern counts are summed in Spark; at most 3 to the number of rules rows reach the driver.
    """
    votes = default_votes() if votes is None else votes
    names = list(votes)
    voted = measured.withColumns(votes)
    rows = voted.groupBy(*names).count().orderBy(*names).collect()
    patterns = np.array([[row[n] for n in names] for row in rows], int).reshape(-1, len(names))
    prior, tables = fit_votes(patterns, np.array([row["count"] for row in rows], float))
    weights = np.log(tables[:, 0] / tables[:, 1])
    parts = [
        F.when(F.col(n) == -1, float(w[0])).when(F.col(n) == 0, float(w[1])).otherwise(float(w[2]))
        for n, w in zip(names, weights)
    ]
    odds = reduce(lambda a, b: a + b, parts, F.lit(math.log(prior / (1 - prior))))
    return voted.withColumn("quality_posterior", 1 / (1 + F.exp(-odds)))


def quality_rules(docs: DataFrame, text: str = "text", min_posterior: float = 0.5) -> DataFrame:
    """Statistics, base rule, posterior and ``kept`` per document, all columns but the text kept.

    The statistics are settled once, since the vote counts and the result both read them.
    """
    added = {"base_failed", "kept", "quality_posterior", *default_votes()}
    measured = settle(with_statistics(docs.select(*[F.col(f"`{c}`") for c in docs.columns if c not in added]), text))
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    return with_posterior(measured).withColumn("base_failed", failed).withColumn(
        "kept", ~F.col("base_failed") & (F.col("quality_posterior") >= min_posterior)
    )
