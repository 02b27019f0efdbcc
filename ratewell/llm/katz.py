"""Katz backoff language model of bigrams with Good-Turing discounts.

P(w | h) = d(c) * c / c(h) for bigrams seen in training, else alpha(h) * P(w); P(w) = d(c) * c / N
for known words, and what the discounts leave over is the probability of the one unknown word.
alpha(h) = (1 - sum of seen P(w | h)) / (1 - sum of their P(w)), so every context sums to 1 over
all known words, the end and the unknown word. Discounts are Good-Turing ratios for counts up to 5
and those of a line through the log counts of counts beyond, always below 1, so something is left over.

Tokens are lower-cased words and one end; a word is known by its 64-bit code. Distinct (word,
context, document) entries of a block of documents travel once, as arrays, to the partition of the
word, where unigrams and bigrams are counted and looked up, a range of words at a time, so that a task holds its partition
in narrow types only; words that make up much of all text are spread by context as well. The sum of log10 c(h) over a text needs no context table, because every word but the end is
a context once; only unseen bigrams of known contexts meet the table of backoff weights.

A null text is the end alone. A null id trains. Repeated rows are documents of their own.
An empty table gives an empty result; without training documents every token is unknown, with
probability 1. Extra columns of the input are left out. The rows of ``docs`` must come in the same
order if a task is repeated, as those of a stored table do.
"""

from __future__ import annotations

import contextlib
import math
import pickle
from collections import Counter
from collections.abc import Iterable, Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ratewell.llm.common import giving_back, mixed, rows_in_pieces, share, shared_value, text_codes, words_of
from ratewell.scale import settle

END = np.uint64(xxhash.xxh3_64_intdigest(b""))
START = np.uint64(xxhash.xxh3_64_intdigest(b" "))
BLOCK_DOCS = 4000
BLOCK_TOKENS = 1_000_000
PARTITION_TOKENS = 2_000_000
#: Entries of a partition that are sorted and counted at a time, and more only where one word has more. Any number gives the same scores.
SLICE_ENTRIES = 500_000
#: Hashes of words have so many bits; equal ranges of them are the partitions.
PLACE_BITS = 31
#: Length of the list of common words, which travel as 16-bit places in it. Any list gives the same scores.
COMMON_WORDS = 65_535
#: Words a task counts for the list before it forgets those seen once; it looks after so many documents.
COUNTED_WORDS = 250_000
COUNTED_DOCS = 1000
#: A word above this share of all tokens, or of half a partition's tokens, is spread by context.
HOT_SHARE = 1 / 512
#: Bytes of an Arrow batch, where the session sets none. A task then holds a few rows of whole texts or blocks, not all of its own.
ARROW_BYTES, BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch", 4 << 20
TURING = 5


class Discount(NamedTuple):
    """Share of a count that the model keeps: by table for small counts, (1 + 1/c) ** slope for others."""

    small: tuple[float, ...]
    slope: float

    def kept(self, count: np.ndarray) -> np.ndarray:
        """d(c) * c for counts above 0."""
        smooth = (1 + 1 / np.maximum(count, 1)) ** self.slope
        table = np.array([1.0, *self.small])
        return count * np.where(count < len(table), table[np.minimum(count, len(table) - 1)], smooth)


def good_turing(counts: np.ndarray, types: np.ndarray) -> Discount:
    """Discounts from counts of counts: ``types[i]`` kinds were seen ``counts[i]`` times, in ascending order."""
    slope = -0.5
    if len(counts) >= 2:
        before = np.append(0, counts[:-1])
        after = np.append(counts[1:], 2 * counts[-1] - before[-1])
        spread = types / (0.5 * (after - before))
        slope = min(float(np.polyfit(np.log(counts), np.log(spread), 1)[0]) + 1, -0.05)
    seen = dict(zip(counts.tolist(), types.tolist()))
    small = []
    for c in range(1, TURING + 1):
        ratio = (c + 1) * seen.get(c + 1, 0) / (c * seen[c]) if c in seen else 0
        small.append(ratio if 0 < ratio < 1 else (1 + 1 / c) ** slope)
    return Discount(tuple(small), slope)


class Statistics(NamedTuple):
    """What all partitions must know: sizes, discounts, the unknown word's probability, counts of hot words."""

    tokens: int
    words: int
    documents: int
    unigram: Discount
    bigram: Discount
    unknown: float
    hot: dict[int, int]

    def word_probability(self, count: np.ndarray) -> np.ndarray:
        return np.where(count > 0, self.unigram.kept(count) / max(self.tokens, 1), self.unknown)


class Common(NamedTuple):
    """Codes of common words in ascending order; ``hot`` says which are spread over partitions by context."""

    codes: np.ndarray
    hot: np.ndarray

    def pack(self, codes: np.ndarray) -> tuple[np.ndarray, ...]:
        at = np.minimum(np.searchsorted(self.codes, codes), len(self.codes) - 1)
        listed = self.codes[at] == codes
        return np.packbits(listed), at[listed].astype(np.uint16), codes[~listed]

    def unpack(self, packed: tuple[np.ndarray, ...]) -> np.ndarray:
        bits, at, others = packed
        codes = np.empty(len(at) + len(others), np.uint64)
        listed = np.unpackbits(bits, count=len(codes)).astype(bool)
        codes[listed], codes[~listed] = self.codes[at], others
        return codes


def _codes(texts: Iterable[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """64-bit codes of the words of all texts, A-Z in lower case, and the number of words of each text."""
    return text_codes(t if t is None else t.encode().lower().decode() for t in texts)


def _counts(codes: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct codes and the sums of their numbers."""
    order = np.argsort(codes)
    codes, n = codes[order], n[order]
    first = np.flatnonzero(np.append(True, codes[1:] != codes[:-1])[: len(codes)])
    return codes[first], np.add.reduceat(n, first) if len(first) else n


def _common_words(docs: DataFrame) -> tuple[Common, int]:
    """The most frequent words, and the number of tokens.

    A task reports words that make up at least 1 / (4 * COMMON_WORDS) of its own tokens, which bounds its rows.
    """
    def counted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        word, n, total = np.empty(0, np.uint64), np.empty(0, np.int64), 0
        for batch in rows_in_pieces(batches, COUNTED_DOCS):
            codes, sizes = _codes(batch["_text"])
            total += len(codes) + len(sizes)
            codes, often = np.unique(codes, return_counts=True)
            word, n = _counts(np.append(word, codes), np.append(n, often))
            if len(word) > COUNTED_WORDS:
                word, n = word[n > 1], n[n > 1]
        often = n >= total / (4 * COMMON_WORDS)
        codes = word[often].view(np.int64)
        # As an array of its own kind: beside None a list of whole numbers turns into floats, which round codes.
        yield pd.DataFrame({"word": pd.array([None, *codes.tolist()], "Int64"), "n": np.append(total, n[often])})

    sums = docs.select("_text").mapInPandas(giving_back(counted), "word long, n long").groupBy("word").agg(F.sum("n").alias("n"))
    rows = sums.orderBy(F.col("word").isNotNull(), F.desc("n"), "word").limit(COMMON_WORDS).collect()
    total = rows[0]["n"] if rows else 0
    end = int(END.view(np.int64))
    hot = {r["word"] for r in rows[1:] if r["n"] >= min(total * HOT_SHARE, PARTITION_TOKENS / 2)} | {end}
    codes = np.sort(np.array([end, *[r["word"] for r in rows[1:]]], np.int64).view(np.uint64))
    return Common(codes, np.isin(codes.view(np.int64), list(hot))), total


def _least(values: np.ndarray) -> np.ndarray:
    """The same whole numbers in the narrowest type."""
    return values.astype(np.min_scalar_type(int(values.max()) if len(values) else 0))


def _blocks(docs: DataFrame, common: Common, parts: int) -> DataFrame:
    """(part, block): the entries of a block of documents that belong to a partition, as pickled and packed arrays.

    A block's number is that of its first row, so a row's number, block + place, does not depend on where blocks are cut.
    """
    shared = share(docs.sparkSession, common)

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        common = shared_value(shared)
        number = TaskContext.get().partitionId() << 32
        words, held, tokens = [], [], 0
        for batch in rows_in_pieces(batches, COUNTED_DOCS):
            coded, sizes = _codes(batch["_text"])
            for codes, out in zip(np.split(coded, np.cumsum(sizes)[:-1]), batch["_held"]):
                if words and (len(words) == BLOCK_DOCS or tokens + len(codes) + 1 > BLOCK_TOKENS):
                    yield block(number, words, np.array(held, bool), common)
                    number, words, held, tokens = number + len(held), [], [], 0
                words.append(codes)
                held.append(out)
                tokens += len(codes) + 1
        if words:
            yield block(number, words, np.array(held, bool), common)

    def block(number: int, words: list[np.ndarray], held: np.ndarray, common: Common) -> pd.DataFrame:
        sizes = np.fromiter(map(len, words), np.int64, len(words)) + 1
        word = np.full(int(sizes.sum()), END, np.uint64)
        ends = np.cumsum(sizes) - 1
        inner = np.ones(len(word), bool)
        inner[ends] = False
        word[inner] = np.concatenate(words)
        words.clear()
        distinct, word = np.unique(word, return_inverse=True)
        word = word.astype(np.int32)
        contexts = np.append(distinct, START)
        context = np.append(np.int32(len(distinct)), word[:-1])
        context[ends - sizes + 1] = len(distinct)
        doc = np.repeat(np.arange(len(sizes), dtype=np.int32), sizes)
        spread = np.isin(distinct, common.codes[common.hot])[word]
        place = mixed(distinct)[word]
        place[spread] = mixed(place[spread] ^ contexts[context[spread]])
        place >>= np.uint64(64 - PLACE_BITS)
        # By partition and word, context, document, as far as 64 bits hold them; what they do not hold may be an entry of its own twice.
        key = place << np.uint64(21) | (context & 0x1FFFFF).astype(np.uint64)
        order = np.argsort(key << np.uint64(12) | doc.astype(np.uint64))
        del key
        # One after the other, so that one array at a time is held twice.
        word = word[order]
        context = context[order]
        doc = doc[order]
        place = place[order]
        del order
        new = np.append(True, (word[1:] != word[:-1]) | (context[1:] != context[:-1]) | (doc[1:] != doc[:-1]))
        at = np.flatnonzero(new)
        n = np.diff(np.append(at, len(word)).astype(np.int32))
        word = word[at]
        context = context[at]
        doc = doc[at]
        place = place[at]
        del at
        bounds = np.searchsorted(place, _part_starts(parts))
        found, packed = [], zstandard.ZstdCompressor(level=1)
        for p, (first, last) in enumerate(zip(bounds, [*bounds[1:], len(place)])):
            if first < last:
                starts = np.flatnonzero(np.append(True, word[first + 1 : last] != word[first : last - 1]))
                used, which = np.unique(context[first:last], return_inverse=True)
                arrays = (
                    number, common.pack(distinct[word[first:last][starts]]), _least(np.diff(np.append(starts, last - first))),
                    common.pack(contexts[used]), _least(which), _least(doc[first:last]), held, _least(n[first:last]),
                )
                found.append((p, packed.compress(pickle.dumps(arrays, protocol=5))))
        return pd.DataFrame(found, columns=["part", "block"])

    return docs.select("_text", "_held").mapInPandas(giving_back(cut), "part int, block binary")


def _part_starts(parts: int) -> np.ndarray:
    """First hash of each partition: equal ranges."""
    return np.array([(p << PLACE_BITS) // parts for p in range(parts)], np.uint64)


def _documents(docs: DataFrame) -> DataFrame:
    """(row, doc_id, held_out, n_tokens), rows numbered as in the blocks."""
    def listed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        number = TaskContext.get().partitionId() << 32
        for batch in rows_in_pieces(batches, BLOCK_DOCS):
            yield pd.DataFrame({
                "row": number + np.arange(len(batch)), "doc_id": batch["doc_id"].astype("Int64").array,
                "held_out": batch["_held"].to_numpy(bool), "n_tokens": [len(words_of(t)) + 1 for t in batch["_text"]],
            })
            number += len(batch)

    return docs.select("doc_id", "_text", "_held").mapInPandas(giving_back(listed), "row long, doc_id long, held_out boolean, n_tokens long")


def _distinct(codes: list[np.ndarray]) -> np.ndarray:
    """The codes of all arrays in ascending order, sorted in place."""
    joined = np.concatenate([np.empty(0, np.uint64), *codes])
    joined.sort()
    return joined[np.append(True, joined[1:] != joined[:-1])[: len(joined)]]


class Partition:
    """All entries of one partition, block by block; ``ends`` says where each block's entries end."""

    def __init__(self, batches: Iterator[pd.DataFrame], common: Common) -> None:
        unpacked = zstandard.ZstdDecompressor()
        loaded = [pickle.loads(unpacked.decompress(b)) for batch in batches for b in batch["block"]]
        self.words, self.contexts = (_distinct([common.unpack(b[at]) for b in loaded]) for at in (1, 3))
        self.blocks = np.array([b[0] for b in loaded], np.int64)
        self.ends = np.cumsum([len(b[4]) for b in loaded], dtype=np.int64)
        self.size = int(self.ends[-1]) if loaded else 0
        self.word, self.context, self.place, self.n = (np.empty(self.size, np.int32) for _ in range(4))
        self.held = np.empty(self.size, bool)
        for i, first, last in zip(range(len(loaded)), [0, *self.ends], self.ends):
            (_, words, runs, contexts, which, place, held, n), loaded[i] = loaded[i], None
            self.word[first:last] = np.repeat(np.searchsorted(self.words, common.unpack(words)).astype(np.int32), runs)
            self.context[first:last] = np.searchsorted(self.contexts, common.unpack(contexts))[which]
            self.place[first:last], self.held[first:last], self.n[first:last] = place, held[place], n

    def slices(self) -> Iterator[Entries]:
        """The entries of one range of words after the other."""
        before = np.cumsum(np.append(0, np.bincount(self.word, minlength=len(self.words))))[:-1]
        number = (before // SLICE_ENTRIES).astype(np.int32)
        starts = np.flatnonzero(np.append(True, number[1:] != number[:-1])[: len(number)])
        for first, last in zip(starts, [*starts[1:], len(number)]):
            yield Entries(self, first, last)


class Entries:
    """The entries of words ``first`` to ``last`` of a partition, with training counts of words and bigrams.

    ``at`` is their place in the partition, ``first`` one entry of each bigram.
    """

    def __init__(self, whole: Partition, first: int, last: int) -> None:
        self.at = np.flatnonzero((whole.word >= first) & (whole.word < last))
        self.words, self.word, self.context = whole.words[first:last], whole.word[self.at] - np.int32(first), whole.context[self.at]
        train = np.where(whole.held[self.at], 0, whole.n[self.at])
        self.word_count = np.bincount(self.word, train, len(self.words)).astype(np.int64)
        key = self.word * np.int64(max(len(whole.contexts), 1)) + self.context
        order = np.argsort(key)
        key = key[order]
        new = np.append(True, key[1:] != key[:-1])[: len(key)]
        self.first = order[new]
        self.pair = np.empty(len(key), np.int32)
        self.pair[order] = np.cumsum(new, dtype=np.int32) - 1
        self.pair_count = np.bincount(self.pair, train, len(self.first)).astype(np.int64)

    def know(self, hot: dict[int, int]) -> None:
        """Put in the whole counts of words that are spread over partitions."""
        for code, count in hot.items():
            at = np.searchsorted(self.words, np.uint64(code))
            if at < len(self.words) and self.words[at] == code:
                self.word_count[at] = count


def _statistics(parts: DataFrame, common: Common) -> Statistics:
    """Counts of counts, summed on the driver: one row per distinct count and partition, and one per hot word."""
    shared = share(parts.sparkSession, common)

    def counted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        common = shared_value(shared)
        for entries in Partition(batches, common).slices():
            is_hot = np.isin(entries.words, common.codes[common.hot])
            rows = [
                ("hot", int(w.view(np.int64)), int(c)) for w, c in zip(entries.words[is_hot], entries.word_count[is_hot])
            ]
            for kind, counts in (("word", entries.word_count[~is_hot]), ("pair", entries.pair_count)):
                value, types = np.unique(counts[counts > 0], return_counts=True)
                rows += [(kind, int(v), int(t)) for v, t in zip(value, types)]
            yield pd.DataFrame(rows, columns=["kind", "value", "n"])

    rows = parts.mapInPandas(giving_back(counted), "kind string, value long, n long").groupBy("kind", "value").agg(F.sum("n").alias("n")).collect()
    hot_counts = {int(np.int64(r["value"]).view(np.uint64)): r["n"] for r in rows if r["kind"] == "hot"}
    words = Counter({r["value"]: r["n"] for r in rows if r["kind"] == "word"})
    words.update(c for c in hot_counts.values() if c)
    pairs = {r["value"]: r["n"] for r in rows if r["kind"] == "pair"}
    arrays = lambda found: (np.array(sorted(found), np.int64), np.array([found[c] for c in sorted(found)], np.int64))
    count, types = arrays(words)
    unigram, tokens = good_turing(count, types), int((count * types).sum())
    unknown = 1 - float((unigram.kept(count) * types).sum()) / tokens if tokens else 1.0
    return Statistics(
        tokens, int(types.sum()), hot_counts.get(int(END), 0), unigram, good_turing(*arrays(pairs)), unknown, hot_counts
    )


def context_weights(parts: DataFrame, common: Common, statistics: Statistics) -> DataFrame:
    """(context, weight): log10 of alpha(h) * c(h) for every training context."""
    shared = share(parts.sparkSession, (common, statistics))

    def summed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        common, known = shared_value(shared)
        whole = Partition(batches, common)
        sums = np.zeros((3, len(whole.contexts)))
        for entries in whole.slices():
            entries.know(known.hot)
            seen = entries.pair_count > 0
            first, count = entries.first[seen], entries.pair_count[seen]
            context = entries.context[first]
            probability = known.word_probability(entries.word_count)[entries.word[first]]
            for total, weight in zip(sums, (count, known.bigram.kept(count), probability)):
                total += np.bincount(context, weight, len(total))
        trained = sums[0] > 0
        yield pd.DataFrame({
            "context": whole.contexts[trained].view(np.int64), "n": sums[0][trained].astype(np.int64),
            "kept": sums[1][trained], "backoff": sums[2][trained],
        })

    sums = parts.mapInPandas(giving_back(summed), "context long, n long, kept double, backoff double").groupBy("context").agg(
        *[F.sum(c).alias(c) for c in ("n", "kept", "backoff")]
    )
    # alpha(h) * c(h) = (c(h) - kept) / (1 - backoff)
    return sums.select("context", F.log10((F.col("n") - F.col("kept")) / (1 - F.col("backoff"))).alias("weight"))


def _document_sums(parts: DataFrame, common: Common, statistics: Statistics) -> DataFrame:
    """Per block and partition the sums of its documents' entries, as arrays: place, known, base, score."""
    shared = share(parts.sparkSession, (common, statistics))

    def summed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        common, known = shared_value(shared)
        whole = Partition(batches, common)
        known_word, base, score = np.empty(whole.size, bool), np.empty(whole.size), np.empty(whole.size)
        for entries in whole.slices():
            entries.know(known.hot)
            count, pair = entries.word_count, entries.pair_count
            follows = np.where((count > 0) & (entries.words != END), np.log10(np.maximum(count, 1)), 0.0)
            unseen = np.log10(known.word_probability(count))
            seen = np.log10(known.bigram.kept(np.maximum(pair, 1)))
            known_word[entries.at] = (count > 0)[entries.word]
            base[entries.at] = np.log10((count + 1) / (known.tokens + known.words + 1))[entries.word]
            score[entries.at] = np.where(pair > 0, seen, unseen[entries.word[entries.first]])[entries.pair] - follows[entries.word]
        rows = []
        for number, first, last in zip(whole.blocks.tolist(), [0, *whole.ends], whole.ends):
            place, n = whole.place[first:last], whole.n[first:last]
            add = lambda weight: np.bincount(place, weight[first:last] * n)  # noqa: E731,B023
            there = np.flatnonzero(np.bincount(place))
            arrays = (_least(there), _least(add(known_word)[there].astype(np.int64)), add(base)[there], add(score)[there])
            rows.append((number, pickle.dumps(arrays, protocol=5)))
        yield pd.DataFrame(rows, columns=["block", "sums"])

    pieces = parts.mapInPandas(giving_back(summed), "block long, sums binary")

    def joined(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[int, list] = {}
        for batch in batches:
            for block, sums in zip(batch["block"], batch["sums"]):
                place, known, base, score = pickle.loads(sums)
                total = held.setdefault(block, [np.zeros(0), np.zeros(0), np.zeros(0)])
                size = int(place.max()) + 1
                for i, part in enumerate((known, base, score)):
                    if len(total[i]) < size:
                        total[i] = np.append(total[i], np.zeros(size - len(total[i])))
                    total[i][place] += part
        for block, (known, base, score) in held.items():
            yield pd.DataFrame({
                "block": block, "place": np.arange(len(known)), "n_known": known.astype(np.int64), "base_score": base, "score": score,
            })

    return pieces.repartition("block").mapInPandas(giving_back(joined), "block long, place int, n_known long, base_score double, score double")


def _unseen(parts: DataFrame, common: Common) -> DataFrame:
    """(block, place, context, n): how often a document has an unseen bigram of a context."""
    shared = share(parts.sparkSession, common)

    def listed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        whole = Partition(batches, shared_value(shared))
        at = [entries.at[entries.pair_count[entries.pair] == 0] for entries in whole.slices()]
        at = np.concatenate([np.empty(0, np.int64), *at])
        block = np.searchsorted(whole.ends, at, "right")
        order = np.lexsort((whole.place[at], block, whole.context[at]))
        at, block = at[order], block[order]
        context, place, n = whole.context[at], whole.place[at], whole.n[at]
        new = np.append(True, (context[1:] != context[:-1]) | (block[1:] != block[:-1]) | (place[1:] != place[:-1]))[: len(at)]
        first = np.flatnonzero(new)
        yield pd.DataFrame({
            "context": whole.contexts[context[first]].view(np.int64), "block": whole.blocks[block[first]], "place": place[first],
            "n": np.add.reduceat(n, first) if len(first) else n,
        })

    return parts.mapInPandas(giving_back(listed), "context long, block long, place int, n int")


@contextlib.contextmanager
def _small_batches(spark: SparkSession) -> Iterator[None]:
    """Arrow batches of BATCH_BYTES for what is planned inside, unless the session sets a size itself."""
    chosen = spark.conf.get(ARROW_BYTES, None) is not None
    if not chosen:
        spark.conf.set(ARROW_BYTES, str(BATCH_BYTES))
    try:
        yield
    finally:
        if not chosen:
            spark.conf.unset(ARROW_BYTES)


def score_documents(docs: DataFrame, held_out: Column, text: str = "text") -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score (add-one unigrams) and score (Katz), log10.

    Rows for which ``held_out`` holds do not train. The work is done in the call, and its result settled.
    """
    docs = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.col(text).alias("_text"), F.coalesce(held_out, F.lit(False)).alias("_held")
    )
    with _small_batches(docs.sparkSession):
        return settle(_scored(docs))


def _scored(docs: DataFrame) -> DataFrame:
    spark = docs.sparkSession
    common, tokens = _common_words(docs)
    n_parts = max(4, math.ceil(tokens / PARTITION_TOKENS))
    # Taken as an RDD, because the files of its shuffle then serve the four passes below; a DataFrame's exchange would be written again.
    dealt = _blocks(docs, common, n_parts).repartitionById(n_parts, "part").rdd
    parts = spark.createDataFrame(dealt, "part int, block binary")
    statistics = _statistics(parts, common)
    weights = settle(context_weights(parts, common, statistics))
    row = (F.col("block") + F.col("place")).alias("row")
    backoff = (
        _unseen(parts, common).join(weights, "context")
        .groupBy(row).agg(F.sum(F.col("n") * F.col("weight")).alias("backoff"))
    )
    sums = _document_sums(parts, common, statistics).select(row, "n_known", "base_score", "score")
    start = -math.log10(statistics.documents) if statistics.documents else 0.0
    return (
        _documents(docs).join(sums, "row").join(backoff, "row", "left")
        .select(
            "doc_id", "held_out", "n_tokens", "n_known", F.lit(statistics.tokens).cast("long").alias("train_tokens"), "base_score",
            (F.col("score") + F.coalesce("backoff", F.lit(0.0)) + start).alias("score"),
        )
    )
