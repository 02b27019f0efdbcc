"""Token counts of whole texts; huge texts in overlapping chunks that are spliced where both sides agree.

A text of up to ``chunk`` characters is counted at once, as the sum over its words: no token holds white space. A longer one is cut into chunks that overlap;
chunks go to tasks of their own, so one huge text is not the work of one task. Each chunk is encoded with
offsets and lists, inside its overlaps, the stable boundaries: places where one token ends and the next begins
and where the tokenizer's splitting cannot look across (``STABLE``), so that what lies left and right
is encoded as in the whole text. What lies between its overlaps, from white space to white space, is counted as the sum over
its words. Two neighbours are spliced at a boundary that both list: tokens of the left
one count up to it, tokens of the right one from it. Where a seam has no common boundary (a
word longer than the overlap), its text is done again with chunks and overlaps ``WIDEN`` times as large, until it
fits or is one chunk; so the count is always that of the whole text.

Equal long texts are known by their SHA-256 and encoded once. A null text counts as empty and has no tokens.
Null ids, repeated ids and repeated rows are rows like others; an empty table gives an empty one; columns that are not
asked for are left out, so their names cannot clash.
"""

from __future__ import annotations

import os
import string
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ratewell.llm.common import share, shared_value
from ratewell.scale import join_dimension, settle

CHUNK = 16_384
OVERLAP = 256
WIDEN = 4
BATCH_ROWS = 256
#: Stable boundaries listed per overlap, those nearest to its middle.
LISTED = 24
#: Words kept with their counts in a worker before the older ones go, and the longest of them.
KNOWN_WORDS, KNOWN_CHARS = 200_000, 64
#: Marks that begin a pre-token behind a letter below ``LATIN``; others may get a combining mark in lower case, which joins the marks.
MARKS, LATIN = ".,;:!?", "\u0100"
# str.split() takes these four for white space, the tokenizer does not.
SEPARATORS = regex.compile("[\x1c-\x1f]")
OTHER_SPACE = regex.compile(r"\p{White_Space}+")
LAST_SPACE = regex.compile(r"(?r)\p{White_Space}")
# No pre-token and no special token of the word-end tokenizer has white space, a digit beside anything else, or one of these
# marks behind a letter; a combining mark may join what stands before it, so none may follow.
STABLE = (
    r"(?:(?<=\p{White_Space})|(?=\p{White_Space})|(?<=[0-9])|(?=[0-9])|(?<=\p{L})(?=[.,;:!?、。，！？；：]))(?!\p{M})"
)


class TokenCounter:
    """The tokenizer in a worker: no truncation, no padding, no added tokens."""

    def __init__(self, vocabulary: str, stable: str = STABLE, by_word: bool = True):
        self.vocabulary, self.stable, self.by_word = vocabulary, stable, by_word
        self._tokenizer = self._stable = None
        self._lowers = False
        self._known: dict[str, int] = {}
        self._older: dict[str, int] = {}

    def __getstate__(self) -> dict:
        return {**self.__dict__, "_tokenizer": None, "_stable": None, "_known": {}, "_older": {}}

    def tokenizer(self):
        if self._tokenizer is None:
            # Spark runs one task per core already.
            os.environ["TOKENIZERS_PARALLELISM"] = "false"
            from tokenizers import Tokenizer

            self._tokenizer = Tokenizer.from_str(self.vocabulary)
            self._tokenizer.no_truncation()
            self._tokenizer.no_padding()
            self._stable = regex.compile(self.stable)
            normal = self._tokenizer.normalizer
            self._lowers = normal is not None and normal.normalize_str(string.ascii_letters) == string.ascii_letters.lower()
        return self._tokenizer

    def _encoded(self, texts: list[str]) -> list[int]:
        return [len(e) for e in self.tokenizer().encode_batch_fast(texts, add_special_tokens=False)]

    def counts(self, texts: list[str]) -> list[int]:
        """Token counts of short texts; where white space belongs to no token, the sum over their words, each encoded once."""
        if not self.by_word:
            return self._encoded(texts)
        split = [self._words(t) for t in texts]
        long = self._learn(set().union(*split))
        totals = [sum(map(self._known.__getitem__, words)) for words in split]
        for word in long:
            del self._known[word]
        return totals

    @staticmethod
    def _words(text: str) -> list[str]:
        return OTHER_SPACE.split(text) if SEPARATORS.search(text) else text.split()

    def _learn(self, words: set[str]) -> list[str]:
        """Put the counts of all words into the cache; gives those too long to stay.

        Beyond the bound of the cache, words not asked for since the last turn go.
        """
        self.tokenizer()
        if len(self._known) > KNOWN_WORDS:
            self._known, self._older = {}, self._known
        known, older = self._known, self._older
        missing = words.difference(known)
        again = [w for w in missing if w in older]
        known.update((w, older[w]) for w in again)
        missing.difference_update(again)
        # Marks behind the last letter are counted on their own, and words of letters A-Z in lower case where the tokenizer lowers them.
        stems = {w: s for w in missing if w[-1:] in MARKS and (s := w.rstrip(MARKS)) and s[-1] < LATIN and s[-1].isalpha()}
        missing.difference_update(stems)
        missing.update(s for s in stems.values() if s not in known)
        lower = {w: w.lower() for w in missing if w.isascii() and w.isalpha() and not w.islower()} if self._lowers else {}
        missing.difference_update(lower)
        missing.update(w for w in lower.values() if w not in known)
        missing.update(w[len(s):] for w, s in stems.items() if w[len(s):] not in known)
        new = list(missing)
        known.update(zip(new, self._encoded(new)))
        known.update((w, known[low]) for w, low in lower.items())
        known.update((w, known[s] + known[w[len(s):]]) for w, s in stems.items())
        return [w for words in (missing, lower, stems) for w in words if len(w) > KNOWN_CHARS]

    def chunk(self, text: str, start: int, left: int, right: int) -> tuple[int, list, list, list, list]:
        """Token count of a chunk, and per overlap the stable boundaries: places in the whole text, tokens before them.

        ``left`` and ``right`` are the lengths of the overlaps, 0 at the ends of the text.
        """
        inner = self._inner(text, left, right) if self.by_word else None
        if inner is None:
            spans, n = self._spans(text), len(text)
            return len(spans), *self._listed(text, spans, 0, left, start, 0), *self._listed(text, spans, n - right, n, start, 0)
        head, tail = text[:inner[0]], text[inner[1]:]
        first, last, n = self._spans(head), self._spans(tail), len(tail)
        before = len(first) + self.counts([text[inner[0]:inner[1]]])[0]
        return (before + len(last), *self._listed(head, first, 0, left, start, 0),
                *self._listed(tail, last, n - right, n, start + inner[1], before))

    @staticmethod
    def _inner(text: str, left: int, right: int) -> tuple[int, int] | None:
        """Start and end of what lies between the overlaps, each at white space or an end of the text; None without such a place."""
        head, tail = 0, len(text)
        if left:
            space = OTHER_SPACE.search(text, left + 1)
            if space is None:
                return None
            head = space.start()
        if right:
            space = LAST_SPACE.search(text, head, len(text) - right)
            if space is None:
                return None
            tail = space.start()
        return head, tail

    def _spans(self, part: str) -> np.ndarray:
        """Start and end of each token."""
        return np.array(self.tokenizer().encode(part, add_special_tokens=False).offsets, np.int64).reshape(-1, 2)

    def _listed(self, part: str, spans: np.ndarray, low: int, high: int, start: int, counted: int) -> tuple[list, list]:
        """Stable boundaries from ``low`` to ``high`` of a part that begins at ``start`` of the text, with ``counted`` tokens before it."""
        if low == high:
            return [], []
        at = np.array([m.start() for m in self._stable.finditer(part, max(low - 1, 0), min(high + 1, len(part)))], np.int64)
        at = at[(at >= low) & (at <= high)]
        before = np.searchsorted(spans[:, 1], at, "right")
        clean = before == np.searchsorted(spans[:, 0], at, "left")
        at, before = at[clean], before[clean]
        near = np.sort(np.argsort(np.abs(at - (low + high) // 2), kind="stable")[:LISTED])
        return (at[near] + start).tolist(), (before[near] + counted).tolist()


def chunks_of(n: int, chunk: int, overlap: int) -> list[tuple[int, int]]:
    """Start and end of the chunks of ``n`` characters; neighbours share ``overlap`` of them."""
    if n <= chunk:
        return [(0, n)]
    step = chunk - overlap
    return [(start, min(start + chunk, n)) for start in range(0, n - overlap, step)]


def _cut(chunk: int, overlap: int):
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for digest, text in zip(batch.column("digest"), batch.column("text")):
                text = text.as_py()
                for no, (start, end) in enumerate(chunks_of(len(text), chunk, overlap)):
                    yield pa.RecordBatch.from_pydict({
                        "digest": [digest.as_py()], "no": pa.array([no], pa.int64()), "start": pa.array([start], pa.int64()),
                        "is_last": [end == len(text)], "piece": [text[start:end]]})
    return cut


CUT = "digest string, no long, start long, is_last boolean, piece string"
ENCODED = "digest string, no long, is_last boolean, n long, left_at array<long>, left_n array<long>, right_at array<long>, right_n array<long>"


def _encode(shared, overlap: int):
    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = shared_value(shared)
        for batch in batches:
            rows = [
                counter.chunk(piece.as_py(), start.as_py(), overlap if no.as_py() else 0, 0 if last.as_py() else overlap)
                for no, start, last, piece in zip(*(batch.column(c) for c in ("no", "start", "is_last", "piece")))]
            many = pa.list_(pa.int64())
            n, *lists = zip(*rows) if rows else [()] * 5
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in ("digest", "no", "is_last")), pa.array(n, pa.int64()), *(pa.array(v, many) for v in lists)],
                names=["digest", "no", "is_last", "n", "left_at", "left_n", "right_at", "right_n"])
    return encode


def _spliced(texts: DataFrame, shared, chunk: int, overlap: int) -> DataFrame:
    """digest, n_tokens of long texts; NULL where a seam has no common boundary."""
    pieces = texts.mapInArrow(_cut(chunk, overlap), CUT).dropDuplicates(["digest", "no"])
    encoded = pieces.mapInArrow(_encode(shared, overlap), ENCODED)
    by = Window.partitionBy("digest").orderBy("no")
    seams = encoded.withColumns({
        "_at": F.try_element_at(F.array_intersect("right_at", F.lead("left_at").over(by)), F.lit(1)),
        "_next_at": F.lead("left_at").over(by), "_next_n": F.lead("left_n").over(by)})

    def tokens_before(places: str, counts: str):
        return F.try_element_at(F.col(counts), F.array_position(places, F.col("_at")).cast("int"))

    twice = F.when(F.col("is_last"), F.lit(0)).when(
        F.col("_at").isNotNull(), F.col("n") - tokens_before("right_at", "right_n") + tokens_before("_next_at", "_next_n"))
    counted = seams.select("digest", "n", twice.alias("_twice"))
    return counted.groupBy("digest").agg(
        F.when(F.count("_twice") == F.count(F.lit(1)), F.sum("n") - F.sum("_twice")).alias("n_tokens"))


def _of_short(shared):
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = shared_value(shared)
        for batch in batches:
            for at in range(0, batch.num_rows, BATCH_ROWS):
                part = batch.slice(at, BATCH_ROWS)
                counts = counter.counts(part.column("_text").to_pylist())
                columns = [part.column(i) for i, f in enumerate(part.schema) if f.name != "_text"]
                names = [f.name for f in part.schema if f.name != "_text"]
                yield pa.RecordBatch.from_arrays([*columns, pa.array(counts, pa.int64())], names=[*names, "n_tokens"])
    return count


def long_counts(texts: DataFrame, shared, chunk: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """Token counts of long texts (digest, text); equal digests are equal texts and come once."""
    done = texts.sparkSession.createDataFrame([], "digest string, n_tokens long")
    while True:
        counted = settle(_spliced(texts, shared, chunk, overlap))
        done = done.unionByName(counted.where(F.col("n_tokens").isNotNull()))
        failed = counted.where(F.col("n_tokens").isNull()).select("digest")
        if failed.isEmpty():
            return done
        # A chunk that holds a whole text has no seam, so this ends.
        chunk, overlap = chunk * WIDEN, overlap * WIDEN
        texts = join_dimension(texts, failed, ["digest"], "left_semi", settled=True)


def count_tokens(
    docs: DataFrame, vocabulary: str, keep: list[str], text: str = "text", chunk: int = CHUNK, overlap: int = OVERLAP,
    stable: str = STABLE, by_word: bool = True,
) -> DataFrame:
    """Columns ``keep`` and the ``n_tokens`` of each row's text; ``vocabulary`` is the tokenizer's JSON.

    ``stable`` and ``by_word`` (white space belongs to no token, and ``MARKS`` behind a letter begin a pre-token) state what holds
    for the tokenizer.
    """
    if chunk < 2 * overlap:
        raise ValueError("the two overlaps of a chunk must not meet")
    shared = share(docs.sparkSession, TokenCounter(vocabulary, stable, by_word))
    rows = docs.select(*keep, F.coalesce(F.col(text), F.lit("")).alias("_text"))
    is_long = F.length("_text") > chunk
    short = rows.where(~is_long)
    kept = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema if f.name != "_text")
    counted = short.mapInArrow(_of_short(shared), f"{kept}, n_tokens long")
    long = rows.where(is_long).withColumn("_digest", F.sha2("_text", 256))
    found = long_counts(long.select(F.col("_digest").alias("digest"), F.col("_text").alias("text")), shared, chunk, overlap)
    keyed = join_dimension(long.drop("_text"), found.withColumnRenamed("digest", "_digest"), ["_digest"])
    return counted.unionByName(keyed.select(*keep, "n_tokens"))
