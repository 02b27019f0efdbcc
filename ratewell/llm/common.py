"""Shared pieces: row splits by checksum, words, 64-bit codes of words and word runs."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import uuid
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import Broadcast, cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

CACHE_WORDS = 100_000


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """One of the given tables, read by Spark so that any of its file systems serves."""
    return spark.read.parquet(f"{folder}/{name}.parquet")


def share(spark: SparkSession, value: object) -> Broadcast:
    """Broadcast an object of this package by value; the caller vouches for its size."""
    return spark.sparkContext.broadcast({"name": uuid.uuid4().hex, "pickled": cloudpickle.dumps(value)})


#: The one shared object a worker holds, by the name it was shared under.
_HELD: dict[str, object] = {}


def shared_value(shared: Broadcast):
    """The object in a worker, unpickled once and kept (with its caches) until the worker needs another one.

    Workers outlive stages, so what an earlier stage shared is given back here.
    """
    held = shared.value
    if held["name"] not in _HELD:
        _HELD.clear()
        release_memory()
        _HELD[held["name"]] = cloudpickle.loads(held["pickled"])
    return _HELD[held["name"]]


def release_memory() -> None:
    """Give freed memory of this worker back to the system: workers are reused and the peaks of their tasks would add up."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL(None).malloc_trim(0)


def giving_back(function: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """The same task function; once a task is through, its worker, which may idle for a while, gives its memory back."""
    def run(batches: Iterator) -> Iterator:
        yield from function(batches)
        release_memory()
    return run


def held_out(doc_id: Column, parts: int, part: int) -> Column:
    """Whether crc32 of the id as text leaves ``part`` modulo ``parts``; a null id is never held out."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % parts == part, F.lit(False))


def words_of(text: str | None) -> list[bytes]:
    """Words ``[^\\x20\\x09-\\x0D]+`` in UTF-8; null has none. bytes.split() splits at just these six."""
    return [] if text is None else text.encode().split()


def lower_words(text: str | None) -> list[bytes]:
    """The same with A-Z in lower case; bytes.lower() changes no other letter."""
    return [] if text is None else text.encode().lower().split()


class WordCodes(dict):
    """64-bit code of each word, kept for words seen before up to a bound."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= CACHE_WORDS:
            self.clear()
        code = self[word] = xxhash.xxh3_64_intdigest(word)
        return code

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def mixed(x: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit codes (the finishing steps of a 64-bit hash)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


#: Words up to TABLED bytes are coded from one random number per place and byte; the others one by one. WORDS_AT_ONCE bounds what a step holds.
TABLED, WORDS_AT_ONCE = 64, 20_000
_TABLE = mixed(np.arange(1, TABLED * 256 + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
_IN_WORD = np.array([b not in b" \t\n\v\f\r" for b in range(256)])


def text_codes(texts: Iterable[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """64-bit codes of the words of all texts (those of ``words_of``), and the number of words of each text.

    A code is the sum of the numbers of its bytes, so equal codes of different words are as unlikely as with ``WordCodes``,
    whose codes are others.
    """
    encoded = [b"" if t is None else t.encode() for t in texts]
    data = b"".join([b" ", *(part for text in encoded for part in (text, b" "))])
    letters = np.frombuffer(data, np.uint8)
    inside = _IN_WORD[letters]
    edges = np.flatnonzero(inside[1:] != inside[:-1]) + 1
    starts, ends = edges[::2], edges[1::2]
    borders = np.cumsum([1, *(len(text) + 1 for text in encoded)])
    sizes = np.diff(np.searchsorted(starts, borders))
    long = np.flatnonzero(ends - starts > TABLED)
    for word in long.tolist():
        inside[starts[word] + TABLED : ends[word]] = False
    lengths = np.minimum(ends - starts, TABLED)
    codes = np.empty(len(starts), np.uint64)
    for at in range(0, len(starts), WORDS_AT_ONCE):
        sized = lengths[at : at + WORDS_AT_ONCE]
        span = slice(starts[at], ends[at + len(sized) - 1])
        first = np.cumsum(sized) - sized
        place = np.arange(sized.sum(), dtype=np.int32) - np.repeat(first.astype(np.int32), sized)
        codes[at : at + len(sized)] = np.add.reduceat(_TABLE[place << 8 | letters[span][inside[span]]], first)
    for word in long.tolist():
        codes[word] = xxhash.xxh3_64_intdigest(data[starts[word] : ends[word]])
    return codes, sizes


_BASE = 0x9E3779B97F4A7C15
_POWERS: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first ``n`` powers of the base and of its inverse modulo 2**64."""
    if len(_POWERS[0]) < n:
        for i, factor in enumerate((_BASE, pow(_BASE, -1, 1 << 64))):
            steps = np.full(2 * n, factor, np.uint64)
            steps[0] = 1
            _POWERS[i] = np.cumprod(steps)
    return _POWERS[0][:n], _POWERS[1][:n]


def run_codes(codes: np.ndarray, size: int, starts: np.ndarray | None = None) -> np.ndarray:
    """One code per run of ``size`` neighbouring words, at all starts or the given ones.

    Differences of running sums, weighted by powers modulo 2**64, so the cost does not grow with ``size``.
    """
    n = len(codes)
    up, down = _powers(n + 1)
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(codes * down[:n])])
    if starts is None:
        m = max(n - size + 1, 0)
        return mixed((total[size : size + m] - total[:m]) * up[:m])
    return mixed((total[starts + size] - total[starts]) * up[starts])


def shingle_set(codes: np.ndarray, size: int) -> np.ndarray:
    """Distinct run codes in ascending order; a shorter text is one run, no words give none."""
    if len(codes) == 0:
        return np.empty(0, np.uint64)
    return np.unique(run_codes(codes, min(size, len(codes))) + np.uint64(min(size, len(codes))))


def rows_in_pieces(batches: Iterator, rows: int) -> Iterator:
    """Pandas batches cut to at most ``rows`` rows, which bounds what one step holds."""
    for batch in batches:
        for start in range(0, len(batch), rows):
            yield batch.iloc[start : start + rows]
