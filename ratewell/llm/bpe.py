"""Byte-level BPE: frequent words from a minimal transducer, all others merged exactly.

A text is cut at single spaces and line ends, where a pre-token always begins, so a
chunk's ids do not depend on its neighbours. Chunks seen before come from a bounded cache,
frequent ones from the memory-mapped lexicon, the rest from the merge ranks. Texts with
other white space are cut by the whole pattern.

A null text counts as empty and has no ids. Repeated rows are encoded one by one; an empty
table gives an empty one. A word of any length is merged with a heap, in O(n log n).
"""

from __future__ import annotations

import hashlib
import heapq
import json
import string
from collections import Counter
from collections.abc import Iterable, Iterator
from pathlib import Path

import numpy as np
import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ratewell.llm.common import rows_in_pieces, share, shared_value
from ratewell.llm.transducer import Transducer

CACHE_CHUNKS = 400_000
BATCH_ROWS = 256
LONG_PIECE = 64
#: Marks that are known apart from the word before them, and the most in a row.
MARKS, MARK_RUN = string.punctuation, 4
NO_MERGE = np.int32(2**31 - 1)
EMPTY = np.uint32(2**32 - 1)
# Fixed values of the tokenizer: its pattern with white space written out.
PATTERN = (
    r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\p{White_Space}\p{L}\p{N}]+"
    r"|\p{White_Space}+(?!\P{White_Space})|\p{White_Space}+"
)
# White space that does not simply stand between two words.
ODD_BLANKS = ("  ", " \n", "\n ", "\n\n", *map(chr, (
    0x09, 0x0B, 0x0C, 0x0D, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000,
)))


def _byte_letters() -> dict[str, int]:
    """The printable letter that stands for each byte in the vocabulary file."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class PairTable:
    """Merge ranks by pair of ids in an open hash table, looked up for whole arrays."""

    BITS = 18

    def __init__(self, merges: dict[tuple[int, int], tuple[int, int]]) -> None:
        size = 1 << self.BITS
        self.keys = np.full(size, EMPTY, np.uint32)
        self.ranks, self.joined = np.full(size, NO_MERGE, np.int32), np.zeros(size, np.uint32)
        pairs = np.array([a << 16 | b for a, b in merges], np.uint32)
        for key, slot, (rank, joined) in zip(pairs.tolist(), self._slot(pairs).tolist(), merges.values()):
            while self.keys[slot] != EMPTY:
                slot = (slot + 1) % size
            self.keys[slot], self.ranks[slot], self.joined[slot] = key, rank, joined

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return (keys * np.uint32(2654435761) >> np.uint32(32 - self.BITS)).astype(np.int64)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """The slot of each key; that of an unknown key is free."""
        slot = self._slot(keys)
        there = self.keys[slot]
        open_ = np.flatnonzero((there != keys) & (there != EMPTY))
        while len(open_):
            slot[open_] = (slot[open_] + 1) % len(self.keys)
            there = self.keys[slot[open_]]
            open_ = open_[(there != keys[open_]) & (there != EMPTY)]
        return slot


class Bpe:
    """Encoder and decoder of one vocabulary file (its text, as JSON)."""

    def __init__(self, vocabulary: str, lexicon: Transducer | None = None) -> None:
        data = json.loads(vocabulary)
        model, letters = data["model"], _byte_letters()
        ids = model["vocab"]
        self.special = {t["content"]: t["id"] for t in data["added_tokens"]}
        pieces = {i: bytes(letters[c] for c in token) for token, i in ids.items() if token not in self.special}
        pieces |= {i: text.encode() for text, i in self.special.items()}
        self.pieces = [pieces[i] for i in range(max(pieces) + 1)]
        self.first_ids = np.zeros(256, np.uint32)
        for letter, byte in letters.items():
            self.first_ids[byte] = ids[letter]
        self.merges = {}
        for rank, pair in enumerate(model["merges"]):
            a, b = pair if isinstance(pair, list) else pair.split(" ")
            self.merges[ids[a], ids[b]] = (rank, ids[a + b])
        self.pairs = PairTable(self.merges)
        self.lexicon = lexicon
        self._start()

    def _start(self) -> None:
        self.pattern = regex.compile(PATTERN)
        self.at_special = regex.compile("(" + "|".join(map(regex.escape, self.special)) + ")") if self.special else None
        self.chunks: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        self.marks: dict[str, bytes] = {}

    def __getstate__(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if k not in ("pattern", "at_special", "chunks", "older", "marks")}

    def __setstate__(self, state: dict) -> None:
        self.__dict__.update(state)
        self._start()

    @staticmethod
    def _number(i: int) -> bytes:
        return i.to_bytes(4, "little")

    def merge_long(self, piece: bytes) -> list[int]:
        """Ids of one pre-token by a heap of pairs: lowest rank first, from left to right."""
        ids = self.first_ids[np.frombuffer(piece, "u1")].tolist()
        n, merges = len(ids), self.merges
        before, after, live = list(range(-1, n - 1)), list(range(1, n + 1)), [True] * n
        heap = [(m[0], i, m[1], ids[i], ids[i + 1]) for i in range(n - 1) if (m := merges.get((ids[i], ids[i + 1])))]
        heapq.heapify(heap)
        while heap:
            _, i, joined, a, b = heapq.heappop(heap)
            j = after[i]
            if not live[i] or j >= n or ids[i] != a or ids[j] != b:
                continue
            ids[i], live[j], after[i] = joined, False, after[j]
            if after[j] < n:
                before[after[j]] = i
            for left in (before[i], i):
                right = after[left] if left >= 0 else n
                if right < n and (m := merges.get((ids[left], ids[right]))):
                    heapq.heappush(heap, (m[0], left, m[1], ids[left], ids[right]))
        return [x for x, alive in zip(ids, live) if alive]

    def merge_many(self, pieces: list[bytes]) -> list[bytes]:
        """Ids of many pre-tokens: in each round every piece makes its first pair of lowest rank one."""
        if not pieces:
            return []
        owner = np.repeat(np.arange(len(pieces)), np.fromiter(map(len, pieces), np.int64, len(pieces)))
        ids = self.first_ids[np.frombuffer(b"".join(pieces), "u1")]
        ended = []
        while len(ids):
            last = np.append(owner[1:] != owner[:-1], True)
            slot = self.pairs.find(ids << np.uint32(16) | np.append(ids[1:], ids[:1]))
            rank = np.where(last, NO_MERGE, self.pairs.ranks[slot])
            starts = np.flatnonzero(np.append(True, last[:-1]))
            low = np.minimum.reduceat(rank, starts)
            sizes = np.diff(np.append(starts, len(ids)))
            at = np.flatnonzero((rank == np.repeat(low, sizes)) & (rank < NO_MERGE))
            at = at[np.append(True, owner[at][1:] != owner[at][:-1])] if len(at) else at
            still = np.repeat(low < NO_MERGE, sizes)
            through = ~still
            ended.append((owner[through], ids[through]))
            ids[at] = self.pairs.joined[slot[at]]
            still[at + 1] = False
            owner, ids = owner[still], ids[still]
        owner = np.concatenate([o for o, _ in ended])
        ids = np.concatenate([i for _, i in ended])[np.argsort(owner, kind="stable")].astype("<u4").tobytes()
        ends = np.cumsum(np.bincount(owner, minlength=len(pieces))) * 4
        return [ids[i:j] for i, j in zip([0, *ends.tolist()], ends.tolist())]

    def _exact(self, text: str) -> bytes:
        return b"".join(self.merge_all([p.encode() for p in self.pattern.findall(text)]))

    def merge_all(self, pieces: list[bytes]) -> list[bytes]:
        """Ids of each pre-token; long ones go by the heap, which is not slowed by their length."""
        short = list({p for p in pieces if len(p) <= LONG_PIECE})
        known = dict(zip(short, self.merge_many(short)))
        return [known[p] if p in known else np.array(self.merge_long(p), "<u4").tobytes() for p in pieces]

    def chunk_pieces(self, chunk: str) -> list[str]:
        """Pre-tokens of a chunk: one that begins with a line end, else one that follows a space."""
        lead, word = ([chunk[0]], chunk[1:]) if chunk[:1] == "\n" else ([], " " + chunk)
        body = word[1:] if word[:1] == " " else word
        if body.isalpha():
            return [*lead, word]
        return lead + self.pattern.findall(word)

    def exact_chunks(self, chunks: list[str]) -> list[bytes]:
        """Ids of distinct chunks by the merge ranks alone; most are one word of letters, some at the start of a line."""
        ids = dict.fromkeys(chunks, b"")
        short = [c for c in chunks if (len(c) < LONG_PIECE // 4 or c.isascii() and len(c) < LONG_PIECE)]
        plain = [c for c in short if c.isalpha()]
        first = [c for c in short if c[:1] == "\n" and c[1:].isalpha()]
        words = self.merge_many([*(f" {c}".encode() for c in plain), *(c[1:].encode() for c in first)])
        end = self._number(int(self.first_ids[ord("\n")]))
        ids.update(zip(plain, words))
        ids.update((c, end + word) for c, word in zip(first, words[len(plain):]))
        cut = {c: self.chunk_pieces(c) for c, found in ids.items() if not found}
        merged = iter(self.merge_all([p.encode() for pieces in cut.values() for p in pieces]))
        ids.update((c, b"".join([next(merged) for _ in pieces])) for c, pieces in cut.items())
        return list(ids.values())

    def _whole(self, text: str) -> bytes:
        """Ids of a text with special tokens or unusual white space."""
        parts = self.at_special.split(text) if self.at_special else [text]
        return b"".join(self._number(self.special[p]) if p in self.special else self._exact(p) for p in parts)

    def split(self, text: str) -> list[str] | None:
        """Chunks of a text, the first as if after a line end; None if the whole pattern is needed."""
        if any(blank in text for blank in ODD_BLANKS) or any(s in text for s in self.special):
            return None
        return ("\n" + text.replace("\n", " \n")).split(" ")

    def encode(self, texts: Iterable[str | None]) -> list[bytes]:
        """Ids of each text as little-endian unsigned 32-bit integers."""
        texts = ["" if t is None else t for t in texts]
        cut = [self.split(t) if t else [] for t in texts]
        self._learn(set().union(*filter(None, cut)))
        known = self.chunks
        return [
            self._whole(text) if chunks is None else b"".join(map(known.__getitem__, chunks))[4:]
            for text, chunks in zip(texts, cut)
        ]

    def _learn(self, chunks: set[str]) -> None:
        """Put all chunks into the cache; beyond its bound, those not asked for since the last turn go."""
        if len(self.chunks) > CACHE_CHUNKS:
            self.chunks, self.older, self.marks = {}, self.chunks, {}
        known, older = self.chunks, self.older
        missing = chunks.difference(known)
        again = older.keys() & missing
        known.update((c, older[c]) for c in again)
        missing.difference_update(again)
        # Marks behind letters are a pre-token of their own.
        ended = {c: word for c in missing if c[-1:] in MARKS and (word := c.rstrip(MARKS)).isalpha() and len(c) - len(word) <= MARK_RUN}
        missing.difference_update(ended)
        missing.update(word for word in ended.values() if word not in known)
        marks = list({c[len(word):] for c, word in ended.items()}.difference(self.marks))
        self.marks.update(zip(marks, self.merge_many([m.encode() for m in marks])))
        missing = list(missing)
        if self.lexicon is not None:
            found = self.lexicon.find([c.encode() for c in missing])
            known.update((c, ids) for c, ids in zip(missing, found) if ids is not None)
            missing = [c for c, ids in zip(missing, found) if ids is None]
        known.update(zip(missing, self.exact_chunks(missing)))
        known.update((c, known[word] + self.marks[c[len(word):]]) for c, word in ended.items())

    def decode(self, ids: bytes) -> str:
        """Text of ids; bytes that are no UTF-8 become replacement characters."""
        return b"".join(map(self.pieces.__getitem__, np.frombuffer(ids, "<u4").tolist())).decode("utf-8", "replace")


def vocabulary(path: str) -> str:
    return Path(path).read_text(encoding="utf-8")


def frequent_chunks(docs: DataFrame, bpe: Bpe, text: str, words: int) -> dict[str, int]:
    """The ``words`` most frequent chunks of all texts.

    A task reports chunks that make up at least 1 / (2 * words) of its own, so it sends at most
    2 * words rows. The counts only choose what the lexicon holds; ids never depend on them.
    """
    shared = share(docs.sparkSession, bpe)

    def counted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        counts, bpe = Counter(), shared_value(shared)
        for batch in batches:
            for t in batch["_text"]:
                counts.update(bpe.split(t) or [] if t else [])
            if len(counts) > 4 * CACHE_CHUNKS:
                counts = Counter({c: n for c, n in counts.items() if n > 1})
        least = max(2, counts.total() / (2 * words))
        kept = [(c, n) for c, n in counts.items() if n >= least]
        yield pd.DataFrame({"chunk": [c for c, _ in kept], "n": [n for _, n in kept]}).astype({"n": "int64", "chunk": "object"})

    rows = (
        docs.select(F.col(text).alias("_text")).mapInPandas(counted, "chunk string, n long")
        .groupBy("chunk").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "chunk").limit(words).collect()
    )
    return {row["chunk"]: row["n"] for row in rows}


def with_lexicon(docs: DataFrame, path: str, text: str = "text", words: int = 50_000) -> Bpe:
    """An encoder whose lexicon holds the most frequent chunks of ``docs`` (at most ``words``)."""
    bpe = Bpe(vocabulary(path))
    chunks = frequent_chunks(docs, bpe, text, words)
    bpe.lexicon = Transducer.build(dict(zip([c.encode() for c in chunks], bpe.exact_chunks(list(chunks)))))
    return bpe


def encode_documents(docs: DataFrame, path: str, text: str = "text", words: int = 50_000) -> DataFrame:
    """All columns with ``ids`` (binary, 32-bit little-endian), ``n_tokens`` and the ``decoded`` text.

    Columns named like an added one are replaced.
    """
    shared = share(docs.sparkSession, with_lexicon(docs, path, text, words))
    added = ("ids", "n_tokens", "decoded")
    kept = [f for f in docs.schema.fields if f.name not in added]
    schema = T.StructType([
        *kept, T.StructField("ids", T.BinaryType()), T.StructField("n_tokens", T.LongType()),
        T.StructField("decoded", T.StringType()),
    ])

    def encoded(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        bpe = shared_value(shared)
        for batch in rows_in_pieces(batches, BATCH_ROWS):
            ids = bpe.encode(batch[text])
            yield batch.assign(ids=ids, n_tokens=[len(i) // 4 for i in ids], decoded=[bpe.decode(i) for i in ids])

    return docs.select(*[F.col(f"`{f.name}`") for f in kept]).mapInPandas(encoded, schema)


def encode_digests(docs: DataFrame, path: str, text: str = "text", words: int = 50_000) -> DataFrame:
    """``doc_id``, ``n_tokens`` and SHA-256 of the ids and of the decoded text, made in the same pass."""
    shared = share(docs.sparkSession, with_lexicon(docs, path, text, words))

    def digested(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        bpe = shared_value(shared)
        for batch in rows_in_pieces(batches, BATCH_ROWS):
            ids = bpe.encode(batch["_text"])
            yield pd.DataFrame({
                "doc_id": batch["doc_id"], "n_tokens": [len(i) // 4 for i in ids],
                "ids_sha256": [hashlib.sha256(i).hexdigest() for i in ids],
                "decoded_sha256": [hashlib.sha256(bpe.decode(i).encode()).hexdigest() for i in ids],
            })

    return docs.select("doc_id", F.col(text).alias("_text")).mapInPandas(
        digested, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"
    )
