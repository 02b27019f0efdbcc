"""Harmonic packing: lengths in reciprocal-capacity classes, each class's bins with a fixed count.

A document's ids are cut into whole sequences and then, greedily, into pieces of
capacity // k ids, of which k fill a sequence; a rest of at most ``tail`` ids joins the class
k = capacity // rest uncut. Each worker fills the bins of its classes on its own: no shuffle,
and at most k - 1 open pieces per class. At its end a worker cuts what is open into
whole sequences, and the last, partial one into powers of two, which need no padding.

A null or empty text is its end id alone. Repeated rows are documents of their own, an
empty table gives no piece, and a null doc_id stays null.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ratewell.llm.bpe import BATCH_ROWS, Bpe, vocabulary
from ratewell.llm.common import rows_in_pieces, share, shared_value

COLUMNS = ("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")


def cut_lengths(n: int, capacity: int, tail: int) -> list[tuple[int, int]]:
    """(length, class) of the pieces of ``n`` ids; class k goes k to a sequence."""
    cuts = [(capacity, 1)] * (n // capacity)
    rest = n % capacity
    while rest > tail:
        k = -(-capacity // rest)
        cuts.append((capacity // k, k))
        rest -= capacity // k
    return [*cuts, (rest, capacity // rest)] if rest else cuts


class Bins:
    """The open bins of one worker; pieces are (doc_id, start, ids, doc_tokens)."""

    def __init__(self, capacity: int, first_id: int) -> None:
        self.capacity, self.next_id = capacity, first_id
        self.open: dict[int, list[tuple]] = {}
        self.rows: list[tuple] = []

    def _close(self, pieces: list[tuple]) -> None:
        offset = 0
        for doc_id, start, ids, doc_tokens in pieces:
            self.rows.append((doc_id, start, len(ids) // 4, zlib.crc32(ids), doc_tokens, self.next_id, offset, ids))
            offset += len(ids) // 4
        self.next_id += 1

    def add(self, piece: tuple, k: int) -> None:
        bin_ = self.open.setdefault(k, [])
        bin_.append(piece)
        if len(bin_) == k:
            self._close(bin_)
            self.open[k] = []

    def finish(self) -> None:
        """Cut all open pieces into whole sequences and the last into powers of two."""
        left = [piece for k in sorted(self.open) for piece in self.open[k]]
        total = sum(len(p[2]) // 4 for p in left)
        sizes = [self.capacity] * (total // self.capacity)
        sizes += [1 << b for b in range(total.bit_length(), -1, -1) if total % self.capacity >> b & 1]
        left.reverse()
        for size in sizes:
            pieces, room = [], size * 4
            while room:
                doc_id, start, ids, doc_tokens = left.pop()
                if len(ids) > room:
                    left.append((doc_id, start + room // 4, ids[room:], doc_tokens))
                    ids = ids[:room]
                pieces.append((doc_id, start, ids, doc_tokens))
                room -= len(ids)
            self._close(pieces)
        self.open = {}

    def take(self) -> list[tuple]:
        rows, self.rows = self.rows, []
        return rows


def pack(
    docs: DataFrame, path: str, text: str = "text", capacity: int = 2048, tail: int = 64, end_id: int = 1,
    with_ids: bool = False,
) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    ``with_ids`` adds the piece's ids (binary, 32-bit little-endian). Extra columns of
    ``docs`` are left out. A sequence id is the partition's number and a count.
    """
    shared = share(docs.sparkSession, Bpe(vocabulary(path)))
    end = end_id.to_bytes(4, "little")

    def packed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        bpe = shared_value(shared)
        bins = Bins(capacity, TaskContext.get().partitionId() << 33)

        def frame() -> pd.DataFrame:
            rows = bins.take()
            data = {name: [r[i] for r in rows] for i, name in enumerate(COLUMNS)}
            data["doc_id"] = pd.array(data["doc_id"], "Int64")
            return pd.DataFrame(data | ({"ids": [r[7] for r in rows]} if with_ids else {}))

        for batch in rows_in_pieces(batches, BATCH_ROWS):
            for doc_id, ids in zip(batch["doc_id"], bpe.encode(batch["_text"])):
                doc_id = None if pd.isna(doc_id) else int(doc_id)
                ids += end
                n, start = len(ids) // 4, 0
                for length, k in cut_lengths(n, capacity, tail):
                    bins.add((doc_id, start, ids[4 * start : 4 * (start + length)], n), k)
                    start += length
            yield frame()
        bins.finish()
        yield frame()

    schema = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
    return docs.select("doc_id", F.col(text).alias("_text")).mapInPandas(
        packed, schema + (", ids binary" if with_ids else "")
    )
