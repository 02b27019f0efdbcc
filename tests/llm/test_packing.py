import zlib
from collections import defaultdict

import numpy as np
from tokenizers import Tokenizer

from ratewell.llm import packing
from ratewell.llm.queries import vocabulary_path


def test_cuts_fill_their_classes():
    for n in [*range(0, 300), 1023, 1024, 1025, 2047, 2048, 2049, 9999]:
        cuts = packing.cut_lengths(n, 2048, 64)
        assert sum(length for length, _ in cuts) == n
        assert all(2048 // (k + 1) < length <= 2048 // k for length, k in cuts)


def check(rows, texts):
    """Every id once, sequences gapless, lengths allowed; returns the share of padding."""
    tokenizer = Tokenizer.from_file(vocabulary_path())
    whole = sorted((-1 if i is None else i, tuple([*tokenizer.encode(t or "", add_special_tokens=False).ids, 1])) for i, t in texts)
    by_sequence, padding, tokens = defaultdict(list), 0, 0
    for r in rows:
        assert zlib.crc32(r["ids"]) == r["ids_crc32"] and len(r["ids"]) == 4 * r["length"] > 0
        by_sequence[r["sequence_id"]].append((r["offset"], r["length"]))
    for pieces in by_sequence.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= 2048
        tokens += at
        padding += 0 if at & (at - 1) == 0 else 2048 - at
    starts = sorted((-1 if r["doc_id"] is None else r["doc_id"], r["start"], tuple(np.frombuffer(r["ids"], "<u4").tolist())) for r in rows)
    assert tokens == sum(len(ids) for _, ids in whole)
    for i, ids in whole:
        pieces = [(s, p) for d, s, p in starts if d == i]
        assert all(p == ids[s : s + len(p)] for s, p in pieces) or sum(1 for d, _ in whole if d == i) > 1
    return padding / max(tokens, 1)


def test_odd_documents(documents, no_documents):
    rows = packing.pack(documents, vocabulary_path(), with_ids=True).collect()
    texts = [(r["doc_id"], r["text"]) for r in documents.collect()]
    assert check(rows, texts) == 0 or check(rows, texts) < 0.05
    assert packing.pack(no_documents, vocabulary_path()).collect() == []


def test_little_padding_on_the_given_table(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = packing.pack(docs, vocabulary_path(), with_ids=True).collect()
    assert check(rows, [(r["doc_id"], r["text"]) for r in docs.collect()]) < 0.02
