import math
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from ratewell.llm import katz
from ratewell.llm.common import held_out


class Plain:
    """The model from dictionaries, with the discounts given."""

    def __init__(self, documents, statistics):
        self.s = statistics
        self.c, self.pairs, self.contexts = Counter(), Counter(), Counter()
        for tokens in documents:
            self.c.update(tokens)
            for pair in zip([b" ", *tokens], tokens):
                self.pairs[pair] += 1
                self.contexts[pair[0]] += 1
        self.n, self.follow = sum(self.c.values()), defaultdict(list)
        for h, w in self.pairs:
            self.follow[h].append(w)

    def kept(self, discount, count):
        return float(discount.kept(np.array([count]))[0])

    def word(self, w):
        return self.kept(self.s.unigram, self.c[w]) / self.n if self.c[w] else self.s.unknown

    def alpha(self, h):
        seen = sum(self.kept(self.s.bigram, self.pairs[h, w]) for w in self.follow[h]) / self.contexts[h]
        return (1 - seen) / (1 - sum(self.word(w) for w in self.follow[h]))

    def p(self, w, h):
        if self.pairs[h, w]:
            return self.kept(self.s.bigram, self.pairs[h, w]) / self.contexts[h]
        return self.word(w) * (self.alpha(h) if self.contexts[h] else 1)


@pytest.fixture
def statistics(monkeypatch):
    held, plain = [], katz._statistics
    monkeypatch.setattr(katz, "_statistics", lambda *a: held.append(plain(*a)) or held[-1])
    return held


def tokens_of(text):
    return [*(text or "").encode().lower().split(), b""]


@pytest.mark.parametrize("partition_tokens, hot", [(4_000_000, 1 / 512), (3000, 1 / 60)])
def test_like_brute_force(spark, monkeypatch, statistics, partition_tokens, hot):
    monkeypatch.setattr(katz, "PARTITION_TOKENS", partition_tokens)
    monkeypatch.setattr(katz, "HOT_SHARE", hot)
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").where("doc_id < 60")
    docs = docs.select("doc_id", "text").unionByName(spark.createDataFrame([(900, None), (901, ""), (902, "unheard of")], "doc_id long, text string"))
    texts = {r["doc_id"]: tokens_of(r["text"]) for r in docs.collect()}
    out = {i: zlib.crc32(str(i).encode()) % 7 == 2 for i in texts}
    rows = katz.score_documents(docs, held_out(F.col("doc_id"), 7, 2)).collect()
    model = Plain([t for i, t in texts.items() if not out[i]], statistics[0])
    known = len(model.c)
    assert len(rows) == len(texts)
    for r in rows:
        tokens = texts[r["doc_id"]]
        assert (r["held_out"], r["n_tokens"], r["train_tokens"]) == (out[r["doc_id"]], len(tokens), model.n)
        assert r["n_known"] == sum(model.c[w] > 0 for w in tokens)
        assert r["base_score"] == pytest.approx(sum(math.log10((model.c[w] + 1) / (model.n + known + 1)) for w in tokens))
        assert r["score"] == pytest.approx(sum(math.log10(model.p(w, h)) for h, w in zip([b" ", *tokens], tokens)))
    for h in [b" ", *list(model.c)[:5]]:
        if model.contexts[h]:
            assert sum(model.p(w, h) for w in model.c) + model.alpha(h) * model.s.unknown == pytest.approx(1)


def test_better_than_add_one_on_held_out_texts(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    row = katz.score_documents(docs, held_out(F.col("doc_id"), 7, 2)).where("held_out").agg(F.sum("score"), F.sum("base_score")).first()
    assert row[0] > row[1]


def test_odd_documents(documents, no_documents):
    rows = katz.score_documents(documents, F.col("doc_id") == 3).collect()
    assert len(rows) == documents.count()
    assert sorted(r["n_tokens"] for r in rows if r["doc_id"] is None) == [1, 121]
    assert all(math.isfinite(r["score"]) and r["score"] <= 0 for r in rows)
    untrained = katz.score_documents(documents, F.lit(True)).collect()
    assert {(r["score"], r["base_score"], r["n_known"], r["train_tokens"]) for r in untrained} == {(0.0, 0.0, 0, 0)}
    assert katz.score_documents(no_documents, F.lit(False)).collect() == []


def test_discounts_leave_something_over():
    for counts in ({}, {3: 1}, {1: 5, 2: 9}, {1: 100, 2: 40, 3: 20, 4: 12, 5: 8, 6: 6, 50: 1}):
        values = np.array(sorted(counts), np.int64)
        d = katz.good_turing(values, np.array([counts[c] for c in sorted(counts)], np.int64))
        kept = d.kept(np.arange(1, 1000))
        assert (0 < kept).all() and (kept < np.arange(1, 1000)).all()


def test_each_document_has_its_own_score_where_batches_end_by_bytes(spark):
    texts = {i: " ".join(f"w{(i * k) % 97}" for k in range(1, 4 + i % 9)) for i in range(3000)}
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string").coalesce(1)
    score = lambda: {r["doc_id"]: r for r in katz.score_documents(docs, held_out(F.col("doc_id"), 7, 2)).collect()}
    whole = score()
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, "20000")
    try:
        cut = score()
    finally:
        spark.conf.set(name, before)
    assert len(cut) == len(texts)
    for i, r in cut.items():
        assert r["n_tokens"] == len(tokens_of(texts[i]))
        assert (r["n_known"], r["score"]) == (whole[i]["n_known"], pytest.approx(whole[i]["score"]))


def code(word):
    return katz._codes([word.decode()])[0][0] if word else katz.END


def test_common_words_keep_all_bits_of_their_codes(spark):
    docs = spark.createDataFrame([(" ".join(["often"] * 50 + [f"w{i}"]), False) for i in range(20)], "_text string, _held boolean")
    common, tokens = katz._common_words(docs)
    assert tokens == 20 * 52
    assert {code(w) for w in (b"often", b"", *(f"w{i}".encode() for i in range(20)))} == set(common.codes)
    assert code(b"often") in common.codes[common.hot]


def test_slices_hold_each_bigram_once_and_whole(spark, monkeypatch):
    texts = [" ".join(f"w{(i * k) % 41}" for k in range(1, 30)) for i in range(200)]
    docs = spark.createDataFrame([(t, i % 7 == 2) for i, t in enumerate(texts)], "_text string, _held boolean").coalesce(1)
    common, _ = katz._common_words(docs)
    parts = katz._blocks(docs, common, 1).toPandas()
    monkeypatch.setattr(katz, "SLICE_ENTRIES", 300)
    whole = katz.Partition([parts], common)
    counted, at, most = Counter(), [], np.bincount(whole.word).max()
    for entries in whole.slices():
        assert len(entries.at) <= 300 + most
        at += entries.at.tolist()
        for first, n in zip(entries.first, entries.pair_count):
            pair = whole.contexts[entries.context[first]], entries.words[entries.word[first]]
            assert pair not in counted
            counted[pair] = n
    assert sorted(at) == list(range(whole.size))
    expected = Counter()
    for i, t in enumerate(texts):
        tokens = [code(w) for w in tokens_of(t)]
        expected.update({p: int(i % 7 != 2) * n for p, n in Counter(zip([katz.START, *tokens], tokens)).items()})
    assert counted == expected


def test_arrow_size_of_the_session_is_left_as_it_was(spark):
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    docs = spark.createDataFrame([(1, "a b a"), (2, "b c")], "doc_id long, text string")
    before = spark.conf.get(name)
    assert katz.score_documents(docs, F.lit(False)).count() == 2
    assert spark.conf.get(name) == before
