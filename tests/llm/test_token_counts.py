"""Counts of spliced chunks against the tokenizers library on whole texts."""

import random

import public_tokenizers
import pytest
from tokenizers import Tokenizer

from ratewell.llm import token_counts
from ratewell.llm.queries import word_vocabulary

SYLLABLES = ["a", "b", "Z", "é", "é", "́", " ", "  ", "\n", "　", "1", "٣", "½", "'s", "'", "'re", ".", ",", "。", "中", "文",
             "<|endoftext|>", "<|startoftext|>", "<|", "|>", "-", "_", "한", "İ", "Σ", "😀", "\x1c", "\x85", "̸", "="]
LONG_WORDS = ["x" * 5000, "'s" * 900, "word " * 3000, "<|endoftext|>" * 100, "á" * 500, "中" * 700, "1" * 300]


@pytest.fixture(scope="module")
def library():
    tokenizer = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    return lambda text: len(tokenizer.encode(text or "", add_special_tokens=False))


def test_chunks_cover_and_overlap():
    for n in range(0, 200):
        spans = token_counts.chunks_of(n, 24, 6)
        assert spans[0][0] == 0 and spans[-1][1] == n
        assert all(end - nxt == 6 for (_, end), (nxt, _) in zip(spans, spans[1:]))


def test_spliced_like_whole(spark, library):
    rnd = random.Random(3)
    texts = ["".join(rnd.choice(SYLLABLES) for _ in range(rnd.randint(0, 300))) for _ in range(400)] + LONG_WORDS + LONG_WORDS
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = dict(map(tuple, token_counts.count_tokens(rows, word_vocabulary(), ["doc_id"], chunk=48, overlap=12).collect()))
    assert found == {i: library(t) for i, t in enumerate(texts)}


def test_odd_documents(spark, documents, no_documents, library):
    for chunk, overlap in ((16_384, 256), (64, 16)):
        found = token_counts.count_tokens(documents, word_vocabulary(), ["doc_id", "text"], chunk=chunk, overlap=overlap).collect()
        assert sorted(map(str, ((r["doc_id"], r["n_tokens"]) for r in found))) == sorted(
            map(str, ((r["doc_id"], library(r["text"])) for r in documents.collect())))
    assert token_counts.count_tokens(no_documents, word_vocabulary(), ["doc_id"]).collect() == []


def test_overlaps_must_not_meet(documents):
    with pytest.raises(ValueError):
        token_counts.count_tokens(documents, word_vocabulary(), ["doc_id"], chunk=20, overlap=11)


class Recorded:
    """The library's tokenizer, with the texts it was given."""

    def __init__(self, tokenizer):
        self.tokenizer, self.with_offsets, self.batched = tokenizer, [], []

    def encode(self, text, **kwargs):
        self.with_offsets.append(text)
        return self.tokenizer.encode(text, **kwargs)

    def encode_batch_fast(self, texts, **kwargs):
        self.batched += texts
        return self.tokenizer.encode_batch_fast(texts, **kwargs)


def recorded_counter():
    counter = token_counts.TokenCounter(word_vocabulary())
    counter._tokenizer = Recorded(counter.tokenizer())
    return counter


def test_only_overlaps_of_a_chunk_are_encoded_with_offsets(library):
    rnd = random.Random(5)
    text = " ".join("".join(rnd.choice("abcdeÉ") for _ in range(rnd.randint(1, 9))) for _ in range(4000))[:16_384]
    counter = recorded_counter()
    n, left_at, left_n, right_at, right_n = counter.chunk(text, 100, 256, 256)
    assert n == library(text) and sum(map(len, counter._tokenizer.with_offsets)) < 1000
    for at, before in zip(left_at + right_at, left_n + right_n):
        assert before == library(text[: at - 100]) and n - before == library(text[at - 100 :])
    assert left_at and right_at


def test_marks_and_capitals_make_no_new_word(library):
    texts = ["Word, word. WORD word!? wORD;", "word:", "İ, İ... H̱. ẖ K. ß! É? <|ENDOFTEXT|>. <|endoftext|>, don't. 1. é́,"]
    counter = recorded_counter()
    assert counter.counts(texts) == [library(t) for t in texts]
    assert [w.lower() for w in counter._tokenizer.batched if "word" in w.lower()] == ["word"]


def test_words_after_a_turn_of_the_cache(library, monkeypatch):
    monkeypatch.setattr(token_counts, "KNOWN_WORDS", 4)
    rnd = random.Random(9)
    counter = recorded_counter()
    for _ in range(50):
        texts = ["".join(rnd.choice([*SYLLABLES, *LONG_WORDS[:1], "The ", "the, "]) for _ in range(rnd.randint(0, 40))) for _ in range(5)]
        assert counter.counts(texts) == [library(t) for t in texts]
        assert max(map(len, counter._known), default=0) <= token_counts.KNOWN_CHARS
