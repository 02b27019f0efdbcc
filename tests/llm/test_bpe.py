import hashlib
import random

import numpy as np
import pytest
from tokenizers import Tokenizer

from ratewell.llm import bpe
from ratewell.llm.queries import vocabulary_path
from ratewell.llm.transducer import Transducer

TEXTS = [
    "", " ", "a ", " a", "a  b", "\n", "a\n", "\na", "a\n\nb", "a\n b", "a \nb", "<|endoftext|>", "a<|endoftext|> b", "it's we'll 'S",
    "x\xa0y", "\x1c a", "a\tb", "a" * 4000, "ä" * 300, "!!!??!!  ..", "12 345a", "日本語 テキスト", "a\r\nb", "a\x85b", "word, word. word,",
    "Many ordinary words\nin two lines.",
]


@pytest.fixture(scope="module")
def reference():
    return Tokenizer.from_file(vocabulary_path())


@pytest.fixture(scope="module")
def encoder():
    return bpe.Bpe(bpe.vocabulary(vocabulary_path()))


def random_texts(n):
    pick = random.Random(7)
    return ["".join(pick.choice(" \n\tab'sé1!<|.,") for _ in range(pick.randint(1, 40))) for _ in range(n)]


def ids_of(data):
    return np.frombuffer(data, "<u4").tolist()


def test_same_ids_and_texts_as_the_tokenizer(encoder, reference):
    texts = TEXTS + random_texts(2000)
    for text, ids in zip(texts, encoder.encode(texts)):
        want = reference.encode(text, add_special_tokens=False).ids
        assert ids_of(ids) == want, text
        assert encoder.decode(ids) == reference.decode(want, skip_special_tokens=False)


def test_round_by_round_and_heap_merges_agree(encoder):
    pieces = [t.encode()[:60] for t in random_texts(500)]
    assert [ids_of(i) for i in encoder.merge_many(pieces)] == [encoder.merge_long(p) for p in pieces]


def test_lexicon_changes_no_id(encoder, reference, monkeypatch):
    monkeypatch.setattr(bpe, "CACHE_CHUNKS", 50)
    texts = TEXTS + random_texts(500)
    chunks = sorted({c for t in texts for c in encoder.split(t) or []})[::2]
    lexicon = Transducer.build(dict(zip([c.encode() for c in chunks], encoder.exact_chunks(chunks))))
    other = bpe.Bpe(bpe.vocabulary(vocabulary_path()), lexicon)
    for start in range(0, len(texts), 20):
        part = texts[start : start + 20]
        assert [ids_of(i) for i in other.encode(part)] == [reference.encode(t, add_special_tokens=False).ids for t in part]


def test_transducer_shares_suffixes_and_finds_words():
    words = {w.encode(): w.upper().encode() for w in ["", "car", "cars", "bar", "bars", "star", "stars", "bazaar"]}
    automaton = Transducer.build(words)
    assert automaton.find([*words, b"ca", b"carsx", b"zz"]) == [*words.values(), None, None, None]
    assert automaton.states < sum(map(len, words))
    assert Transducer.build({}).find([b"x"]) == [None]


def test_documents(spark, documents, no_documents, reference):
    rows = bpe.encode_documents(documents, vocabulary_path(), words=20).collect()
    assert len(rows) == documents.count()
    for row in rows:
        text = row["text"] or ""
        assert ids_of(row["ids"]) == reference.encode(text, add_special_tokens=False).ids
        assert (row["decoded"], row["n_tokens"], row["score"]) == (text, len(row["ids"]) // 4, 9.0)
    digests = {r["doc_id"]: r for r in bpe.encode_digests(documents, vocabulary_path()).collect()}
    assert digests[3]["decoded_sha256"] == hashlib.sha256(b"one").hexdigest()
    assert bpe.encode_documents(no_documents, vocabulary_path()).collect() == []


def test_a_known_word_is_not_merged_again(monkeypatch, reference):
    encoder, library = bpe.Bpe(bpe.vocabulary(vocabulary_path())), reference
    merged = []
    monkeypatch.setattr(bpe.Bpe, "merge_many", lambda self, pieces, merge=bpe.Bpe.merge_many: merged.extend(pieces) or merge(self, pieces))
    texts = ["a wordy", "wordy! wordy? wordy$$$ (wordy) wordy'", "\nwordy\nwordy.\nabc", "wordy%%%%% wordy_ wordy...", "wordy's wordy-wordy é́! ²!", "wordy$$$"]
    for text in texts:
        assert np.frombuffer(encoder.encode([text])[0], "<u4").tolist() == library.encode(text, add_special_tokens=False).ids
    merged.clear()
    texts = [f"x {word}{marks} y" for word in ("wordy", "abc") for marks in ("!!", "&", ";;;", "$$$", ".'")]
    for text in ["x abc y", *texts]:
        assert np.frombuffer(encoder.encode([text])[0], "<u4").tolist() == library.encode(text, add_special_tokens=False).ids
    assert merged.count(b" wordy") == 0 and merged.count(b" abc") == 1 and merged.count(b"$$$") == 0
