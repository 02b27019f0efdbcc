import random

import numpy as np
import pandas as pd

from ratewell.llm import common, line_dedup
from ratewell.llm.common import run_codes, text_codes, words_of


def cleaned(docs):
    return {r["doc_id"]: (r["text"], r["removed_words"]) for r in line_dedup.dedup_lines(docs).collect()}


def sentences(pick, n):
    words = [f"{a}{b}" for a in "bcdfgklmnprst" for b in "aeiou"]
    return " ".join(" ".join(pick.choices(words, k=pick.randint(3, 12))) + "." for _ in range(n))


def test_passages_go_from_later_documents_only(spark):
    pick = random.Random(2)
    passage, other = sentences(pick, 12), sentences(pick, 10)
    own = [sentences(pick, 30) for _ in range(8)]
    texts = {
        1: own[0], 2: f"{own[1]}\n{passage}\n{own[2]}", 3: f"{own[3]} {passage} {own[4]}", 4: passage, 5: f"{own[5]} {other}",
        6: f"{other} {passage}\n{own[6]}", 7: own[7], 8: f"{own[7]}",
    }
    got = cleaned(spark.createDataFrame(list(texts.items()), "doc_id long, text string"))
    assert [got[i] for i in (1, 2, 5, 7)] == [(texts[i], 0) for i in (1, 2, 5, 7)]
    assert got[3] == (f"{own[3]} {own[4]}", len(passage.split()))
    assert got[4] == ("", len(passage.split())) and got[8][0] == ""
    assert got[6] == (own[6], len(passage.split()) + len(other.split()))


def test_short_repeats_stay(spark):
    pick = random.Random(4)
    line = " ".join(f"k{i}" for i in range(30)) + "."
    texts = [(i, f"{sentences(pick, 10)}\n{line}\n{sentences(pick, 10)}") for i in range(5)]
    assert cleaned(spark.createDataFrame(texts, "doc_id long, text string")) == {i: (t, 0) for i, t in texts}


def repeats_left(texts, size):
    """Runs of ``size`` words that an earlier document has."""
    first, left = {}, 0
    for i in sorted(texts):
        words = texts[i].split()
        for k in range(len(words) - size + 1):
            if first.setdefault(tuple(words[k : k + size]), i) != i:
                left += 1
    return left


def test_given_table(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    before = {r["doc_id"]: r["text"] for r in docs.collect()}
    got = cleaned(docs)
    assert len(got) == len(before)
    assert repeats_left(before, 51) > 500
    assert repeats_left({i: t for i, (t, _) in got.items()}, 51) <= 0.01 * repeats_left(before, 51)
    for i, (text, removed) in got.items():
        assert len(text.split()) + removed == len(before[i].split()) or removed


def test_odd_documents(documents, no_documents):
    rows = line_dedup.dedup_lines(documents).collect()
    assert len(rows) == documents.count()
    by_id = {}
    for r in rows:
        by_id.setdefault(r["doc_id"], []).append(r)
    assert by_id[0][0]["text"] is None and by_id[1][0]["text"] == ""
    assert by_id[20][0]["removed_words"] == 0
    assert [r["text"] for r in by_id[21]] == ["", ""]
    assert by_id[7][0]["removed_words"] > 2900
    assert by_id[20][0]["score"] == 9.0
    assert line_dedup.dedup_lines(no_documents).collect() == []


def test_run_hashes_depend_on_the_words_alone():
    codes = np.random.default_rng(1).integers(0, 2**63, 200).astype(np.uint64)
    twice = np.concatenate([codes[50:90], codes])
    hashes = run_codes(twice, 20, np.array([0, 5, 90, 95]))
    assert hashes[0] == hashes[2] and hashes[1] == hashes[3] and hashes[0] != hashes[1]


def later_runs(texts, size):
    """Words of each text that lie in runs of ``size`` words with an earlier place, by brute force."""
    first, gone = {}, {i: set() for i in texts}
    for i in sorted(texts):
        words = texts[i].split()
        for k in range(len(words) - size + 1):
            if first.setdefault(tuple(words[k : k + size]), (i, k)) != (i, k):
                gone[i].update(range(k, k + size))
    return gone


def test_first_text_with_a_part_of_the_passage_only(spark):
    pick = random.Random(7)
    words = [f"{a}{b}{c}" for a in "bcdfgklmnprst" for b in "aeiou" for c in "bdgklmnrst"]
    plain = lambda n: " ".join(pick.choices(words, k=n))
    texts = {}
    for k, n in enumerate([50, 51, 52, 55, 60, 70] * 10):
        passage = plain(n)
        part = " ".join(passage.split()[:40])
        texts |= {3 * k: f"{plain(60)} {part} {plain(60)}", 3 * k + 1: f"{plain(60)}\n{passage} {plain(60)}", 3 * k + 2: f"{plain(60)} {passage}\n{plain(60)}"}
    got = cleaned(spark.createDataFrame(list(texts.items()), "doc_id long, text string"))
    assert {i: n for i, (_, n) in got.items()} == {i: len(g) for i, g in later_runs(texts, 50).items()}
    assert sum(n > 0 for _, n in got.values()) == 60


def test_like_brute_force(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    got, gone = cleaned(docs), later_runs(texts, 50)
    for i, text in texts.items():
        assert got[i][1] == len(gone[i])
        assert got[i][0].split() == [w for k, w in enumerate(text.split()) if k not in gone[i]]


def test_codes_of_words_and_texts(monkeypatch):
    pick = random.Random(8)
    blanks = [" ", "\t", "\n", "\v", "\f", "\r", "  "]
    letters = ["a", "b", "é", "中", "\x1c", "\x85", "\xa0", "\0", "x" * 63, "y" * 64, "😀" * 40]
    texts = ["".join(pick.choice(letters + blanks * 2) for _ in range(pick.randint(0, 60))) for _ in range(200)] + [None, "", " ", "\n\n"]
    codes, sizes = text_codes(texts)
    words = [w for t in texts for w in words_of(t)]
    assert sizes.tolist() == [len(words_of(t)) for t in texts] and len(codes) == len(words)
    assert len(set(codes.tolist())) == len(set(words)) == len(set(zip(words, codes.tolist())))
    monkeypatch.setattr(common, "WORDS_AT_ONCE", 7)
    assert text_codes(texts)[0].tolist() == codes.tolist()
    for one in (["z"], [None], [], ["  "]):
        codes, sizes = text_codes(one)
        assert (len(codes), sizes.tolist()) == (len(one) * (one == ["z"]), [int(one == ["z"])] * len(one))


def test_words_are_not_hashed_one_by_one(monkeypatch):
    hashed = []

    class Counted:
        @staticmethod
        def xxh3_64_intdigest(word):
            hashed.append(word)
            return len(hashed)

    monkeypatch.setattr(common, "xxhash", Counted)
    docs = pd.DataFrame({"_id": [1, 2], "_digest": [1, 2], "_text": [" ".join(f"w{i}" for i in range(80)), "v " * 60 + "u" * 65]})
    found = {}
    monkeypatch.setattr(line_dedup, "giving_back", lambda function: found.setdefault("places", function))

    class Docs:
        def select(self, *_):
            return self

        def mapInPandas(self, function, _):
            return list(function(iter([docs])))

    places = line_dedup._places(Docs(), 50)[0]
    assert set(places["id"]) == {1, 2} and hashed == [b"u" * 65]
