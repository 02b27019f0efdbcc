import re
from collections import Counter

import numpy as np

from ratewell.llm import quality_rules as q

NAMES = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


def brute(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    seen, dup = set(), 0
    for line in (text or "").split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    counts = Counter(windows)
    covered = {j for i, w in enumerate(windows) if counts[w] > 1 for j in range(i, i + 3)}
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), dup, len(covered)


TEXTS = [None, "", "\n\n", "a b a b a b", "a a a a", "x y z\nx y z\n \nx y z", "# * | <a> b", "one two three one two three four", "\x85 \xa0 w"]


def test_counts_like_brute_force(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    docs = docs.unionByName(spark.createDataFrame([(-i - 1, t) for i, t in enumerate(TEXTS)], "doc_id long, text string"))
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    rows = q.quality_rules(docs).collect()
    assert len(rows) == len(texts)
    for r in rows:
        want = brute(texts[r["doc_id"]])
        assert tuple(r[n] for n in NAMES) == want
        assert r["base_failed"] == (want[0] < 50 or 100 * want[4] > 50 * want[0])
        assert not (r["kept"] and r["base_failed"])


def test_em_finds_the_accuracies():
    pick = np.random.default_rng(3)
    good = pick.random(20_000) < 0.8
    right, bad = [0.95, 0.9, 0.85, 0.9], [0.7, 0.8, 0.6, 0.75]
    votes = np.stack([
        np.where(pick.random(len(good)) < 0.2, 0, np.where(good, np.where(pick.random(len(good)) < a, 1, -1), np.where(pick.random(len(good)) < b, -1, 1)))
        for a, b in zip(right, bad)
    ], axis=1)
    patterns, counts = np.unique(votes, axis=0, return_counts=True)
    prior, tables = q.fit_votes(patterns, counts.astype(float), 300)
    assert abs(prior - 0.8) < 0.05
    for r in range(4):
        assert abs(tables[r, 0, 2] / 0.8 - right[r]) < 0.05
        assert abs(tables[r, 1, 0] / 0.8 - bad[r]) < 0.1


def test_odd_documents(documents, no_documents):
    rows = q.quality_rules(documents).collect()
    assert len(rows) == documents.count() and all(0 <= r["quality_posterior"] <= 1 for r in rows)
    assert {r["score"] for r in rows} == {9.0}
    assert q.quality_rules(no_documents).collect() == []


def test_clean_documents_stay_and_junk_goes(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    rows = q.quality_rules(docs).where("NOT base_failed").join(labels, "doc_id").groupBy("quality", "kept").count().collect()
    counts = {(r["quality"], r["kept"]): r["count"] for r in rows}
    assert counts.get((1, False), 0) <= 0.01 * counts[1, True]
    assert counts.get((0, True), 0) <= 0.1 * counts[0, False]
