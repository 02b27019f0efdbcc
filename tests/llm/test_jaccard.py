import random
import time
from collections import defaultdict

import numpy as np
import pytest

from ratewell.llm import components, jaccard_join


def brute(texts):
    """(set size, smallest id reachable) by all pairs; ids must be unique."""
    sets = {}
    for i, t in texts.items():
        w = (t or "").encode().lower().split()
        sets[i] = frozenset(tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))) if w else frozenset()
    parent = {i: i for i in sets}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    ids, links = sorted(sets), defaultdict(int)
    for a in ids:
        for b in ids:
            if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                parent[max(root(a), root(b))] = min(root(a), root(b))
    return {i: (len(sets[i]), root(i)) for i in ids}


def found(docs):
    return {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard_join.jaccard_components(docs).collect()}


@pytest.mark.parametrize("shared_from", [20, 2])
def test_like_brute_force(spark, monkeypatch, shared_from):
    monkeypatch.setattr(jaccard_join, "SHARED_FROM", shared_from)
    pick = random.Random(shared_from)
    vocabulary = [f"w{i}" for i in range(300)]
    texts = {}
    for group in range(12):
        base = pick.choices(vocabulary, k=pick.choice([1, 3, 4, 5, 6, 20, 60, 120]))
        for _ in range(pick.choice([1, 2, 12])):
            words = list(base)
            for _ in range(pick.randint(0, 1 + len(words) // 25)):
                words[pick.randrange(len(words))] = pick.choice(vocabulary)
            if pick.random() < 0.3:
                words += texts[0].split()[:30] if texts else []
            texts[len(texts)] = " ".join(words if pick.random() < 0.8 else map(str.upper, words))
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    assert found(docs) == brute(texts)


def test_given_table(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    assert found(docs) == brute({r["doc_id"]: r["text"] for r in docs.collect()})


def test_odd_documents(documents, no_documents):
    rows = jaccard_join.jaccard_components(documents).collect()
    assert len(rows) == documents.count()
    one = {r["doc_id"]: r["component_id"] for r in rows}
    assert [one[i] for i in (20, 21, 22, 23)] == [20] * 4 and one[0] == 0 and one[1] == 1 and one[3] == 3
    assert sorted((r["component_id"] is None, r["n_shingles"]) for r in rows if r["doc_id"] is None) == [(False, 116), (True, 0)]
    assert jaccard_join.jaccard_components(no_documents).collect() == []


def test_chains_and_stars_are_components(spark):
    links = [(i, i + 1) for i in range(60)] + [(100, i) for i in range(101, 140)] + [(200, 201), (201, 200), (300, 300)]
    rows = components.components(spark.createDataFrame(links, "a long, b long"), "a", "b").collect()
    want = {i: 0 for i in range(61)} | {i: 100 for i in range(100, 140)} | {200: 200, 201: 200}
    assert {r["node"]: r["root"] for r in rows} == want and len(rows) == len(want)
    assert components.components(spark.createDataFrame([], "a long, b long"), "a", "b").collect() == []


def test_large_group_of_which_few_link(spark):
    """Copies of one text with edits of their own: similarities lie on both sides of the threshold."""
    pick = random.Random(11)
    base = [f"w{i}" for i in range(140)]
    texts = {}
    for i in range(150):
        words = list(base)
        for k in pick.sample(range(140), pick.choice([1, 2, 3, 3, 4, 4, 5])):
            words[k] = f"x{i}y{k}" if pick.random() < 0.8 else f"x{k}"
        texts[i] = " ".join(words)
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    want = brute(texts)
    assert found(docs) == want
    assert 10 < len({root for _, root in want.values()}) < 150


def test_marks_bound_the_overlap():
    pick = random.Random(3)
    for size in (1, 30, 120, 2000):
        a, b = ({pick.randrange(3 * size) * 0x9E3779B97F4A7C15 % 2**64 for _ in range(size)} for _ in "ab")
        marks = [jaccard_join.parity_marks(np.array(sorted(x), np.uint64)) for x in (a, b)]
        assert len(marks[0]) == len(jaccard_join.MARKS)
        differ = sum(int(x).bit_count() for x in (marks[0] ^ marks[1]).view(np.uint64))
        assert 2 * len(a & b) <= len(a) + len(b) - differ


def test_a_short_text_does_not_pay_for_a_long_list():
    pick = np.random.default_rng(5)
    ordered = np.unique(pick.integers(0, 2**64, 100_000, np.uint64))
    sets = [np.unique(np.append(pick.integers(0, 2**64, 40, np.uint64), pick.choice(ordered, 3))) for _ in range(200)]
    took = []
    for held in (ordered, ordered[:100]):
        began = time.process_time()
        late = [jaccard_join.among(s, held) for s in sets]
        took.append(time.process_time() - began)
        assert all((a == np.isin(s, held)).all() for a, s in zip(late, sets))
    assert took[0] < 10 * took[1] + 0.01  # the sorting test took 0.1 s and more for the long list
    ends = jaccard_join.among(np.array([0, 5, 7, 2**64 - 1], np.uint64), np.array([5, 7], np.uint64))
    assert ends.tolist() == [False, True, True, False]
    assert jaccard_join.among(sets[0], ordered[:0]).tolist() == [False] * len(sets[0])


def test_shared_shingles_are_counted_across_small_batches(spark):
    docs = spark.createDataFrame([(i, f"a b c d e own{i}") for i in range(40)], "doc_id long, text string").coalesce(1)
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, "2")
    try:
        counted = jaccard_join._sets(docs, "text", 5).where("shingle IS NOT NULL").collect()
    finally:
        spark.conf.set(name, before)
    assert [r["shared_by"] for r in counted] == [40]
