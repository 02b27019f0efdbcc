import hashlib
import random

import pytest

from ratewell.llm import simhash


def ham(a, b):
    return bin(int(a, 16) ^ int(b, 16)).count("1")


def check(docs, radius=4):
    """Against brute force over all rows in (id, text hash) order; ids must be unique."""
    rows = {r["doc_id"]: r for r in simhash.simhash(docs, radius=radius).collect()}
    texts = {r["doc_id"]: r["text"] or "" for r in docs.collect()}
    order = sorted(texts, key=lambda i: (i is not None, i), reverse=True)
    assert set(rows) == set(texts)
    for at, i in enumerate(order):
        text, after = texts[i], order[(at + 1) % len(order)]
        half = len(text) // 2
        edited = text[: len(text) - half] + texts[after][:half]
        r = rows[i]
        assert r["n_chars"] == len(text)
        assert r["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
        assert r["near_next"] == pytest.approx(1 - ham(r["fingerprint"], rows[after]["fingerprint"]) / 128)
        assert r["near_edited"] == pytest.approx(1 - ham(r["fingerprint"], r["edited_fingerprint"]) / 128)
        for j in texts:
            assert (texts[j] == text) <= (rows[j]["fingerprint"] == r["fingerprint"])
        if i is not None and i % 100 == 0:
            assert r["n_near"] == sum(ham(r["fingerprint"], o["fingerprint"]) <= radius for o in rows.values()) - 1
        else:
            assert r["n_near"] is None
    return rows


def test_given_table(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = check(docs)
    assert sum(r["near_edited"] > r["near_next"] for r in rows.values()) > 0.9 * len(rows)


def test_many_buckets_scattered_ids(spark, monkeypatch):
    monkeypatch.setattr(simhash, "BUCKET_ROWS", 3)
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").limit(40)
    check(docs.selectExpr("doc_id * doc_id * 1000003 - 5000000000 AS doc_id", "text"))


def test_odd_documents(documents, no_documents):
    rows = simhash.simhash(documents).collect()
    assert len(rows) == documents.count()
    check(documents.where("doc_id IS NOT NULL").dropDuplicates(["doc_id"]))
    assert simhash.simhash(no_documents).collect() == []


@pytest.mark.parametrize("radius", [0, 2, 5])
def test_block_tables_find_all_within_the_radius(spark, radius):
    pick = random.Random(radius)
    seeds = [pick.getrandbits(128) for _ in range(4)]
    prints = {s ^ sum(1 << b for b in pick.sample(range(128), pick.randint(0, 7))) for s in seeds for _ in range(40)}
    pair = lambda v: tuple(x - (1 << 64) if x >> 63 else x for x in (v >> 64, v & (1 << 64) - 1))
    all_ = spark.createDataFrame([pair(p) for p in prints], "f1 long, f2 long")
    queries = spark.createDataFrame([pair(s) for s in seeds], "q1 long, q2 long")
    got = sorted((r["q1"], r["q2"], r["f1"], r["f2"], r["distance"]) for r in simhash.nearby(queries, all_, radius).collect())
    want = sorted((*pair(s), *pair(p), bin(s ^ p).count("1")) for s in seeds for p in prints if bin(s ^ p).count("1") <= radius)
    assert got == want
