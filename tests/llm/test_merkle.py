"""The manifest against a plain recursive tree."""

import hashlib
import zlib

from pyspark.sql import functions as F

from ratewell.llm import merkle
from ratewell.llm.common import held_out

COLUMNS = ["doc_id", "source", "lang", "n_chars", "text"]


def hashed(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def field(value):
    return "-" if value is None else f"{len(str(value).encode())}:{value}"


def tree(leaves):
    levels = [leaves]
    while len(levels[-1]) > 1:
        levels.append([hashed(*levels[-1][i : i + 16]) for i in range(0, len(levels[-1]), 16)])
    return levels


def path(levels, i):
    for level in levels[:-1]:
        run, digit = level[i // 16 * 16 : i // 16 * 16 + 16], i % 16
        yield "".join(run[:digit]), "".join(run[digit + 1 :])
        i //= 16


def brute(docs):
    by = {}
    for d in docs:
        by.setdefault(d[1], []).append((d[0] is not None, d[0] or 0, hashed(*map(field, d)), d))
    keys = sorted(by, key=lambda k: (k is not None, (k or "").encode()))
    groups = {k: sorted(by[k], key=lambda r: r[:3]) for k in keys}
    trees = {k: tree([r[2] for r in groups[k]]) for k in keys}
    top = tree([trees[k][-1][0] for k in keys])
    for j, k in enumerate(keys):
        for i, (_, _, leaf, d) in enumerate(groups[k]):
            steps, seen = [*path(trees[k], i), *path(top, j)], leaf
            if d[0] is not None and d[4] is not None and zlib.crc32(str(d[0]).encode()) % 5 == 0:
                seen = hashed(*map(field, (*d[:4], "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in d[4]))))
            folded = seen
            for before, after in steps:
                folded = hashed(before, folded, after)
            yield (d[0], leaf, trees[k][-1][0], top[-1][0], hashed(*[b + a for b, a in steps]), folded, folded == top[-1][0])


def frame(spark, rows):
    schema = "doc_id long, source string, lang string, n_chars long, text string, digest string, rank long, path string, _pos long"
    return spark.createDataFrame([(*r, "x", 7, "y", 3) for r in rows], schema)


def held(spark, rows):
    found = merkle.document_manifest(frame(spark, rows), held_out(F.col("doc_id"), 5, 0)).collect()
    key = lambda r: tuple((v is not None, v) for v in r)
    return sorted(map(tuple, found), key=key), sorted(brute(rows), key=key)


def test_sizes_around_the_fan(spark):
    rows = [(i, f"s{n}", "en", i % 7, f"Text {i} Ünï") for n in (1, 2, 15, 16, 17, 33, 257) for i in range(n)]
    found, expected = held(spark, rows)
    assert found == expected


def test_many_sources_of_one_document(spark):
    found, expected = held(spark, [(i, f"s{i:03d}", None, None, "A b") for i in range(300)])
    assert found == expected


def test_odd_rows(spark):
    rows = [(None, None, None, None, None), (None, "", "", 0, ""), (3, None, "en", 1, "ABC"), (3, None, "en", 1, "ABC"),
            (3, None, "en", 1, "other"), (-5, "ü", "de", 2, "Ä" * 9000), (10, "ü", "de", 2, " \n"), (12, "-", None, 3, "WORD " * 4000)]
    rows += [(20, "copies", "en", 5, "Same")] * 40
    found, expected = held(spark, rows)
    assert found == expected


def test_no_rows(spark):
    empty = frame(spark, [(1, "a", "b", 1, "c")]).limit(0)
    assert merkle.document_manifest(empty, held_out(F.col("doc_id"), 5, 0)).collect() == []


def test_a_few_requests(spark):
    rows = [(i, f"s{i % 2}", "en", 1, f"text {i}") for i in range(600)]
    leaves = frame(spark, rows).select("source", "doc_id", merkle.leaf_hash([F.col(c) for c in COLUMNS]).alias("digest"))
    made = merkle.manifest(leaves, "source", ["doc_id"])
    asked = spark.createDataFrame([("s0", 0, "first"), ("s1", 299, "last"), ("s1", 17, "mid")], "source string, rank long, name string")
    found = merkle.proofs(made, asked).withColumn("root", merkle.folded(F.col("digest"), F.col("path"))).collect()
    assert {r["name"] for r in found} == {"first", "last", "mid"}
    assert all(r["root"] == made.root for r in found)
    records = {r["digest"]: r["children"] for r in made.records().collect()}
    assert all(hashed(*children) == digest for digest, children in records.items())
    reached, frontier = set(), [made.root]
    while frontier:
        digest = frontier.pop()
        frontier += records.get(digest, [])
        reached |= set() if digest in records else {digest}
    assert len(reached) == 600


def test_only_changed_texts_fail(spark):
    rows = [(i, "s", "en", 1, ("Upper", "lower")[i % 2]) for i in range(200)]
    found = merkle.document_manifest(frame(spark, rows), held_out(F.col("doc_id"), 5, 0)).collect()
    changed = [i for i in range(0, 200, 2) if zlib.crc32(str(i).encode()) % 5 == 0]
    assert sorted(r["doc_id"] for r in found if not r["verified"]) == changed
