"""SimHash: weighted hashes of five-word terms vote on signed bits; block tables search by radius.

Every occurrence of a term votes, so a term's weight is its frequency. A term is five
neighbouring words in lower case (a shorter text is one term); its two 64-bit hashes give
128 votes, and a bit is set where more than half of the votes are. Votes of 32 bit pairs are summed as two
32-bit lanes of one long.

``nearby`` finds all fingerprints within a Hamming radius: two of them agree in at least
``BLOCKS - radius`` of the blocks, so each choice of that many blocks is a table of permuted keys in
which such a pair meets; a pair counts in the first table where it does.

All steps are DataFrame expressions. Null texts count as empty; a text without words has fingerprint
0. Rows of equal id follow each other by a hash of their text, so repeated rows are neighbours of
their own; null ids come last. An empty table gives an empty result. Columns of the input
besides id and text are left out, so their names cannot clash.
"""

from __future__ import annotations

import math
from functools import reduce
from itertools import combinations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ratewell.scale import settle

BITS = 128
WORDS = 5
BLOCKS = 6
BLOCK_STARTS = (0, 21, 42, 64)
BUCKET_ROWS = 2000
MAX_BUCKETS = 65_536


def words(text: Column) -> Column:
    """Words ``[^\\x20\\x09-\\x0D]+`` in lower case."""
    return F.array_remove(F.split(F.lower(text), "[\\x20\\x09-\\x0D]+"), "")


def terms(words: str) -> Column:
    """Runs of WORDS neighbouring words as structs; one run if there are fewer words."""
    n = F.size(words)
    parts = [F.col(words), *[F.slice(words, i + 1, n) for i in range(1, WORDS)]]
    count = F.greatest(n - (WORDS - 1), F.least(n, F.lit(1)))
    return F.slice(F.arrays_zip(*[p.alias(f"w{i}") for i, p in enumerate(parts)]), F.lit(1), count)


def _votes(hashed: str, out: str) -> list[Column]:
    lanes = 0x0000000100000001
    return [
        F.coalesce(F.sum(F.shiftright(hashed, i).bitwiseAND(F.lit(lanes))), F.lit(0)).alias(f"{out}{i}") for i in range(32)
    ]


def _signs(votes: str, count: str) -> Column:
    """The 64 bits that have more than half of the votes."""
    bits = []
    for i in range(32):
        low = F.col(f"{votes}{i}").bitwiseAND(F.lit(0xFFFFFFFF))
        high = F.shiftrightunsigned(F.col(f"{votes}{i}"), 32)
        bits.append(F.when(2 * low > F.col(count), F.lit(1 << i)).otherwise(F.lit(0).cast("long")))
        top = (1 << (i + 32)) - (1 << 64 if i == 31 else 0)
        bits.append(F.when(2 * high > F.col(count), F.lit(top).cast("long")).otherwise(F.lit(0).cast("long")))
    return reduce(lambda a, b: a.bitwiseOR(b), bits)


def fingerprints(rows: DataFrame, keys: list[str], text: str) -> DataFrame:
    """``keys`` with ``f1`` and ``f2``, the fingerprint of each text; ``keys`` must tell rows apart.

    Where ``rows`` are partitioned by some of the keys, no exchange is needed.
    """
    split = rows.select(*keys, words(F.col(text)).alias("_words"))
    each = split.select(*keys, F.explode_outer(terms("_words")).alias("_term"))
    term = [F.col("_term").getField(name) for name in each.schema["_term"].dataType.fieldNames()]
    hashed = each.select(
        *keys, F.when(F.col("_term").isNotNull(), F.xxhash64(*term)).alias("_h1"),
        F.when(F.col("_term").isNotNull(), F.xxhash64(F.lit(1), *term)).alias("_h2"),
    )
    counted = hashed.groupBy(*keys).agg(F.count("_h1").alias("_n"), *_votes("_h1", "_a"), *_votes("_h2", "_b"))
    return counted.select(*keys, _signs("_a", "_n").alias("f1"), _signs("_b", "_n").alias("f2"))


def as_text(f1: str, f2: str) -> Column:
    return F.lower(F.concat(*[F.lpad(F.hex(f), 16, "0") for f in (f1, f2)]))


def distance(f1: Column, f2: Column, g1: Column, g2: Column) -> Column:
    return F.bit_count(f1.bitwiseXOR(g1)) + F.bit_count(f2.bitwiseXOR(g2))


def in_order(docs: DataFrame, text: str = "text") -> DataFrame:
    """Rows in buckets of neighbouring ids, each followed by its successor in descending order.

    Gives bucket, place, guest, doc_id, text and next_text. A bucket is a range of ids of equal width,
    about BUCKET_ROWS rows where ids are dense; at its end stands a guest, the first row of the
    bucket below (of the highest for the lowest). One guest per bucket and at most MAX_BUCKETS
    buckets bound what is fetched and broadcast.
    """
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    low, high, rows = base.agg(F.min("doc_id"), F.max("doc_id"), F.count("*")).first()
    low, high = (0, 0) if low is None else (low, high)
    buckets = max(1, min(MAX_BUCKETS, math.ceil(rows / BUCKET_ROWS)))
    width = -(-(high - low + 1) // buckets)
    bucket = F.expr(f"coalesce(cast((cast(doc_id as decimal(20, 0)) - {low}) div {width} as bigint), -1L)")
    base = base.withColumns({"bucket": bucket, "digest": F.xxhash64("text")})
    first = sorted(
        (row["bucket"], row["first"]["doc_id"], row["first"]["digest"])
        for row in base.groupBy("bucket").agg(F.max(F.struct("doc_id", "digest")).alias("first")).collect()
    )
    guests = docs.sparkSession.createDataFrame(
        [(doc_id, digest, first[(i + 1) % len(first)][0]) for i, (_, doc_id, digest) in enumerate(first)],
        "guest_id long, guest_digest long, target long",
    )
    visiting = base.join(
        F.broadcast(guests), base["doc_id"].eqNullSafe(guests["guest_id"]) & (base["digest"] == guests["guest_digest"])
    ).select("doc_id", "text", F.col("target").alias("bucket"), "digest", F.lit(True).alias("guest"))
    order = Window.partitionBy("bucket").orderBy("guest", F.desc_nulls_last("doc_id"), F.desc("digest"))
    return (
        base.withColumn("guest", F.lit(False)).unionByName(visiting)
        .select(
            "bucket", F.row_number().over(order).alias("place"), "guest", "doc_id", "text",
            F.lead("text").over(order).alias("next_text"),
        )
    )


def edited_documents(docs: DataFrame, text: str = "text") -> DataFrame:
    """Per row of ``docs``: doc_id, n_chars, edited_sha256 and the fingerprints (two longs each) of the
    text, of its edited text and of the next document's text, in descending order of doc_id.

    The edited text has its last floor(n_chars / 2) code points replaced by as many of the next document's first.
    """
    n = F.length("text")
    half = F.floor(n / 2).cast("int")
    edited = F.concat(F.substring("text", F.lit(1), n - half), F.substring(F.coalesce("next_text", F.lit("")), F.lit(1), half))
    rows = in_order(docs, text).select("bucket", "place", "guest", "doc_id", n.cast("long").alias("n_chars"), "text", edited.alias("edited"))
    rows = rows.withColumn("edited_sha256", F.sha2("edited", 256))
    keys = ["bucket", "place", "guest", "doc_id", "n_chars", "edited_sha256"]
    versions = F.array(*[F.struct(F.lit(i).alias("version"), F.col(c).alias("text")) for i, c in enumerate(("text", "edited"))])
    both = rows.select(*keys, F.explode(versions).alias("v")).select(*keys, "v.version", "v.text")
    found = fingerprints(both, [*keys, "version"], "text")
    one = found.groupBy(*keys).agg(*[
        F.max(F.when(F.col("version") == i, F.col(f))).alias(f"{name}{f[1]}")
        for i, name in enumerate(("f", "e")) for f in ("f1", "f2")
    ])
    order = Window.partitionBy("bucket").orderBy("place")
    return one.withColumns({"n1": F.lead("f1").over(order), "n2": F.lead("f2").over(order)}).where(~F.col("guest")).select(
        "doc_id", "n_chars", "edited_sha256", "f1", "f2", "e1", "e2", "n1", "n2"
    )


def _blocks(f1: str, f2: str) -> list[Column]:
    return [
        F.shiftrightunsigned(F.col(f), a).bitwiseAND(F.lit((1 << (b - a)) - 1))
        for f in (f1, f2) for a, b in zip(BLOCK_STARTS, BLOCK_STARTS[1:])
    ]


def nearby(queries: DataFrame, all_prints: DataFrame, radius: int) -> DataFrame:
    """Pairs (q1, q2, f1, f2, distance) of distinct query fingerprints and all distinct ones within ``radius``.

    ``queries`` has distinct (q1, q2), ``all_prints`` distinct (f1, f2).
    """
    if not 0 <= radius < BLOCKS:
        raise ValueError(f"radius must be from 0 to {BLOCKS - 1}")
    choices = list(combinations(range(BLOCKS), BLOCKS - radius))

    def tables(rows: DataFrame, a: str, b: str, table: str, key: str) -> DataFrame:
        blocks = _blocks(a, b)
        entries = [F.struct(F.lit(t).alias("t"), F.xxhash64(*[blocks[i] for i in c]).alias("k")) for t, c in enumerate(choices)]
        return rows.withColumn("_e", F.explode(F.array(*entries))).select(
            a, b, F.col("_e.t").alias(table), F.col("_e.k").alias(key)
        )

    asked, there = tables(queries.select("q1", "q2"), "q1", "q2", "qt", "qk"), tables(all_prints.select("f1", "f2"), "f1", "f2", "ft", "fk")
    same = [q == f for q, f in zip(_blocks("q1", "q2"), _blocks("f1", "f2"))]
    first = F.lit(None).cast("int")
    for t, choice in reversed(list(enumerate(choices))):
        first = F.when(reduce(lambda a, b: a & b, [same[i] for i in choice]), t).otherwise(first)
    apart = distance(F.col("q1"), F.col("q2"), F.col("f1"), F.col("f2"))
    meet = (F.col("qt") == F.col("ft")) & (F.col("qk") == F.col("fk")) & (apart <= radius) & (first == F.col("qt"))
    return asked.join(there, meet).select("q1", "q2", "f1", "f2", apart.alias("distance"))


def simhash(docs: DataFrame, text: str = "text", radius: int = 4) -> DataFrame:
    """Fingerprints, likenesses and, for ids divisible by 100, ``n_near``: other documents within ``radius`` bits.

    Copies share a fingerprint and are counted, not paired. By theory 4 bits are a cosine of 0.995 between term counts, about one
    changed word in 1,000; texts with a Jaccard similarity of 0.75 are about 22 bits apart and not counted.
    """
    found = settle(edited_documents(docs, text))
    prints = found.groupBy("f1", "f2").agg(F.count("*").alias("n_docs"))
    asks = F.coalesce(F.col("doc_id") % 100 == 0, F.lit(False))
    asked = found.where(asks).select(F.col("f1").alias("q1"), F.col("f2").alias("q2")).distinct()
    counts = (
        nearby(asked, prints, radius).join(prints, ["f1", "f2"])
        .groupBy("q1", "q2").agg((F.sum("n_docs") - 1).alias("n_near"))
    )
    answered = found.where(asks).join(counts, (F.col("f1") == F.col("q1")) & (F.col("f2") == F.col("q2")), "left").drop("q1", "q2")
    rest = found.where(~asks).withColumn("n_near", F.lit(None).cast("long"))
    alike = lambda a, b: 1 - distance(F.col("f1"), F.col("f2"), F.col(a), F.col(b)) / BITS
    return answered.unionByName(rest).select(
        "doc_id", "n_chars", "edited_sha256", as_text("f1", "f2").alias("fingerprint"),
        as_text("e1", "e2").alias("edited_fingerprint"), alike("e1", "e2").alias("near_edited"),
        alike("n1", "n2").alias("near_next"), "n_near",
    )
