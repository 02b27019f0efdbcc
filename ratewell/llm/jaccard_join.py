"""Exact Jaccard join of word-shingle sets by vertical partitioning.

All shingles have one global order: those that many documents share last, else by their
64-bit code. The prefix of a set in that order shares a shingle with every set it can
link to, which gives candidates. Codes are cut into ranges, the fragments; a
pair's overlap is counted per fragment and summed. Equal sets are one class, joined once.

Where many classes share a shingle, they are first compared with the one that shares most; what
is linked then forms a component, and only pairs across components go on. These must meet at the first shingle
they have in common, early enough in both, and the parity marks of their sets must allow the overlap they need before
it is counted. No link is lost: every pair that can link is compared or already connected.

A null text, or one without words, has no shingle and no link. A text of fewer words than a
shingle is one shingle. Repeated rows are documents of one class. A null id takes part and gets
the smallest id of its component. An empty table gives an empty result. Extra columns of the input
are left out.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from typing import NamedTuple

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ratewell.llm.common import WordCodes, giving_back, lower_words, share, shared_value, shingle_set
from ratewell.llm.components import components
from ratewell.scale import join_dimension, settle

SHINGLE_WORDS = 5
FRAGMENTS = 8
#: Length of the list of shared shingles that the order puts last. Any list gives the same links.
SHARED_SHINGLES = 100_000
SHARED_FROM = 20
#: Shingles that a task holds before it counts them, however small its batches are.
COUNTED_SHINGLES = 4_000_000
#: Bits of the parity marks of a set, 64 to a column.
MARK_BITS = 512
MARKS = [f"m{i}" for i in range(MARK_BITS // 64)]


class Threshold(NamedTuple):
    """Link when 100 * intersection >= percent * union."""

    percent: int = 75

    def prefix(self, n: int) -> int:
        """Length of a prefix that no link can avoid: a link needs percent of the larger set."""
        return n - -(-self.percent * n // 100) + 1


def set_class(shingles: np.ndarray) -> int:
    """One signed 64-bit number per distinct set."""
    return xxhash.xxh3_64_intdigest(shingles.tobytes()) - (1 << 63)


def parity_marks(shingles: np.ndarray) -> np.ndarray:
    """Whether an odd number of shingles falls on each of MARK_BITS places.

    Sets differ by a shingle or more wherever their marks differ, which bounds what they have in common.
    """
    odd = np.bincount((shingles % np.uint64(MARK_BITS)).astype(np.int64), minlength=MARK_BITS) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


def among(shingles: np.ndarray, ordered: np.ndarray) -> np.ndarray:
    """Which of the shingles an ascending list holds, by bisection: a short text does not pay for a long list."""
    if not len(ordered):
        return np.zeros(len(shingles), bool)
    return ordered[np.minimum(np.searchsorted(ordered, shingles), len(ordered) - 1)] == shingles


def _sets(docs: DataFrame, text: str, words: int) -> DataFrame:
    """doc_id, n, class and marks of every document, and the shingles that documents of a task share, with counts.

    Rows of the second kind have ``shingle`` set. Counts leave out what one task sees once, so
    they are low for scattered shingles; they only order shingles.
    """
    def measured(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        codes, seen, counts, fresh = WordCodes(), set(), {}, []

        def count() -> None:
            shingle, count = np.unique(np.concatenate([np.empty(0, np.uint64), *fresh]), return_counts=True)
            fresh.clear()
            often = count > 2
            for s, c in zip(shingle[often].tolist(), count[often].tolist()):
                counts[s] = counts.get(s, 0) + c

        for batch in batches:
            sets = [shingle_set(codes.of(lower_words(t)), words) for t in batch["_text"]]
            classes = [set_class(s) for s in sets]
            marks = np.array([parity_marks(s) for s in sets], np.int64).reshape(-1, len(MARKS))
            yield pd.DataFrame({
                "doc_id": batch["doc_id"], "n": [len(s) for s in sets], "class": classes, **dict(zip(MARKS, marks.T)),
            })
            fresh += [s for s, c in zip(sets, classes) if c not in seen]
            seen.update(classes)
            if sum(map(len, fresh)) >= COUNTED_SHINGLES:
                count()
        count()
        yield pd.DataFrame({
            "shingle": np.fromiter(counts, np.uint64, len(counts)).view(np.int64),
            "shared_by": np.fromiter(counts.values(), np.int64, len(counts)),
        })

    names = ["doc_id", "n", "class", *MARKS, "shingle", "shared_by"]

    def complete(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in measured(batches):
            yield frame.reindex(columns=names).astype(dict.fromkeys(names, "Int64"))

    schema = ", ".join(f"{n} long" for n in names)
    return docs.select("doc_id", F.col(text).alias("_text")).mapInPandas(giving_back(complete), schema)


def _postings(docs: DataFrame, text: str, words: int, threshold: Threshold, last: np.ndarray) -> DataFrame:
    """(shingle, class, n, place) for the prefix of every set, once per class and task; ``place`` counts from 0 in the global order."""
    shared = share(docs.sparkSession, last)

    def posted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        codes, seen, last = WordCodes(), set(), shared_value(shared)
        for batch in batches:
            shingles, classes, sizes = [np.empty(0, np.uint64)], [], []
            for t in batch["_text"]:
                s = shingle_set(codes.of(lower_words(t)), words)
                c = set_class(s)
                if c in seen or not len(s):
                    continue
                seen.add(c)
                late = among(s, last)
                prefix = np.concatenate([s[~late], s[late]])[: threshold.prefix(len(s))]
                shingles.append(prefix)
                classes.append((c, len(prefix)))
                sizes.append(len(s))
            lengths = [k for _, k in classes]
            yield pd.DataFrame({
                "shingle": np.concatenate(shingles).view(np.int64),
                "class": np.repeat(np.array([c for c, _ in classes], np.int64), lengths),
                "n": np.repeat(np.array(sizes, np.int32), lengths),
                "place": np.concatenate([np.empty(0, np.int32), *[np.arange(k, dtype=np.int32) for k in lengths]]),
            })

    return docs.select(F.col(text).alias("_text")).mapInPandas(giving_back(posted), "shingle long, class long, n int, place int")


def _met(postings: DataFrame) -> DataFrame:
    """Postings of shingles that two or more classes share, each once; a task sorts its own shingles."""
    def met(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = [b for b in batches if len(b)]
        if held:
            rows = pd.concat(held)
            rows = rows.iloc[np.lexsort((rows["class"], rows["shingle"]))]
            shingle, class_ = rows["shingle"].to_numpy(), rows["class"].to_numpy()
            new = np.append(True, (shingle[1:] != shingle[:-1]) | (class_[1:] != class_[:-1]))
            rows, shingle = rows[new], shingle[new]
            start = np.append(True, shingle[1:] != shingle[:-1])
            group = np.cumsum(start) - 1
            yield rows[np.bincount(group)[group] > 1]

    return postings.repartition("shingle").mapInPandas(giving_back(met), postings.schema)


def _segments(docs: DataFrame, text: str, words: int, fragments: int) -> DataFrame:
    """(class, fragment, segment): each set cut at equal ranges of codes."""
    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        codes = WordCodes()
        bounds = np.array([((i << 64) // fragments) for i in range(1, fragments)], np.uint64)
        for batch in batches:
            rows = []
            for t in batch["_text"]:
                s = shingle_set(codes.of(lower_words(t)), words)
                c = set_class(s)
                rows += [(c, f, part.view(np.int64)) for f, part in enumerate(np.split(s, np.searchsorted(s, bounds))) if len(part)]
            yield pd.DataFrame(rows, columns=["class", "fragment", "segment"])

    return docs.select(F.col(text).alias("_text")).mapInPandas(giving_back(cut), "class long, fragment int, segment array<long>")


def _can_link(threshold: Threshold, na: Column, nb: Column) -> Column:
    return 100 * F.least(na, nb) >= threshold.percent * F.greatest(na, nb)


def _overlap_needed(threshold: Threshold, na: Column, nb: Column) -> Column:
    """Shingles that sets of these sizes must have in common to link."""
    return F.ceil(threshold.percent * (na + nb) / (100 + threshold.percent))


def _shared_needed(threshold: Threshold, na: Column, nb: Column) -> Column:
    """Prefix shingles that sets of these sizes must share to link.

    Of two sets, let the prefix of x end first in the global order. What x has in common with the other
    lies in both prefixes or behind the prefix of x, so their overlap is at most the
    number of shared prefix shingles and the rest of x.
    """
    rest = lambda n: F.ceil(threshold.percent * n / 100) - 1
    return _overlap_needed(threshold, na, nb) - F.greatest(rest(na), rest(nb))


def _alike(pairs: DataFrame, marks: DataFrame, threshold: Threshold) -> DataFrame:
    """Candidate pairs (a, b, na, nb) whose marks allow the overlap they need; ``marks`` has one row per class.

    Sets of n shingles in common and d in one of them alone have na + nb = 2 n + d, and d is at least the number of
    marks that differ. Large sets differ in half of the marks and pass.
    """
    of = lambda x: marks.select(F.col("class").alias(x), *[F.col(m).alias(f"{m}{x}") for m in MARKS])
    differ = reduce(lambda a, b: a + b, [F.bit_count(F.col(f"{m}a").bitwiseXOR(F.col(f"{m}b"))) for m in MARKS])
    na, nb = F.col("na"), F.col("nb")
    return pairs.join(of("a"), "a").join(of("b"), "b").where(
        na + nb - differ >= 2 * _overlap_needed(threshold, na, nb)).select("a", "b", "na", "nb")


def _likely(pairs: DataFrame, met: DataFrame, threshold: Threshold) -> DataFrame:
    """Candidate pairs (a, b, na, nb) whose prefixes share enough."""
    mine = met.select("shingle", F.col("class").alias("a"))
    others = met.select("shingle", F.col("class").alias("b"))
    counted = pairs.join(mine, "a").join(others, ["b", "shingle"]).groupBy("a", "b", "na", "nb").agg(F.count("*").alias("shared"))
    return counted.where(F.col("shared") >= _shared_needed(threshold, F.col("na"), F.col("nb"))).drop("shared")


def _across(met: DataFrame, roots: DataFrame, degree: DataFrame, threshold: Threshold) -> DataFrame:
    """Pairs (a, b, na, nb) of different components that may link.

    The first shingle that two sets have in common has all others behind it in both, so in neither
    it stands later than the overlap they need allows: pairs meet there alone. What is too far from the rest of a
    large group has its own shingles in these first places, and meets nobody of it. A class leaves a bucket where it stands too
    late, or shares too few prefix shingles, for any partner of the sizes in it.
    """
    placed = (
        met.join(degree, "class").join(roots.withColumnRenamed("node", "class"), "class", "left")
        .withColumn("root", F.coalesce("root", "class"))
    )
    buckets = placed.groupBy("shingle").agg(
        F.min("root").alias("low"), F.max("root").alias("high"), F.min("n").alias("least"), F.max("n").alias("most")
    ).where("low != high")
    n, percent = F.col("n"), threshold.percent
    smallest = F.greatest(F.col("least"), F.ceil(percent * n / 100))
    largest = F.least(F.col("most"), F.floor(100 * n / percent))
    # Rising up to equal sizes and falling beyond, so least at the ends; 1 less for rounding in between.
    reach = F.least(_shared_needed(threshold, n, smallest), _shared_needed(threshold, n, largest)) - 1
    early = F.col("place") <= n - _overlap_needed(threshold, n, smallest)
    open_ = settle(placed.join(buckets, "shingle").where(early & (F.col("degree") >= reach)).select(
        "shingle", "class", "n", "place", "degree", "root"))
    side = lambda x: open_.select(
        "shingle", *[F.col(c).alias(f"{c}_{x}") for c in ("class", "n", "place", "degree", "root")])
    na, nb = F.col("n_a"), F.col("n_b")
    common = _overlap_needed(threshold, na, nb)
    left, right = side("a"), side("b")
    meet = (
        (left["shingle"] == right["shingle"]) & (F.col("class_a") < F.col("class_b")) & (F.col("root_a") != F.col("root_b"))
        & _can_link(threshold, na, nb) & (F.least("degree_a", "degree_b") >= _shared_needed(threshold, na, nb))
        & (F.col("place_a") <= na - common) & (F.col("place_b") <= nb - common)
    )
    return left.join(right, meet).select(
        F.col("class_a").alias("a"), F.col("class_b").alias("b"), na.alias("na"), nb.alias("nb")).distinct()


def _links(pairs: DataFrame, source: Source, threshold: Threshold) -> DataFrame:
    """Of the candidate pairs (a, b, na, nb), those that link: partial overlaps per fragment, summed."""
    pairs = settle(pairs)
    classes = pairs.select(F.col("a").alias("class")).unionByName(pairs.select(F.col("b").alias("class"))).distinct()
    wanted = join_dimension(source.first_ids, classes, ["class"]).select("doc_id").distinct()
    segments = settle(_segments(join_dimension(source.docs, wanted, ["doc_id"]), "_text", source.words, source.fragments))
    left = segments.select(F.col("class").alias("a"), "fragment", F.col("segment").alias("sa"))
    right = segments.select(F.col("class").alias("b"), "fragment", F.col("segment").alias("sb"))
    partial = (
        pairs.join(right, "b").join(left, ["a", "fragment"])
        .select("a", "b", "na", "nb", "fragment", F.size(F.array_intersect("sa", "sb")).alias("part"))
    )
    # A class that repeated rows brought twice counts once.
    overlap = (
        partial.groupBy("a", "b", "na", "nb", "fragment").agg(F.max("part").alias("part"))
        .groupBy("a", "b", "na", "nb").agg(F.sum("part").alias("common"))
    )
    union = F.col("na") + F.col("nb") - F.col("common")
    return overlap.where(100 * F.col("common") >= threshold.percent * union).select("a", "b")


class Source(NamedTuple):
    """What a comparison needs: documents, and one id per class."""

    docs: DataFrame
    first_ids: DataFrame
    words: int
    fragments: int


def jaccard_components(
    docs: DataFrame, text: str = "text", words: int = SHINGLE_WORDS, percent: int = 75, fragments: int = FRAGMENTS,
) -> DataFrame:
    """doc_id, n_shingles, n_links (links of the document's class that were counted, 0 if none) and component_id."""
    threshold = Threshold(percent)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(text).alias("_text"))
    sets = settle(_sets(docs, "_text", words))
    members = sets.where(F.col("class").isNotNull()).select("doc_id", F.col("n").alias("n_shingles"), "class")
    often = (
        sets.where(F.col("shingle").isNotNull()).groupBy("shingle").agg(F.sum("shared_by").alias("shared_by"))
        .where(F.col("shared_by") >= SHARED_FROM).orderBy(F.desc("shared_by"), "shingle").limit(SHARED_SHINGLES)
    )
    last = np.sort(np.array([r["shingle"] for r in often.select("shingle").collect()], np.int64).view(np.uint64))
    met = settle(_met(_postings(docs, "_text", words, threshold, last)))

    degree = settle(met.groupBy("class").agg(F.count("*").alias("degree")))
    ranked = met.join(degree, "class")
    center = ranked.groupBy("shingle").agg(F.max(F.struct("degree", "class", "n")).alias("c"))
    na, nb = F.col("c.n"), F.col("n")
    near_enough = _can_link(threshold, na, nb) & (F.least("degree", "c.degree") >= _shared_needed(threshold, na, nb))
    star = settle(
        ranked.join(center, "shingle").where((F.col("class") != F.col("c.class")) & near_enough)
        .select(F.col("c.class").alias("a"), F.col("class").alias("b"), na.alias("na"), nb.alias("nb")).distinct()
    )
    first_ids = sets.where(F.col("class").isNotNull()).groupBy("class").agg(
        F.min("doc_id").alias("doc_id"), *[F.first(m).alias(m) for m in MARKS])
    marks, first_ids = first_ids.select("class", *MARKS), first_ids.select("class", "doc_id")
    source = Source(docs, first_ids, words, fragments)
    links = settle(_links(_likely(_alike(star, marks, threshold), met, threshold), source, threshold))
    roots = components(links, "a", "b")

    tested = star.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    across = _across(met, roots, degree, threshold).join(tested, ["a", "b"], "left_anti")
    more = settle(_links(_alike(across, marks, threshold), source, threshold))
    if not more.isEmpty():
        links = links.unionByName(more)
        roots = components(links, "a", "b")

    ends = links.select(F.col("a").alias("class")).unionByName(links.select(F.col("b").alias("class")))
    n_links = ends.groupBy("class").agg(F.count("*").alias("n_links"))
    per_class = (
        first_ids.join(roots.withColumnRenamed("node", "class"), "class", "left").join(n_links, "class", "left")
        .withColumn("root", F.coalesce("root", "class"))
    )
    per_class = settle(per_class)
    first = per_class.groupBy("root").agg(F.min("doc_id").alias("component_id"))
    per_class = join_dimension(per_class, first, ["root"]).select("class", "component_id", F.coalesce("n_links", F.lit(0)).alias("n_links"))
    linked = join_dimension(members.where("n_shingles > 0"), per_class, ["class"])
    alone = members.where("n_shingles = 0").withColumns({"component_id": F.col("doc_id"), "n_links": F.lit(0).cast("long")})
    columns = ["doc_id", "n_shingles", "n_links", "component_id"]
    return linked.select(*columns).unionByName(alone.select(*columns))
