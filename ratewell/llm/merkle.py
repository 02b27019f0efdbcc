"""Content-addressed Merkle manifest of a table, with proofs found by descent from the root.

Every row is a leaf, the hash of its fields. Per tree (a source) the leaves ascend by their order
columns; each run of ``FAN`` neighbours becomes one node, the hash of its children's digests, until one
node is left, the subroot. The subroots, ordered by their tree, become one root in the same way.
The manifest keeps only digest -> children records, one table per height.

A proof is found without touching other leaves: requests for leaves go down from the root, one
digit of the leaf's rank per height. Requests with the same digits so far are one row. At each node the
digit picks the child, the others are collected as one segment of the path, and the child's
record is looked up by its digest. Reversed, the segments lead from the leaf to the root.

Ranks come from a range shuffle on (tree, order): a tree of any size lies in many slices, and only
counts per slice and tree are summed. No node has more than ``FAN`` children, so no step gathers a group that grows.

Fields may be null (``-`` in the hash); a null tree is a tree of its own and comes first, as do null
order values. Empty and long texts are hashed whole. Rows that are equal in their order columns go by their
digest; equal rows are leaves of their own with equal digests. A tree of one row has that leaf as its subroot.
An empty table has no root and gives no proofs. Columns that are not asked for are left out, so their names cannot clash.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ratewell.scale import join_dimension, match_keys, settle

FAN = 16
ALL = "_all"


def hash_of(text: Column) -> Column:
    return F.sha2(text, 256)


def leaf_hash(fields: list[Column]) -> Column:
    """Hash of the fields one after the other: ``-`` for null, else byte count, ``:``, value."""
    def part(value: Column) -> Column:
        text = value.cast("string")
        return F.when(value.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))
    return hash_of(F.concat(*map(part, fields)))


class Trees(NamedTuple):
    """Leaves with their ranks, records per height from 1 up, and one root per tree.

    ``leaves``: tree, rank, digest, further columns. ``records[h - 1]``: digest, children.
    ``roots``: tree, digest, height.
    """

    tree: str
    leaves: DataFrame
    records: list[DataFrame]
    roots: DataFrame


class Manifest(NamedTuple):
    """All trees, the tree over their subroots, and the root digest (None for an empty table)."""

    trees: Trees
    top: Trees
    root: str | None

    def records(self) -> DataFrame:
        """The stored table: digest, children."""
        tables = [*self.trees.records, *self.top.records]
        table = self.trees.roots.sparkSession.createDataFrame([], "digest string, children array<string>")
        for each in tables:
            table = table.unionByName(each)
        return table.dropDuplicates(["digest"])


def ranked(rows: DataFrame, tree: str, order: list[str]) -> tuple[DataFrame, DataFrame]:
    """Rows with ``rank`` from 0 in their tree, and the trees with their ``size``; both settled.

    A slice is a sorted range of rows, so a row's rank is its place in the slice, counted from the
    slice's first row of the tree, and the rows of the tree in slices before.
    """
    sort = [tree, *order]
    spread = settle(rows.repartitionByRange(*sort).sortWithinPartitions(*sort)
                    .withColumn("_pos", F.monotonically_increasing_id())
                    .withColumn("_slice", F.shiftright("_pos", 33)))
    counts = settle(spread.groupBy(tree, "_slice").agg(F.count(F.lit(1)).alias("_n"), F.min("_pos").alias("_first")))
    before = Window.partitionBy(tree).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select(tree, "_slice", "_first", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    placed = join_dimension(spread, starts, [tree, "_slice"]).withColumn("rank", F.col("_before") + F.col("_pos") - F.col("_first"))
    sizes = settle(counts.groupBy(tree).agg(F.sum("_n").alias("size")))
    return settle(placed.drop("_pos", "_slice", "_first", "_before")), sizes


def grow(rows: DataFrame, tree: str, order: list[str], fan: int = FAN) -> Trees:
    """Trees over rows with a ``digest``: one pass per height over a table ``fan`` times smaller each time."""
    leaves, sizes = ranked(rows, tree, [*order, "digest"])
    largest = sizes.agg(F.max("size")).first()[0] or 0
    nodes = join_dimension(leaves.select(tree, F.col("rank").alias("place"), "digest"), sizes, [tree], settled=True)
    records, roots, height = [], [], 0
    while largest > 0:
        roots.append(nodes.where("size = 1").select(tree, "digest", F.lit(height).alias("height")))
        if largest == 1:
            break
        runs = nodes.where("size > 1").groupBy(tree, F.expr(f"place div {fan}").alias("place")).agg(
            F.array_sort(F.collect_list(F.struct("place", "digest"))).alias("_run"),
            F.expr(f"(max(size) + {fan - 1}) div {fan}").alias("size"))
        children = F.transform("_run", lambda child: child["digest"])
        nodes = settle(runs.withColumn("children", children).drop("_run").withColumn(
            "digest", hash_of(F.array_join("children", ""))))
        records.append(nodes.select("digest", "children"))
        height, largest = height + 1, -(-largest // fan)
    found = rows.select(tree, "digest", F.lit(0).alias("height")).limit(0)
    for each in roots:
        found = found.unionByName(each)
    return Trees(tree, leaves, records, settle(found))


def manifest(rows: DataFrame, tree: str, order: list[str]) -> Manifest:
    """Manifest of rows that have a ``digest``; their other columns stay with the leaves."""
    trees = grow(rows, tree, order)
    top = grow(trees.roots.select(F.lit(0).alias(ALL), tree, "digest", "height"), ALL, [tree])
    root = top.roots.first()
    return Manifest(trees, top, None if root is None else root["digest"])


def _descend(trees: Trees, requests: DataFrame, roots: DataFrame, keep: list[str], fan: int) -> DataFrame:
    """Requests (tree, rank, ...) with ``digest`` of their leaf and their ``path`` lengthened down to it.

    ``roots``: tree, digest, height, path so far and the columns of ``keep``, which go along.
    """
    tree, held = trees.tree, [*keep, "path"]
    heights = len(trees.records)
    # Requests that share their digits down to a height are one row there: each height from the one below.
    asked = [None, requests.select(tree, F.expr(f"rank div {fan}").alias("place")).distinct()]
    for _ in range(2, heights):
        asked.append(asked[-1].select(tree, F.expr(f"place div {fan}").alias("place")).distinct())
    frontier = None
    for height in range(heights, 0, -1):
        start = roots.where(F.col("height") == height).select(tree, F.lit(0).cast("long").alias("place"), "digest", *held)
        if frontier is not None:
            up = frontier.withColumnRenamed("place", "_up")
            steps = match_keys(asked[height].withColumn("_up", F.expr(f"place div {fan}")), up, [tree, "_up"], "inner")
            start = start.unionByName(_step(steps, F.expr(f"place % {fan}")).select(tree, "place", "digest", *held))
        store = trees.records[height - 1].dropDuplicates(["digest"])
        frontier = settle(start.join(store, "digest").drop("digest"))
    alone = roots.where("height = 0").select(tree, "digest", *held)
    found = match_keys(requests, alone, [tree], "inner")
    if frontier is None:
        return found
    last = requests.withColumn("_up", F.expr(f"rank div {fan}"))
    reached = _step(match_keys(last, frontier.withColumnRenamed("place", "_up"), [tree, "_up"], "inner"), F.expr(f"rank % {fan}"))
    return found.unionByName(reached.select(*found.columns))


def _step(rows: DataFrame, digit: Column) -> DataFrame:
    """One node down: the digit's child becomes ``digest``, the others a segment of the path."""
    children = F.col("children")
    before = F.array_join(F.slice(children, F.lit(1), digit.cast("int")), "")
    after = F.array_join(F.slice(children, digit.cast("int") + 2, F.size(children)), "")
    return rows.withColumns({
        "digest": F.element_at(children, digit.cast("int") + 1),
        "path": F.concat("path", F.array(F.struct(before.alias("before"), after.alias("after")))),
    }).drop("children")


def proofs(made: Manifest, requests: DataFrame, fan: int = FAN) -> DataFrame:
    """Requests (tree, rank, further columns) with ``digest``, ``subroot`` and the ``path`` from leaf to root.

    A segment of the path holds the digests of the siblings ``before`` and ``after``, as text without gaps.
    """
    tree = made.trees.tree
    empty = F.array().cast("array<struct<before: string, after: string>>")
    start = made.top.roots.withColumn("path", empty)
    sources = made.top.leaves.select(ALL, "rank", tree, F.col("digest").alias("subroot"), F.col("height").alias("_height"))
    subroots = settle(_descend(made.top, sources, start, [], fan))
    roots = subroots.select(tree, "digest", F.col("_height").alias("height"), "path", "subroot")
    found = _descend(made.trees, requests, roots, ["subroot"], fan)
    return found.withColumn("path", F.reverse("path"))


def folded(leaf: Column, path: Column) -> Column:
    """Root digest from a leaf digest and the path of its proof."""
    return F.aggregate(path, leaf, lambda below, step: hash_of(F.concat(step["before"], below, step["after"])))


def proof_hash(path: Column) -> Column:
    """Hash of all siblings of a path, from the leaf up, left to right."""
    return hash_of(F.array_join(F.transform(path, lambda step: F.concat(step["before"], step["after"])), ""))


def document_manifest(docs: DataFrame, tampered: Column) -> DataFrame:
    """Manifest of documents by source, and the check of every leaf where ``tampered`` rows come with A-Z lower-cased."""
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    fields = [F.col(c) for c in ("doc_id", "source", "lang", "n_chars")]
    leaf = leaf_hash([*fields, F.col("text")])
    changed = leaf_hash([*fields, F.translate("text", upper, lower)])
    rows = settle(docs.select("doc_id", "source", leaf.alias("digest"), F.when(tampered, changed).alias("_seen")))
    made = manifest(rows, "source", ["doc_id"])
    requests = made.trees.leaves.select("source", "rank", "doc_id", F.coalesce("_seen", "digest").alias("_seen"))
    found = proofs(made, requests).withColumn("folded_root", folded(F.col("_seen"), F.col("path")))
    root = F.lit(made.root).cast("string")
    return found.select(
        "doc_id", F.col("digest").alias("leaf"), "subroot", root.alias("root"),
        proof_hash(F.col("path")).alias("proof_sha256"), "folded_root", (F.col("folded_root") == root).alias("verified"))
