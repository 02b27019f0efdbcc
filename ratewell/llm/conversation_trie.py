"""Trie of the beginnings that conversations share, from adaptive radix trees over slices of them.

A turn is known by 16 big-endian bytes (MD5 of its role and text), a conversation by the bytes of its turns one after the other.
Equal conversations are one row with their number. The distinct ones are range-partitioned and sorted by their
bytes, so each task holds a slice of the trie from left to right and inserts it into radix trees of at most
``TREE_TURNS`` turns. A tree is walked once; only depths that are whole turns give nodes, also those
inside a compressed path. Nodes that lie neither on the first nor on the last conversation of
their tree have all their members there and are complete. The others, the edges, are summed
per node over all trees, and so are the sums over their subtrees: each edge node gives its own share to one
edge path through it, and shares are added up along the paths. So no conversation's
beginning, however common, is gathered in one task.

Turns go by ``turn``, null first, equal ones by their bytes. A null role or text is empty. Rows without
a conversation id belong to none and are left out. Repeated rows are turns of their own.
An empty table gives an empty result. A conversation is one row of at most about 100 million turns.
Other columns are left out, so their names cannot clash.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ratewell.llm.radix_tree import RadixTree
from ratewell.scale import join_dimension, settle

TURN_BYTES = 16
TREE_TURNS = 100_000
#: Ids per piece of text that goes into a hash of ids.
PIECE_IDS = 1024
WORD = r"[^\x20\x09-\x0D]+"
NO_IDS = hashlib.sha256(b"").hexdigest()


def turn_id(role: Column, text: Column) -> Column:
    """Hex digits of a turn's bytes."""
    role, text = F.coalesce(role, F.lit("")), F.coalesce(text, F.lit(""))
    return F.md5(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text))


def sequences(turns: DataFrame) -> DataFrame:
    """conv_id and ``turns``: its ordered turns as (id, words)."""
    rows = turns.where(F.col("conv_id").isNotNull()).select(
        "conv_id", F.col("turn").isNotNull().alias("known"), "turn", turn_id(F.col("role"), F.col("text")).alias("id"),
        F.regexp_count(F.coalesce(F.col("text"), F.lit("")), F.lit(WORD)).alias("words"))
    return _collected(rows, ["conv_id"])


def _collected(rows: DataFrame, keys: list[str]) -> DataFrame:
    ordered = F.array_sort(F.collect_list(F.struct("known", "turn", "id", "words")))
    return rows.groupBy(*keys).agg(ordered.alias("_rows")).select(
        *keys, F.transform("_rows", lambda t: F.struct(t["id"].alias("id"), t["words"].alias("words"))).alias("turns"))


def with_family_heads(turns: DataFrame, family: int = 20, head: int = 4) -> DataFrame:
    """Conversations as in ``sequences``, their first h turns replaced by those of their family's first conversation.

    The family's first is ``conv_id - conv_id % family`` (of a negative id as in SQL, towards 0), h is the crc32 of the id modulo ``head``. All turns of a family go
    to one partition once; the head is taken there.
    """
    first = (F.col("conv_id") - F.col("conv_id") % family).alias("_family")
    rows = turns.where(F.col("conv_id").isNotNull()).select(
        first, "conv_id", F.col("turn").isNotNull().alias("known"), "turn", turn_id(F.col("role"), F.col("text")).alias("id"),
        F.regexp_count(F.coalesce(F.col("text"), F.lit("")), F.lit(WORD)).alias("words")).repartition("_family")
    own = _collected(rows, ["_family", "conv_id"])
    begun = F.when(F.col("conv_id") == F.col("_family"), F.slice("turns", 1, head - 1))
    h = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % head).cast("int")
    with_head = own.withColumn("_head", F.first(begun, ignorenulls=True).over(Window.partitionBy("_family"))).withColumn("_h", h)
    heads = F.when(F.col("_head").isNull() | (F.col("_h") == 0), F.slice("turns", 1, 0)).otherwise(
        F.slice("_head", F.lit(1), F.col("_h")))
    return with_head.select(
        "conv_id", F.concat(heads, F.slice("turns", F.col("_h") + 1, F.size("turns"))).alias("turns"))


def ids_hashes(rows: DataFrame, key: str, value: str) -> DataFrame:
    """Per key the SHA-256 of its distinct whole numbers, ascending and comma-joined; the hash takes the text piece by piece.

    A piece holds numbers of one interval of ``PIECE_IDS``, so pieces are bounded and a key of very many numbers is spread.
    """
    pieces = rows.groupBy(key, F.floor(F.col(value) / PIECE_IDS).alias("_piece")).agg(
        F.array_sort(F.collect_list(value)).alias("_ids")).select(
            F.col(key).alias("key"), "_piece", F.array_join(F.transform("_ids", lambda i: i.cast("string")), ",").alias("text"))
    ordered = pieces.repartition("key").sortWithinPartitions("key", "_piece").select("key", "text")

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, state = None, None
        for batch in batches:
            keys, hashes = [], []
            for k, text in zip(batch.column("key").to_pylist(), batch.column("text").to_pylist()):
                if k == current:
                    state.update(b"," + text.encode())
                    continue
                if state is not None:
                    keys.append(current)
                    hashes.append(state.hexdigest())
                current, state = k, hashlib.sha256(text.encode())
            yield pa.RecordBatch.from_pydict({"key": pa.array(keys, pa.string()), "ends_sha256": pa.array(hashes, pa.string())})
        if state is not None:
            yield pa.RecordBatch.from_pydict({"key": [current], "ends_sha256": [state.hexdigest()]})

    return ordered.mapInArrow(hashed, "key string, ends_sha256 string").withColumnRenamed("key", key)


def distinct_sequences(conversations: DataFrame) -> DataFrame:
    """Distinct conversations: ``seq`` bytes, ``words`` per turn, number, smallest id, hash of their ids."""
    coded = settle(conversations.select(
        "conv_id", F.unhex(F.array_join(F.transform("turns", lambda t: t["id"]), "")).alias("seq"),
        F.transform("turns", lambda t: t["words"]).alias("words")).withColumn("_key", F.md5("seq")))
    each = coded.groupBy("_key").agg(
        F.first("seq").alias("seq"), F.first("words").alias("words"), F.count(F.lit(1)).alias("n"), F.min("conv_id").alias("conv_id"))
    return each.join(ids_hashes(coded, "_key", "conv_id"), "_key").drop("_key")


class _Turn:
    """A node while it is open: its members so far and what its finished children gave."""

    __slots__ = ("key", "parent", "depth", "words", "n", "conv", "children", "leaves", "saved", "ends", "first", "rows")

    def __init__(self, key: bytes, parent: bytes | None, depth: int, words: int, first: bool):
        self.key, self.parent, self.depth, self.words, self.first = key, parent, depth, words, first
        self.n = self.children = self.leaves = self.saved = 0
        self.conv, self.ends, self.rows = None, None, []


FIELDS = [
    ("kind", pa.int8()), ("key", pa.binary()), ("parent", pa.binary()), ("depth", pa.int64()), ("words", pa.int64()),
    ("conv_id", pa.int64()), ("parent_conv_id", pa.int64()), ("n_convs", pa.int64()), ("n_children", pa.int64()),
    ("n_leaves", pa.int64()), ("saved_tokens", pa.int64()), ("ends_sha256", pa.string()), ("path", pa.int64()),
]
SCHEMA = ("kind tinyint, key binary, parent binary, depth long, words long, conv_id long, parent_conv_id long, n_convs long, "
          "n_children long, n_leaves long, saved_tokens long, ends_sha256 string, path long")
#: Rows of ``tree_nodes``: a whole node, an edge node's part, a step of an edge path.
WHOLE, PART, STEP = 0, 1, 2
ROOT_KEY = hashlib.blake2b(b"", digest_size=16).digest()


def tree_nodes(tree: RadixTree, words: dict[bytes, int], path: int) -> list[list]:
    """Rows of one tree over sorted neighbours; ``path`` and ``path + 1`` number its two edge paths."""
    rows: list[list] = []
    open_nodes = [_Turn(ROOT_KEY, None, 0, 0, True)]
    seen = bytearray()
    closed = False

    def step(node: _Turn, number: int) -> None:
        rows.append([STEP, node.key, None, node.depth, None, None, None, None, None, None, None, None, number])

    def close(last: bool = False) -> None:
        node = open_nodes.pop()
        up = open_nodes[-1] if open_nodes else None
        if up is not None:
            up.n += node.n
            up.conv = node.conv if up.conv is None else min(up.conv, node.conv)
        edge = node.first or last
        if not edge:
            node.leaves += node.children == 0
            node.saved += (node.n - 1) * node.words
            up.children += 1
            up.leaves += node.leaves
            up.saved += node.saved
            up.rows.append(len(rows))
            for i in node.rows:
                rows[i][6] = node.conv
        rows.append([PART if edge else WHOLE, node.key, node.parent, node.depth, node.words, node.conv, None, node.n,
                     node.children, node.leaves, node.saved, node.ends, None])

    for at, piece, value in tree.walk():
        while len(open_nodes) - 1 > at // TURN_BYTES:
            if not closed:
                closed = True
                for node in open_nodes:
                    step(node, path)
            close()
        del seen[at:]
        seen += piece
        for depth in range(at // TURN_BYTES + 1, len(seen) // TURN_BYTES + 1):
            turn = bytes(seen[(depth - 1) * TURN_BYTES : depth * TURN_BYTES])
            up = open_nodes[-1]
            key = hashlib.blake2b(up.key + turn, digest_size=16).digest()
            open_nodes.append(_Turn(key, up.key, depth, words[turn], not closed))
        if value is not None:
            node = open_nodes[-1]
            node.n += value[0]
            node.conv = value[1] if node.conv is None else min(node.conv, value[1])
            node.ends = value[2]
    for node in open_nodes:
        if not closed:
            step(node, path)
        step(node, path + 1)
    while open_nodes:
        close(last=True)
    return rows


def _slices(turns: int):
    def nodes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        path = TaskContext.get().partitionId() << 32
        tree, words, held = RadixTree(), {}, 0
        for batch in batches:
            columns = [batch.column(c) for c in ("seq", "words", "n", "conv_id", "ends_sha256")]
            for seq, counts, n, conv, ends in zip(*columns):
                key = seq.as_py()
                for i, count in enumerate(counts.as_py()):
                    words[key[i * TURN_BYTES : (i + 1) * TURN_BYTES]] = count
                tree.insert(key, (n.as_py(), conv.as_py(), ends.as_py()))
                held += 1 + len(key) // TURN_BYTES
                if held >= turns:
                    yield from _arrow(tree_nodes(tree, words, path))
                    tree, words, held, path = RadixTree(), {}, 0, path + 2
        if held:
            yield from _arrow(tree_nodes(tree, words, path))
    return nodes


def _arrow(rows: list[list]) -> Iterator[pa.RecordBatch]:
    for at in range(0, len(rows), 10_000):
        columns = zip(*rows[at : at + 10_000])
        yield pa.RecordBatch.from_arrays(
            [pa.array(c, kind) for c, (_, kind) in zip(columns, FIELDS)], names=[name for name, _ in FIELDS])


def prefix_nodes(conversations: DataFrame, tree_turns: int = TREE_TURNS) -> DataFrame:
    """Nodes of the trie over conversations (conv_id, turns): one row per distinct beginning."""
    distinct = settle(distinct_sequences(conversations))
    rows = settle(distinct.repartitionByRange("seq").sortWithinPartitions("seq").mapInArrow(_slices(tree_turns), SCHEMA))
    whole = rows.where(F.col("kind") == WHOLE)
    parts = rows.where(F.col("kind") == PART).groupBy("key").agg(
        F.first("parent").alias("parent"), F.first("depth").alias("depth"), F.first("words").alias("words"),
        F.min("conv_id").alias("conv_id"), F.max("ends_sha256").alias("ends_sha256"),
        *[F.sum(c).alias(c) for c in ("n_convs", "n_children", "n_leaves", "saved_tokens")])
    steps = rows.where(F.col("kind") == STEP).select("key", "depth", "path")
    parts = settle(parts.join(steps.groupBy("key").agg(F.min("path").alias("_owner")), "key"))
    # An edge node's children that are edges themselves were left out of its parts, and so was the node in its sums.
    edge_children = parts.where(F.col("parent").isNotNull()).groupBy("parent").agg(F.count(F.lit(1)).alias("_more"))
    edges = parts.join(edge_children.withColumnRenamed("parent", "key"), "key", "left").withColumn(
        "n_children", F.col("n_children") + F.coalesce("_more", F.lit(0))).withColumns({
            "n_leaves": F.col("n_leaves") + (F.col("n_children") == 0).cast("long"),
            "saved_tokens": F.col("saved_tokens") + (F.col("n_convs") - 1) * F.col("words")})
    edges = settle(edges.drop("_more", "words"))
    below = Window.partitionBy("path").orderBy(F.col("depth").desc()).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    own = F.col("path") == F.col("_owner")
    along = steps.join(edges.select("key", "_owner", "n_leaves", "saved_tokens"), "key").select(
        "key", *[F.sum(F.when(own, F.col(c)).otherwise(0)).over(below).alias(c) for c in ("n_leaves", "saved_tokens")])
    sums = along.groupBy("key").agg(F.sum("n_leaves").alias("n_leaves"), F.sum("saved_tokens").alias("saved_tokens"))
    edges = settle(edges.drop("n_leaves", "saved_tokens", "_owner").join(sums, "key").withColumn(
        "parent_conv_id", F.lit(None).cast("long")))
    columns = ["parent", "depth", "conv_id", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    nodes = whole.select(*columns).unionByName(edges.select(*columns))
    inner = nodes.where(F.col("parent_conv_id").isNotNull() | F.col("parent").isNull())
    at_edge = nodes.where(F.col("parent_conv_id").isNull() & F.col("parent").isNotNull()).drop("parent_conv_id")
    parents = edges.select(F.col("key").alias("parent"), F.col("conv_id").alias("parent_conv_id"))
    joined = join_dimension(at_edge, parents, ["parent"], settled=True)
    return inner.unionByName(joined.select(*columns)).withColumn(
        "ends_sha256", F.coalesce("ends_sha256", F.lit(NO_IDS))).drop("parent")
