"""The radix tree against a dict, the trie against plain prefixes."""

import hashlib
import math
import random
import re
import zlib

import pytest

from ratewell.llm import conversation_trie
from ratewell.llm.radix_tree import RadixTree, shared_length

SCHEMA = "conv_id long, turn long, role string, text string, key string, depth long, id string, words long"


def test_shared_length():
    assert [shared_length(a, b) for a, b in ((b"", b"x"), (b"ab", b"abc"), (b"abc", b"abd"), (b"\x00a", b"\x01a"))] == [0, 2, 2, 0]


def test_radix_tree_holds_what_it_was_given():
    rnd = random.Random(5)
    for alphabet in (3, 20, 60, 256):
        keys = {bytes(rnd.randrange(alphabet) for _ in range(rnd.randint(0, 9))) for _ in range(3000)}
        tree = RadixTree()
        for key in rnd.sample(sorted(keys), len(keys)):
            tree.insert(key, key)
        found, path, layouts, stack = [], bytearray(), set(), [tree.root]
        for at, piece, value in tree.walk():
            del path[at:]
            path += piece
            if value is not None:
                assert value == path
                found.append(value)
        while stack:
            node = stack.pop()
            links = list(node.children())
            layouts.add(node.layout)
            assert len(links) <= node.layout and all(node.find(byte) is child for byte, child in links)
            stack += [child for _, child in links]
        assert found == sorted(keys)
        assert max(layouts) == {3: 4, 20: 48, 60: 256, 256: 256}[alphabet]


def brute(rows):
    own = {}
    for conv, turn, role, text in rows:
        if conv is not None:
            own.setdefault(conv, []).append(((turn is not None, turn or 0), role or "", text or ""))
    own = {c: [t[1:] for t in sorted(turns)] for c, turns in own.items()}
    built = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 4
        built[c] = own.get(c - int(math.fmod(c, 20)), [])[:h] + turns[h:]
    members = {}
    for c, turns in built.items():
        for d in range(len(turns) + 1):
            members.setdefault(tuple(turns[:d]), []).append(c)
    kids = {}
    for key in members:
        if key:
            kids.setdefault(key[:-1], []).append(key)

    def under(key):
        return [key, *(k for kid in kids.get(key, []) for k in under(kid))]

    for key, convs in members.items():
        below = under(key)
        ends = ",".join(map(str, sorted(c for c in convs if len(built[c]) == len(key))))
        yield (min(convs), len(key), min(members[key[:-1]]) if key else None, len(convs), len(kids.get(key, [])),
               sum(k not in kids for k in below),
               sum((len(members[k]) - 1) * len(re.findall(r"[^\x20\x09-\x0D]+", k[-1][1])) for k in below if k),
               hashlib.sha256(ends.encode()).hexdigest())


def same(spark, rows, tree_turns):
    frame = spark.createDataFrame([(*r, "k", 1, "i", 2) for r in rows], SCHEMA)
    found = conversation_trie.prefix_nodes(conversation_trie.with_family_heads(frame), tree_turns)
    columns = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    assert sorted(map(str, map(tuple, found.select(*columns).collect()))) == sorted(map(str, brute(rows)))


@pytest.mark.parametrize("tree_turns", [1, 7, 60, 100_000])
def test_like_plain_prefixes(spark, tree_turns):
    rnd = random.Random(tree_turns)
    rows = []
    for conv in rnd.sample(range(400), 150):
        for turn in range(rnd.choice([1, 1, 2, 3, 5, 9])):
            rows.append((conv, turn, rnd.choice(["user", None, "bot"]), rnd.choice(["a b", "c", "", None, "d  e\nf"])))
    same(spark, rows, tree_turns)


@pytest.mark.parametrize("tree_turns", [5, 100_000])
def test_odd_rows(spark, tree_turns):
    rows = [(None, 1, "user", "lost"), (3, None, None, None), (3, None, None, None), (3, 2, "user", "x"), (20, 5, "user", ""), (21, 1, "a", "b"),
            (-7, 0, "user", "negative"), (0, 0, "user", "word " * 3000)]
    rows += [(c, t, "user", f"copy {t}") for c in range(3000, 3100) for t in range(4)]
    same(spark, rows, tree_turns)


def test_a_long_conversation(spark):
    same(spark, [(c, t, "user", "same" if t < 250 else f"{c}") for c in (40, 41, 63) for t in range(300)], 100)


def test_no_rows(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert conversation_trie.prefix_nodes(conversation_trie.sequences(empty)).collect() == []
