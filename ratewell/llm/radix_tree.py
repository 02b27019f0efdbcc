"""Adaptive radix tree over byte strings: nodes of four sizes, compressed paths, values at any depth."""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator


class Node:
    """A compressed path and the links after it, in the smallest layout that holds them.

    Up to 4 and up to 16 links are two parallel sorted arrays, up to 48 a table of 256 places into a
    list, beyond that 256 links by byte.
    """

    __slots__ = ("path", "value", "layout", "bytes", "links")

    def __init__(self, path: bytes = b"", value=None):
        self.path, self.value = path, value
        self.layout, self.bytes, self.links = 4, bytearray(), []

    def find(self, byte: int) -> Node | None:
        if self.layout <= 16:
            at = self.bytes.find(byte)
            return None if at < 0 else self.links[at]
        if self.layout == 48:
            at = self.bytes[byte]
            return None if at == 255 else self.links[at]
        return self.links[byte]

    def add(self, byte: int, child: Node) -> None:
        """Link a child under a byte that has none yet."""
        if self.layout < 256 and len(self.links) == self.layout:
            self._grow()
        if self.layout <= 16:
            at = bisect_left(self.bytes, byte)
            self.bytes.insert(at, byte)
            self.links.insert(at, child)
        elif self.layout == 48:
            self.bytes[byte] = len(self.links)
            self.links.append(child)
        else:
            self.links[byte] = child

    def _grow(self) -> None:
        held = list(self.children())
        self.layout = {4: 16, 16: 48, 48: 256}[self.layout]
        if self.layout == 48:
            self.bytes = bytearray(b"\xff" * 256)
            for place, (byte, _) in enumerate(held):
                self.bytes[byte] = place
        elif self.layout == 256:
            self.bytes, self.links = bytearray(), [None] * 256
            for byte, child in held:
                self.links[byte] = child

    def children(self) -> Iterator[tuple[int, Node]]:
        """Links in ascending order of their bytes."""
        if self.layout <= 16:
            return zip(self.bytes, self.links)
        if self.layout == 48:
            return ((b, self.links[at]) for b, at in enumerate(self.bytes) if at != 255)
        return ((b, child) for b, child in enumerate(self.links) if child is not None)

    def split(self, at: int) -> None:
        """Cut the path: its rest becomes the only child."""
        rest = Node(self.path[at + 1 :], self.value)
        rest.layout, rest.bytes, rest.links = self.layout, self.bytes, self.links
        byte = self.path[at]
        self.path, self.value = self.path[:at], None
        self.layout, self.bytes, self.links = 4, bytearray([byte]), [rest]


def shared_length(a: bytes, b: bytes) -> int:
    """Bytes that two strings begin with alike."""
    n = min(len(a), len(b))
    if a[:n] == b[:n]:
        return n
    differ = int.from_bytes(a[:n], "big") ^ int.from_bytes(b[:n], "big")
    return n - (differ.bit_length() + 7) // 8


class RadixTree:
    def __init__(self):
        self.root = Node()

    def insert(self, key: bytes, value) -> None:
        """Set the value of a key; a key may begin like another or be its beginning."""
        node, at = self.root, 0
        while True:
            same = shared_length(node.path, key[at : at + len(node.path)])
            if same < len(node.path):
                node.split(same)
            at += same
            if at == len(key):
                node.value = value
                return
            child = node.find(key[at])
            if child is None:
                node.add(key[at], Node(key[at + 1 :], value))
                return
            node, at = child, at + 1

    def walk(self) -> Iterator[tuple[int, bytes, object]]:
        """Nodes from left to right, parents first: depth in bytes before the node, its bytes, its value."""
        stack = [(0, b"", self.root)]
        while stack:
            at, byte, node = stack.pop()
            yield at, byte + node.path, node.value
            below = at + len(byte) + len(node.path)
            stack += [(below, bytes([b]), child) for b, child in reversed(list(node.children()))]
