"""Minimal acyclic transducer: words of bytes in a shared-suffix automaton, each with an output.

Built from sorted words by joining equal suffix states as soon as a branch is finished.
Every arc stores how many words come before it at its state, so the sum along a word's
path is the word's number, and outputs are looked up by number. The arrays are one
block of bytes that a worker maps read-only.
"""

from __future__ import annotations

import mmap
import tempfile

import numpy as np


class _State:
    __slots__ = ("arcs", "final", "number", "words")

    def __init__(self) -> None:
        self.arcs: dict[int, _State] = {}
        self.final, self.number, self.words = False, -1, 0

    def key(self) -> tuple:
        return (self.final, *((label, to.number) for label, to in self.arcs.items()))


class Transducer:
    """Numbers distinct words; ``outputs[number]`` is the word's ids as little-endian 32-bit integers."""

    def __init__(self, data: bytes) -> None:
        self.data = data
        self._arrays: tuple | None = None

    def __getstate__(self) -> dict:
        return {"data": self.data, "_arrays": None}

    @staticmethod
    def build(entries: dict[bytes, bytes]) -> Transducer:
        """From word to output; any order, the empty word allowed."""
        root, register, states = _State(), {}, []

        def settle(path: list[tuple[_State, int]], keep: int) -> None:
            """Freeze the states of the last word below depth ``keep``, sharing equal ones."""
            while len(path) > keep:
                parent, label = path.pop()
                state = parent.arcs[label]
                key = state.key()
                if key not in register:
                    state.number = len(states)
                    state.words = state.final + sum(to.words for to in state.arcs.values())
                    states.append(state)
                    register[key] = state
                parent.arcs[label] = register[key]

        path: list[tuple[_State, int]] = []
        last = b""
        words = sorted(entries)
        for word in words:
            shared = 0
            while shared < min(len(word), len(last)) and word[shared] == last[shared]:
                shared += 1
            settle(path, shared)
            state = path[-1][0].arcs[path[-1][1]] if path else root
            for label in word[shared:]:
                state.arcs[label] = _State()
                path.append((state, label))
                state = state.arcs[label]
            state.final = True
            last = word
        settle(path, 0)
        root.number = len(states)
        states.append(root)
        keys, targets, skipped = [], [], []
        for state in states:
            before = int(state.final)
            for label, to in state.arcs.items():
                keys.append(state.number << 8 | label)
                targets.append(to.number)
                skipped.append(before)
                before += to.words
        outputs = [entries[w] for w in words]
        ends = np.cumsum([0, *map(len, outputs)])
        parts = [
            np.array(keys, "<i8"), np.array(targets, "<i4"), np.array(skipped, "<i4"),
            np.array([s.final for s in states], "u1"), np.array(ends, "<i8"), np.frombuffer(b"".join(outputs), "u1"),
        ]
        blocks = [p.tobytes() for p in parts]
        padded = [b + b"\0" * (-len(b) % 8) for b in blocks]
        return Transducer(np.array([len(b) for b in blocks], "<i8").tobytes() + b"".join(padded))

    def _mapped(self) -> tuple:
        """The arrays, over one read-only mapping of an unnamed file."""
        if self._arrays is None:
            with tempfile.TemporaryFile() as file:
                file.write(self.data)
                file.flush()
                block = mmap.mmap(file.fileno(), len(self.data), access=mmap.ACCESS_READ)
            at, arrays = 48, []
            for size, kind in zip(np.frombuffer(block, "<i8", 6), ("<i8", "<i4", "<i4", "u1", "<i8", "u1")):
                arrays.append(np.frombuffer(block, kind, int(size) // np.dtype(kind).itemsize, at))
                at += int(size) + -int(size) % 8
            self._arrays = (*arrays, memoryview(block)[at - arrays[-1].size - -arrays[-1].size % 8 :])
        return self._arrays

    @property
    def states(self) -> int:
        return len(self._mapped()[3])

    def find(self, words: list[bytes]) -> list[bytes | None]:
        """The output of each word, None for words not in the lexicon; all words step together."""
        keys, targets, skipped, final, ends, _, outputs = self._mapped()
        if not words or not len(keys):
            return [None] * len(words)
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        letters, starts = np.frombuffer(b"".join(words), "u1"), np.cumsum(lengths) - lengths
        state = np.full(len(words), len(final) - 1, np.int64)
        number = np.zeros(len(words), np.int64)
        alive = np.arange(len(words))
        step = 0
        while True:
            alive = alive[lengths[alive] > step]
            if not len(alive):
                break
            wanted = state[alive] << 8 | letters[starts[alive] + step]
            arc = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
            there = keys[arc] == wanted
            state[alive[~there]] = -1
            alive, arc = alive[there], arc[there]
            number[alive] += skipped[arc]
            state[alive] = targets[arc]
            step += 1
        found = (state >= 0) & (final[state] > 0)
        return [
            bytes(outputs[ends[n] : ends[n + 1]]) if ok else None
            for ok, n in zip(found.tolist(), number.tolist())
        ]
