"""A minimal acyclic transducer from byte strings to sequences of token ids.

Built from sorted words: states with equal futures are shared, so common endings are stored once, and outputs move
as near to the root as possible. The result is one flat byte string, which a task maps into memory and walks
without building objects.
"""

from __future__ import annotations

import mmap
import tempfile
from collections.abc import Iterable

import numpy as np


def _shared(a: tuple, b: tuple) -> int:
    n = 0
    for x, y in zip(a, b):
        if x != y:
            break
        n += 1
    return n


class _State:
    __slots__ = ("arcs", "final", "last")

    def __init__(self):
        self.arcs: list[list] = []  # [byte, target state number, output]
        self.final = False
        self.last: tuple = ()  # output on ending here


def compile_lexicon(entries: Iterable[tuple[bytes, tuple[int, ...]]]) -> bytes:
    """The transducer of the entries, whose words are distinct and not empty, in any order."""
    known: dict[tuple, int] = {}
    frozen: list[tuple] = []

    def freeze(state: _State) -> int:
        key = (state.final, state.last, tuple(map(tuple, state.arcs)))
        if key not in known:
            known[key] = len(frozen)
            frozen.append(key)
        return known[key]

    path, before = [_State()], b""
    for word, output in sorted(entries):
        common = _shared(before, word)
        while len(path) > common + 1:
            state = path.pop()
            path[-1].arcs[-1][1] = freeze(state)
        for depth in range(common):
            arc = path[depth].arcs[-1]
            n = _shared(arc[2], output)
            if rest := arc[2][n:]:
                below = path[depth + 1]
                for other in below.arcs:
                    other[2] = rest + other[2]
                if below.final:
                    below.last = rest + below.last
                arc[2] = arc[2][:n]
            output = output[n:]
        for byte in word[common:]:
            path[-1].arcs.append([byte, -1, output])
            path.append(_State())
            output = ()
        path[-1].final, path[-1].last, before = True, output, word
    while len(path) > 1:
        state = path.pop()
        path[-1].arcs[-1][1] = freeze(state)
    root = freeze(path[0])

    arcs = [arc for _, _, some in frozen for arc in some]
    outputs = [arc[2] for arc in arcs] + [last for _, last, _ in frozen]
    header = np.array([len(frozen), len(arcs), root, sum(map(len, outputs))], np.int32)
    begin = np.concatenate(([0], np.cumsum([len(some) for _, _, some in frozen])))
    at = np.concatenate(([0], np.cumsum([len(x) for x in outputs])))
    numbers = [header, begin, [arc[1] for arc in arcs], at, [final for final, _, _ in frozen], [i for x in outputs for i in x]]
    return np.concatenate(numbers).astype(np.int32).tobytes() + bytes(arc[0] for arc in arcs)


class Lexicon:
    """Walks a compiled transducer that is mapped from an unlinked scratch file, which the worker made itself. States are
    numbers and arcs positions in the map: nothing is kept of the words that were looked up."""

    def __init__(self, compiled: bytes):
        with tempfile.TemporaryFile() as file:
            file.write(compiled)
            file.flush()
            self._map = mmap.mmap(file.fileno(), 0, access=mmap.ACCESS_READ)
        states, arcs, self._root, ids = np.frombuffer(self._map, np.int32, 4).tolist()
        self._labels = 4 * (4 + states + 1 + arcs + arcs + states + 1 + states + ids)
        numbers = memoryview(self._map)[: self._labels].cast("i")
        edges = np.cumsum([4, states + 1, arcs, arcs + states + 1, states, ids]).tolist()
        self._begin, self._target, self._at, self._final, self._ids = (numbers[a:b] for a, b in zip(edges, edges[1:]))
        self._arcs = arcs
        begin = np.frombuffer(self._map, np.int32, states + 1, 16)
        self._steps = np.repeat(np.arange(states), np.diff(begin)) << 8 | np.frombuffer(self._map, np.uint8, arcs, self._labels)
        self._targets = np.frombuffer(self._map, np.int32, arcs, 16 + 4 * (states + 1)).astype(np.int64)
        self._ends = np.array(self._final, bool)

    @property
    def empty(self) -> bool:
        """Whether no word of at least one byte is an entry."""
        return not self._arcs

    def accepts(self, words: list[bytes]) -> np.ndarray:
        """Which of the words are entries; all walk together, a byte at a time."""
        lengths = np.array([len(w) for w in words], np.int64)
        data, begin = np.frombuffer(b"".join(words), np.uint8), np.cumsum(lengths) - lengths
        state = np.full(len(words), self._root, np.int64)
        left, depth = np.arange(len(words)), 0
        while len(left := left[lengths[left] > depth]):
            step = state[left] << 8 | data[begin[left] + depth]
            at = np.minimum(np.searchsorted(self._steps, step), len(self._steps) - 1) if self._arcs else np.zeros(len(left), np.int64)
            goes = self._steps[at] == step if self._arcs else np.zeros(len(left), bool)
            state[left] = np.where(goes, self._targets[at] if self._arcs else -1, -1)
            left, depth = left[goes], depth + 1
        return (state >= 0) & self._ends[state]

    def get(self, word: bytes) -> list[int] | None:
        """The ids of the word; None if it isn't one of the entries."""
        find, labels, begin, target, at, ids = self._map.find, self._labels, self._begin, self._target, self._at, self._ids
        state, out = self._root, []
        for i in range(len(word)):
            arc = find(word[i : i + 1], labels + begin[state], labels + begin[state + 1]) - labels
            if arc < 0:
                return None
            if at[arc] != at[arc + 1]:
                out += ids[at[arc] : at[arc + 1]].tolist()
            state = target[arc]
        last = self._arcs + state
        return out + ids[at[last] : at[last + 1]].tolist() if self._final[state] else None
