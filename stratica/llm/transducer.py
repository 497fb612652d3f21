"""A minimal acyclic transducer from byte strings to id sequences, kept in one memory-mappable file.

The automaton is built incrementally from sorted words, sharing prefixes and (through a register of equal states)
suffixes.  Arcs carry numbers that add up along a path to the word's place in sorted order; the place selects the
word's ids from one flat array.  Lookups walk all asked words at once, one byte position a step, in numpy.
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence

import numpy as np

MAGIC = b"LEXFST01"


class _State:
    __slots__ = ("arcs", "final", "number", "words")

    def __init__(self) -> None:
        self.arcs: dict[int, _State] = {}
        self.final = False
        self.number = -1
        self.words = 0

    def signature(self) -> tuple:
        return (self.final, *((byte, id(target)) for byte, target in self.arcs.items()))


def minimal_states(words: Iterable[bytes]) -> _State:
    """The start state of the minimal automaton of strictly ascending words."""
    start, register, before = _State(), {}, b""
    path: list[tuple[_State, int, _State]] = []

    def freeze(down_to: int) -> None:
        while len(path) > down_to:
            parent, byte, child = path.pop()
            parent.arcs[byte] = register.setdefault(child.signature(), child)

    for word in words:
        shared = 0
        while shared < min(len(word), len(before)) and word[shared] == before[shared]:
            shared += 1
        if word <= before and (word or before):
            raise ValueError("words must ascend strictly")
        freeze(shared)
        state = path[-1][2] if path else start
        for byte in word[shared:]:
            child = _State()
            state.arcs[byte] = child
            path.append((state, byte, child))
            state = child
        state.final = True
        before = word
    freeze(0)
    return start


def compile_lexicon(entries: dict[bytes, Sequence[int]]) -> bytes:
    """The file image of a lexicon; the empty word is not an entry."""
    words = sorted(w for w in entries if w)
    start = minimal_states(words)
    order: list[_State] = []
    stack = [(start, False)]
    seen: set[int] = set()
    while stack:  # children first
        state, done = stack.pop()
        if done:
            state.words = int(state.final) + sum(t.words for t in state.arcs.values())
            order.append(state)
        elif id(state) not in seen:
            seen.add(id(state))
            stack.append((state, True))
            stack.extend((t, False) for t in state.arcs.values() if id(t) not in seen)
    order.reverse()
    for number, state in enumerate(order):  # the start state is 0
        state.number = number
    keys, targets, places = [], [], []
    for state in order:
        place = int(state.final)
        for byte in sorted(state.arcs):
            target = state.arcs[byte]
            keys.append(state.number * 256 + byte)
            targets.append(target.number)
            places.append(place)
            place += target.words
    ids = [list(entries[w]) for w in words]
    arrays = [
        np.array(keys, dtype="<i8"),
        np.array(targets, dtype="<i4"),
        np.array(places, dtype="<i4"),
        np.array([s.final for s in order], dtype="u1"),
        np.cumsum([0, *map(len, ids)]).astype("<i8"),
        np.array([i for row in ids for i in row], dtype="<u4"),
    ]
    head = np.array([max(map(len, words), default=0), *map(len, arrays)], dtype="<i8").tobytes()
    out = MAGIC + head
    for a in arrays:
        out += b"\0" * (-len(out) % 8) + a.tobytes()
    return out


class Lexicon:
    """Lookups in a memory-mapped lexicon file."""

    TYPES = ("<i8", "<i4", "<i4", "u1", "<i8", "<u4")

    def __init__(self, path: str):
        image = np.memmap(path, dtype="u1", mode="r")
        if bytes(image[:8]) != MAGIC:
            raise ValueError(f"{path} is not a lexicon")
        self.longest, *sizes = (int(x) for x in np.frombuffer(image[8:64], dtype="<i8"))
        at, arrays = 64, []
        for kind, size in zip(self.TYPES, sizes, strict=True):
            at += -at % 8
            end = at + size * np.dtype(kind).itemsize
            arrays.append(image[at:end].view(kind))
            at = end
        self.keys, self.targets, self.places, self.final, self.offsets, self.ids = arrays

    def __len__(self) -> int:
        return len(self.offsets) - 1

    def places_of(self, words: Sequence[bytes]) -> np.ndarray:
        """For every word its place in sorted order, or -1 where the lexicon lacks it."""
        n = len(words)
        sizes = np.fromiter(map(len, words), dtype=np.int64, count=n)
        found = np.full(n, -1, dtype=np.int64)
        asked = np.flatnonzero((sizes > 0) & (sizes <= self.longest))
        if not len(asked) or not len(self):
            return found
        sizes = sizes[asked]
        flat = np.frombuffer(b"".join([words[i] for i in asked]), dtype="u1")
        starts = np.cumsum(sizes) - sizes
        state = np.zeros(len(asked), dtype=np.int64)
        place = np.zeros(len(asked), dtype=np.int64)
        live = np.arange(len(asked))
        for step in range(int(sizes.max())):
            ended = sizes[live] == step
            done = live[ended]
            done = done[self.final[state[done]] == 1]
            found[asked[done]] = place[done]
            live = live[~ended]
            key = state[live] * 256 + flat[starts[live] + step]
            arc = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            hit = self.keys[arc] == key
            live, arc = live[hit], arc[hit]
            state[live] = self.targets[arc]
            place[live] += self.places[arc]
        done = live[(sizes[live] == sizes.max()) & (self.final[state[live]] == 1)]
        found[asked[done]] = place[done]
        return found

    def outputs_of(self, words: Sequence[bytes]) -> list[bytes | None]:
        """For every word its ids as bytes of unsigned 32-bit integers, or None where the lexicon lacks it."""
        places = self.places_of(words)
        known = np.maximum(places, 0)
        if not len(self):
            return [None] * len(words)
        starts, ends = (self.offsets[known] * 4).tolist(), (self.offsets[known + 1] * 4).tolist()
        tape = memoryview(self.ids.view("u1"))
        return [bytes(tape[a:b]) if k >= 0 else None for k, a, b in zip(places.tolist(), starts, ends, strict=True)]
