"""Minimal acyclic transducer: a shared-suffix automaton from byte strings to sequences of ids.

Words are added in byte order; a state whose last arc is complete is merged with an equal state, so
the automaton is minimal at every moment.  Each arc carries how many words lie before it, so the sum
along a path is the word's place in byte order, and that place points at the word's ids.  The file
is a header line and plain arrays; workers map it into memory, and all of a machine share its pages.
"""

from __future__ import annotations

import json

import numpy as np

_ARRAYS = ("arc_key", "arc_target", "arc_skip", "final", "out_start", "out_ids")


def build(entries: dict[bytes, list[int]]) -> dict[str, np.ndarray]:
    """Arrays of the automaton; empty words are not taken."""
    words = sorted(w for w in entries if w)
    known: dict[tuple, int] = {}
    arcs_of: list[tuple] = []
    finals: list[bool] = []
    below: list[int] = []

    def settle(node: list) -> int:
        mark = (node[0], tuple(node[1]))
        found = known.get(mark)
        if found is None:
            found = known[mark] = len(arcs_of)
            arcs_of.append(mark[1])
            finals.append(node[0])
            below.append(node[0] + sum(below[t] for _, t in mark[1]))
        return found

    path: list[list] = [[False, []]]
    last = b""
    for word in [*words, b""]:
        shared = 0
        while shared < min(len(word), len(last)) and word[shared] == last[shared]:
            shared += 1
        while len(path) > shared + 1:
            target = settle(path.pop())
            path[-1][1].append((last[len(path) - 1], target))
        path.extend([False, []] for _ in word[shared:])
        path[-1][0] = bool(word)
        last = word
    root = settle(path[0])

    key, target, skip = [], [], []
    for state in range(len(arcs_of)):
        before = int(finals[state])
        for label, to in arcs_of[state]:
            key.append(state << 8 | label)
            target.append(to)
            skip.append(before)
            before += below[to]
    starts = np.cumsum([0, *(len(entries[w]) for w in words)], dtype=np.int64)
    return {
        "arc_key": np.array(key, np.int64),
        "arc_target": np.array(target, np.int32),
        "arc_skip": np.array(skip, np.int32),
        "final": np.array([*finals, root], np.int32),  # the root stands behind the states
        "out_start": starts,
        "out_ids": np.array([i for w in words for i in entries[w]], np.uint32),
    }


def to_bytes(arrays: dict[str, np.ndarray]) -> bytes:
    head = json.dumps([[k, arrays[k].dtype.str, len(arrays[k])] for k in _ARRAYS]).encode()
    head += b" " * (-(len(head) + 1) % 8) + b"\n"
    return head + b"".join(arrays[k].tobytes() + b"\0" * (-arrays[k].nbytes % 8) for k in _ARRAYS)


class Lexicon:
    """A mapped automaton file."""

    def __init__(self, path: str):
        with open(path, "rb") as f:
            head = f.readline()
        at = len(head)
        for name, kind, count in json.loads(head):
            size = np.dtype(kind).itemsize * count
            setattr(self, name, np.memmap(path, kind, "r", at, (count,)) if count else np.empty(0, kind))
            at += size + -size % 8
        self.root = int(self.final[-1])

    def places(self, words: list[bytes]) -> np.ndarray:
        """Each word's place in byte order, or -1: all words walk the automaton in step."""
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        text = np.frombuffer(b"".join(words), np.uint8)
        starts = np.cumsum(lengths) - lengths
        state = np.full(len(words), self.root, np.int64)
        place = np.zeros(len(words), np.int64)
        alive = np.flatnonzero(lengths > 0)
        state[lengths == 0] = -1
        step = 0
        while len(alive) and len(self.arc_key):
            key = state[alive] << 8 | text[starts[alive] + step]
            arc = np.minimum(np.searchsorted(self.arc_key, key), len(self.arc_key) - 1)
            hit = self.arc_key[arc] == key
            state[alive[~hit]] = -1
            alive, arc = alive[hit], arc[hit]
            state[alive] = self.arc_target[arc]
            place[alive] += self.arc_skip[arc]
            step += 1
            alive = alive[lengths[alive] > step]
        if not len(self.arc_key):
            state[:] = -1
        ok = state >= 0
        ok[ok] = self.final[state[ok]] == 1
        return np.where(ok, place, -1)

    def ids(self, place: int) -> np.ndarray:
        return self.out_ids[self.out_start[place] : self.out_start[place + 1]]
