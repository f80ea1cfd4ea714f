"""Byte-level BPE: exact encoding and decoding of whole texts.

A text is cut before each single space that a non-space follows.  No token of the splitting pattern
crosses such a cut, so the parts can be encoded alone, and a worker remembers the parts it has seen.
Words of new parts are looked up in the lexicon; words outside it are merged by rank.

Defined cases: null is the empty text, which has no ids; a very long text is encoded whole, and a very long word by a heap; repeated rows give equal rows; only the named
text column and the key are read.
"""

from __future__ import annotations

import json
from array import array
from collections.abc import Callable

import numpy as np
import regex
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sievector.llm import lexicon

#: The splitting pattern of the byte-level vocabulary; a fixed value.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\p{White_Space}\p{L}\p{N}]+|\p{White_Space}+(?!\P{White_Space})|\p{White_Space}+"
#: Parts and words that a worker remembers, and the longest part that it does.
REMEMBERED, LONGEST = 400_000, 64
_NO_MERGE = (1 << 60, 0)


def byte_letters() -> dict[str, int]:
    """The printable letter that stands for each byte in vocabulary files: bytes that print stand for
    themselves, the others follow from code point 256 on."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


class Vocabulary:
    """Tokens by id, merge ranks by pair of ids, and special strings of a tokenizer file."""

    def __init__(self, tokens: list[bytes], ranks: dict[int, tuple[int, int]], special: dict[str, int]):
        self.tokens, self.ranks, self.special = tokens, ranks, special
        self.letters = [0] * 256
        for i, t in enumerate(tokens):
            if len(t) == 1:
                self.letters[t[0]] = i

    @classmethod
    def load(cls, path: str) -> Vocabulary:
        with open(path, encoding="utf-8") as f:
            file = json.load(f)
        letters, ids = byte_letters(), file["model"]["vocab"]
        special = {x["content"]: x["id"] for x in file["added_tokens"]}
        tokens = [b""] * (1 + max([*ids.values(), *special.values()]))
        for t, i in ids.items():
            tokens[i] = bytes(letters[c] for c in t)
        for t, i in special.items():
            tokens[i] = t.encode()
        ranks = {ids[a] << 20 | ids[b]: (k, ids[a + b]) for k, (a, b) in enumerate(file["model"]["merges"])}
        return cls(tokens, ranks, special)

    def merge(self, word: bytes) -> list[int]:
        """Ids of one word: the adjacent pair of lowest rank is joined until none is left; of equal
        pairs the leftmost goes first."""
        ids = [self.letters[b] for b in word]
        if len(ids) > 64:
            return self._merge_long(ids)
        find, none = self.ranks.get, _NO_MERGE
        pairs = [find(a << 20 | b, none) for a, b in zip(ids, ids[1:])]
        while pairs:
            best = min(pairs)
            if best is none:
                break
            at = pairs.index(best)
            new = ids[at] = best[1]
            del ids[at + 1], pairs[at]
            if at:
                pairs[at - 1] = find(ids[at - 1] << 20 | new, none)
            if at < len(pairs):
                pairs[at] = find(new << 20 | ids[at + 1], none)
        return ids

    def _merge_long(self, ids: list[int]) -> list[int]:
        """The same by a heap over linked places, for words of any length."""
        import heapq

        after, before = [*range(1, len(ids)), -1], [*range(-1, len(ids) - 1)]
        heap = [(*r, i, ids[i], ids[i + 1]) for i in range(len(ids) - 1) if (r := self.ranks.get(ids[i] << 20 | ids[i + 1]))]
        heap = [(rank, i, new, a, b) for rank, new, i, a, b in heap]
        heapq.heapify(heap)
        while heap:
            _, i, new, a, b = heapq.heappop(heap)
            j = after[i]
            if ids[i] != a or j < 0 or ids[j] != b:
                continue
            ids[i], ids[j] = new, -1
            after[i] = after[j]
            if after[i] >= 0:
                before[after[i]] = i
            for x, y in ((before[i], i), (i, after[i])):
                if x >= 0 and y >= 0 and (r := self.ranks.get(ids[x] << 20 | ids[y])):
                    heapq.heappush(heap, (r[0], x, r[1], ids[x], ids[y]))
        return [i for i in ids if i >= 0]


class Encoder:
    """Encodes texts to little-endian 32-bit ids; remembers parts between batches."""

    def __init__(self, vocabulary: Vocabulary, mapped: lexicon.Lexicon | None = None, library: bool = False):
        """``library``: merge words by a compiled library of the same vocabulary, where the automaton isn't the point."""
        self.vocabulary, self.mapped = vocabulary, mapped
        self.merge = vocabulary.merge
        if library:
            known = set(vocabulary.special.values())
            ranks = {t: i for i, t in enumerate(vocabulary.tokens) if i not in known}
            whole = tiktoken.Encoding("words", pat_str=r"(?s).+", mergeable_ranks=ranks, special_tokens={})
            self.merge = lambda b: whole.encode_ordinary(b.decode())
        self.split = regex.compile(PATTERN).findall
        self.first: dict[str, bytes] = {}
        self.later: dict[str, bytes] = {}
        self.words: dict[str, bytes] = {}

    def encode(self, texts: list[str]) -> list[bytes]:
        out = []
        for text in texts:
            for mark in self.vocabulary.special:
                if mark in text:
                    out.append(self._with_special(text))
                    break
            else:
                out.append(text)
        whole = [x for x in out if isinstance(x, str)]
        done = iter(self._plain(whole))
        return [next(done) if isinstance(x, str) else x for x in out]

    def _with_special(self, text: str) -> bytes:
        """Special strings are cut out first; what lies between them is encoded alone."""
        special = self.vocabulary.special
        parts = regex.split("(" + "|".join(map(regex.escape, sorted(special, key=len, reverse=True))) + ")", text)
        plain = iter(self._plain([p for p in parts if p not in special]))
        return b"".join(special[p].to_bytes(4, "little") if p in special else next(plain) for p in parts)

    def _plain(self, texts: list[str]) -> list[bytes]:
        if max(len(self.first), len(self.later), len(self.words)) > REMEMBERED:
            self.first, self.later, self.words = {}, {}, {}
        cut, new, heads = [], set(), set()
        later = self.later
        for text in texts:
            head, *rest = text.split(" ")
            unseen = [p for p in {*rest} if p not in later]
            if any(not p or p[0].isspace() for p in unseen):
                head, rest = self._joined(head, rest)
                unseen = [p for p in rest if p not in later]
            cut.append((head, rest))
            new.update(unseen)
            if head not in self.first:
                heads.add(head)
        split = self.split
        parts_later = {p: split(" " + p) for p in new}
        parts_first = {p: split(p) for p in heads}
        self._learn({w for ws in parts_later.values() for w in ws} | {w for ws in parts_first.values() for w in ws})
        word = self.words.__getitem__
        once = {}
        for p, ws in parts_later.items():
            ids = word(ws[0]) if len(ws) == 1 else b"".join(map(word, ws))
            (self.later if len(p) <= LONGEST else once)[p] = ids
        once_first = {}
        for p, ws in parts_first.items():
            (self.first if len(p) <= LONGEST else once_first)[p] = b"".join(map(word, ws))
        out = []
        for head, rest in cut:
            lead = self.first.get(head)
            lead = once_first[head] if lead is None else lead
            try:
                out.append(lead + b"".join(map(self.later.__getitem__, rest)))
            except KeyError:
                out.append(lead + b"".join(self.later[p] if p in self.later else once[p] for p in rest))
        return out

    @staticmethod
    def _joined(head: str, rest: list[str]) -> tuple[str, list[str]]:
        """Parts that are empty or start with white space go back to the part before them."""
        runs = [[head]]
        for p in rest:
            if not p or p[0].isspace():
                runs[-1].append(p)
            else:
                runs.append([p])
        joined = [" ".join(r) for r in runs]
        return joined[0], joined[1:]

    def _learn(self, words: set[str]) -> None:
        new = [w for w in words if w not in self.words]
        if not new:
            return
        raw = [w.encode() for w in new]
        places = self.mapped.places(raw).tolist() if self.mapped else [-1] * len(raw)
        for w, b, place in zip(new, raw, places):
            self.words[w] = self.mapped.ids(place).tobytes() if place >= 0 else array("I", self.merge(b)).tobytes()

    def decode(self, ids: bytes) -> str:
        tokens = self.vocabulary.tokens
        return b"".join(map(tokens.__getitem__, np.frombuffer(ids, "<u4").tolist())).decode("utf-8", "replace")


_HELD: dict[object, Encoder] = {}


def encoder_of(key: object, make: Callable[[], Encoder]) -> Encoder:
    """This worker's encoder for ``key``; one is held, so its memory and its automaton serve later tasks."""
    if key not in _HELD:
        _HELD.clear()
        _HELD[key] = make()
    return _HELD[key]


def frequent(counts: DataFrame, n: str, size: int) -> DataFrame:
    """The most frequent rows of ``counts``, at most ``size`` of them.

    The histogram of the counts (its rows grow with the root of the corpus at most) gives the least count that fits, so no
    task sends more than the rows that are kept; counts that tie at the edge stay out together.
    """
    least, held = 0, 0
    for r in sorted(counts.groupBy(F.col(n).alias("n")).agg(F.count("*").alias("rows")).collect(), reverse=True):
        held += r["rows"]
        if held > size:
            break
        least = r["n"]
    return counts.where(F.col(n) >= least) if least else counts.limit(0)
