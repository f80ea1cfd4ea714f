"""Ids of whole batches of texts: every distinct part of a batch is encoded once.

A text is cut before each single space that a non-space follows (see ``subwords``), so all parts but a text's
first begin with a space and can be encoded alone.  ``BatchEncoder`` puts parts without a space inside through a compiled library
in one line; there a part's first id is the only one that begins with a space, so the ids fall apart into parts again.
Parts with spaces inside, very long parts, first parts and texts with special strings are encoded one by one.
``LexiconEncoder`` splits parts into words, which come from the automaton or are merged.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import tiktoken

from sievector.llm.lexicon import Lexicon
from sievector.llm.subwords import PATTERN, REMEMBERED, Encoder, Vocabulary

#: Characters of a part that goes through the library's line.
LONG = 500


def parts_of(texts: pa.Array, skip: np.ndarray | None = None) -> tuple[list[str], np.ndarray, np.ndarray, np.ndarray]:
    """(distinct parts, number of each text's parts among them, where each text's first part is, parts a text).

    Parts that are empty or begin with white space go back to the part before them.  Texts in ``skip`` are read as empty.
    """
    parts = pc.split_pattern(texts, " ")
    sizes = pc.list_value_length(parts).to_numpy(zero_copy_only=False).astype(np.int64)
    coded = parts.flatten().dictionary_encode()
    distinct, code = coded.dictionary.to_numpy(zero_copy_only=False).tolist(), coded.indices.to_numpy(zero_copy_only=False)
    heads = np.cumsum(sizes) - sizes
    loose = np.fromiter((not p or p[0].isspace() for p in distinct), bool, len(distinct))[code]
    loose[heads] = False
    odd = np.bincount(np.repeat(np.arange(len(texts)), sizes), loose, len(texts)) > 0
    if skip is not None:
        odd |= skip
    if not odd.any():
        return distinct, code, heads, sizes
    lists = parts.to_pylist()
    for i in np.flatnonzero(odd).tolist():
        if skip is not None and skip[i]:
            lists[i] = [""]
        else:
            head, rest = Encoder._joined(lists[i][0], lists[i][1:])
            lists[i] = [head, *rest]
    sizes = np.fromiter(map(len, lists), np.int64, len(lists))
    coded = pa.array([p for own in lists for p in own], pa.string()).dictionary_encode()
    return coded.dictionary.to_pylist(), coded.indices.to_numpy(zero_copy_only=False), np.cumsum(sizes) - sizes, sizes


def _int32(raw: bytes) -> np.ndarray:
    return np.frombuffer(raw, "<u4").astype(np.int32)


class BatchEncoder:
    def __init__(self, vocabulary: Vocabulary):
        known = set(vocabulary.special.values())
        ranks = {t: i for i, t in enumerate(vocabulary.tokens) if i not in known}
        self.line = tiktoken.Encoding("parts", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.leads = np.array([t[:1] == b" " for t in vocabulary.tokens])
        self.special = list(vocabulary.special)
        self.single = Encoder(vocabulary, library=True)

    def _one(self, text: str) -> np.ndarray:
        """Ids of one text without special strings; a very long word is merged by a heap, in time n log n."""
        if len(text) < LONG:
            return self.line.encode_to_numpy(text).astype(np.int32)
        words = (self.line.encode_to_numpy(w) if len(w) < LONG else self.single.vocabulary.merge(w.encode()) for w in self.single.split(text))
        return np.concatenate([np.asarray(w, np.int32) for w in words])

    def _many(self, parts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of the parts in order, where each begins); no part is long or has a space inside."""
        ids = self.line.encode_to_numpy(" " + " ".join(parts)).astype(np.int32)
        at = np.flatnonzero(self.leads[ids])
        if len(at) != len(parts):
            raise ValueError("a part's ids do not fall apart")
        return ids, at

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts in order, ids a text); null is the empty text."""
        texts = pc.fill_null(texts, "")
        marked = np.zeros(len(texts), bool)
        for mark in self.special:
            marked |= pc.match_substring(texts, mark).to_numpy(zero_copy_only=False)
        ids, sizes = self._assembled(*parts_of(texts, marked))
        if marked.any():
            pieces = np.split(ids, np.cumsum(sizes)[:-1])
            for i in np.flatnonzero(marked).tolist():
                pieces[i] = _int32(self.single.encode([texts[i].as_py()])[0])
            ids, sizes = np.concatenate(pieces), np.fromiter(map(len, pieces), np.int64, len(pieces))
        return ids, sizes

    def _assembled(self, distinct: list[str], code: np.ndarray, heads: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        rest = np.ones(len(code), bool)
        rest[heads] = False
        used = np.zeros(len(distinct), bool)
        used[code[rest]] = True
        plain = used & np.fromiter((len(p) < LONG and " " not in p for p in distinct), bool, len(distinct))
        pool, start, size, held = [], np.zeros(len(distinct), np.int64), np.zeros(len(distinct), np.int64), 0
        if plain.any():
            ids, at = self._many([p for p, x in zip(distinct, plain.tolist()) if x])
            start[plain], size[plain] = at, np.diff(at, append=len(ids))
            pool, held = [ids], len(ids)

        def one(text: str) -> tuple[int, int]:
            nonlocal held
            own = self._one(text)
            pool.append(own)
            held += len(own)
            return held - len(own), len(own)

        for i in np.flatnonzero(used & ~plain).tolist():
            start[i], size[i] = one(" " + distinct[i])
        own, place = np.unique(code[heads], return_inverse=True)
        at = np.array([one(distinct[i]) for i in own.tolist()], np.int64).reshape(-1, 2)
        begins, lengths = start[code], size[code]
        begins[heads], lengths[heads] = at[place, 0], at[place, 1]
        ends = np.cumsum(lengths)
        index = np.repeat(begins - (ends - lengths), lengths)
        index += np.arange(len(index))
        ids = np.concatenate(pool).take(index) if pool else np.empty(0, np.int32)
        return ids, np.bincount(np.repeat(np.arange(len(sizes)), sizes), lengths, len(sizes)).astype(np.int64)


class LexiconEncoder(BatchEncoder):
    """The same with words from the automaton, or merged pair by pair where it has none."""

    def __init__(self, vocabulary: Vocabulary, mapped: Lexicon | None = None):
        self.special, self.single = list(vocabulary.special), Encoder(vocabulary, mapped)

    def _spelled(self, texts: list[str]) -> list[bytes]:
        encoder = self.single
        if len(encoder.words) > REMEMBERED:
            encoder.words = {}
        words = [encoder.split(t) for t in texts]
        encoder._learn({w for own in words for w in own})
        get = encoder.words.__getitem__
        return [get(own[0]) if len(own) == 1 else b"".join(map(get, own)) for own in words]

    def _one(self, text: str) -> np.ndarray:
        return _int32(self._spelled([text])[0])

    def _many(self, parts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        coded = self._spelled([" " + p for p in parts])
        sizes = np.fromiter(map(len, coded), np.int64, len(coded)) // 4
        return _int32(b"".join(coded)), np.cumsum(sizes) - sizes


def ended(ids: np.ndarray, sizes: np.ndarray, end: int) -> tuple[np.ndarray, np.ndarray]:
    """Each text's ids with ``end`` after them."""
    out = np.full(len(ids) + len(sizes), end, ids.dtype)
    out[np.arange(len(ids)) + np.repeat(np.arange(len(sizes)), sizes)] = ids
    return out, sizes + 1
