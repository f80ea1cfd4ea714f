"""Words of Arrow batches: lower-cased, counted and coded once per distinct word of a batch."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import tiktoken


@dataclass
class Words:
    """Words of a batch of texts: ``of`` is the text of each, ``code`` its number among the ``distinct`` ones."""

    distinct: pa.StringArray
    code: np.ndarray
    of: np.ndarray
    texts: int

    def spelled(self) -> list[str]:
        return self.distinct.to_numpy(zero_copy_only=False).tolist()

    def lengths(self) -> np.ndarray:
        return np.bincount(self.of, minlength=self.texts)


def words(texts: pa.Array) -> Words:
    """A-Z become small letters; words are what stands between spaces and the control characters 9 to 13.  Null is empty."""
    parts = pc.ascii_split_whitespace(pc.ascii_lower(pc.fill_null(texts, "")))
    flat, of = parts.flatten(), np.repeat(np.arange(len(texts)), pc.list_value_length(parts).to_numpy(zero_copy_only=False))
    full = pc.not_equal(flat, "")
    if not pc.all(full, min_count=0).as_py():
        flat, of = flat.filter(full), of[full.to_numpy(zero_copy_only=False)]
    coded = flat.dictionary_encode()
    return Words(coded.dictionary, coded.indices.to_numpy(zero_copy_only=False), of, len(texts))


class Coder:
    """Subword ids of words, each with its leading space.

    All distinct words of a batch go through the library in one line.  A word's first id is the only one that
    begins with a space, so the ids fall apart into words again.
    """

    def __init__(self, tokens: list[bytes], special: dict[str, int]):
        known = set(special.values())
        ranks = {t: i for i, t in enumerate(tokens) if i not in known}
        self.line = tiktoken.Encoding("words", pat_str=r" [^ ]+", mergeable_ranks=ranks, special_tokens={})
        self.leads = np.array([t[:1] == b" " for t in tokens])

    def ids(self, found: Words) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all words in order, ids a text)."""
        if not len(found.code):
            return np.empty(0, np.int32), np.zeros(found.texts, np.int64)
        one = pa.ListArray.from_arrays(pa.array([0, len(found.distinct)], pa.int32()), found.distinct)
        pool = self.line.encode_to_numpy(" " + pc.binary_join(one, " ")[0].as_py()).astype(np.int32)
        starts = np.flatnonzero(self.leads[pool])
        if len(starts) != len(found.distinct):
            raise ValueError("a word's ids do not fall apart")
        size = np.diff(starts, append=len(pool)).take(found.code)
        ends = np.cumsum(size)
        at = np.repeat((starts.take(found.code) - (ends - size)).astype(np.int32), size)
        at += np.arange(len(at), dtype=np.int32)
        return pool.take(at), np.bincount(found.of, size, found.texts).astype(np.int64)
