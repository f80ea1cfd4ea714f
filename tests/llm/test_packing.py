import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from sievector.llm import packing

PATH = public_tokenizers.path("byte_bpe_50k.json")


@pytest.mark.parametrize("seed", range(6))
def test_histogram(seed):
    rng = random.Random(seed)
    capacity = rng.choice([8, 64, 512])
    histogram = {n: rng.randint(1, 50) for n in rng.sample(range(1, capacity), min(capacity - 1, 40))}
    patterns = packing.shortest_pack_first(histogram, capacity)
    placed = dict.fromkeys(histogram, 0)
    for count, slots in patterns:
        assert count > 0 and sum(n * each for n, each in slots) <= capacity
        for n, each in slots:
            placed[n] += count * each
    assert placed == histogram
    table = packing.slot_table(patterns)
    for n in histogram:
        own = table[table[:, 0] == n]
        ends = np.append(own[:, 1], histogram[n])
        assert ends[0] == 0 and (np.diff(ends) == own[:, 2] * own[:, 3]).all()


def test_no_pieces():
    assert packing.shortest_pack_first({}, 16) == [] and packing.slot_table([]).shape == (0, 6)


def checked(docs, found, capacity):
    """Every id in one piece, pieces gapless in their sequences."""
    library = Tokenizer.from_file(PATH)
    by_doc, by_sequence = {}, {}
    for r in found:
        by_doc.setdefault(r["doc_id"], []).append(r)
        by_sequence.setdefault(r["sequence_id"], []).append(r)
    want = {}
    for r in docs:
        want.setdefault(r["doc_id"], []).append(library.encode(r["text"] or "", add_special_tokens=False).ids + [1])
    assert by_doc.keys() == want.keys()
    for key, texts in want.items():
        pieces = [(p["start"], p["length"], p["ids_crc32"], p["doc_tokens"]) for p in by_doc[key]]
        expected = [(s, len(ids[s : s + capacity]), zlib.crc32(np.array(ids[s : s + capacity], "<u4").tobytes()), len(ids)) for ids in texts for s in range(0, len(ids), capacity)]
        assert sorted(pieces) == sorted(expected)
    padding = total = 0
    for rows in by_sequence.values():
        at = 0
        for r in sorted(rows, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at <= capacity
        total += at
        padding += 0 if at & (at - 1) == 0 else capacity - at
    return padding / max(1, total)


def test_operator(odd, none, clashing, documents):
    for docs, capacity in ((odd, 2048), (odd, 16), (clashing, 64), (documents, 2048)):
        share = checked(docs.collect(), packing.pack(docs, PATH, capacity).collect(), capacity)
    assert share < 0.02
    assert packing.pack(none, PATH).count() == 0
