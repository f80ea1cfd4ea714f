import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from sievector.llm import encoding, lexicon, subwords
from sievector.llm.queries import op1_bpe_encode, vocabulary_path

PATH = public_tokenizers.path("byte_bpe_50k.json")
ALPHABET = ["a", "b", "the", " ", "  ", "\n", "\t", " ", "\x1c", "\x85", "'s", "'", "1", "é", "😀", "<|endoftext|>", "!!", " the", "\r\n", " ", "-", "<|endof"]


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


@pytest.fixture(scope="module")
def vocabulary():
    return subwords.Vocabulary.load(PATH)


@settings(max_examples=300, deadline=None)
@given(parts=st.lists(st.one_of(st.sampled_from(ALPHABET), st.text(max_size=3)), max_size=12))
def test_encoding_equals_the_library(library, vocabulary, parts):
    text = "".join(parts).encode("utf-8", "ignore").decode()
    for encoder in (subwords.Encoder(vocabulary),):
        (ids,) = encoder.encode([text])
        want = library.encode(text, add_special_tokens=False).ids
        assert np.frombuffer(ids, "<u4").tolist() == want
        assert encoder.decode(ids) == library.decode(want, skip_special_tokens=False) == text


def test_compiled_merges_are_the_same(vocabulary):
    rng = random.Random(4)
    texts = ["".join(rng.choice(ALPHABET) for _ in range(30)) for _ in range(200)] + ["", "z" * 3000, "ab" * 700]
    assert subwords.Encoder(vocabulary).encode(texts) == subwords.Encoder(vocabulary, library=True).encode(texts)


def test_long_words_merge_alike(vocabulary):
    rng = random.Random(5)
    for n in (60, 64, 65, 200):
        word = bytes(rng.choice(b"abcdeth ") for _ in range(n))
        ids = [vocabulary.letters[b] for b in word]
        assert vocabulary._merge_long(list(ids)) == _slow(vocabulary, list(ids)) == vocabulary.merge(word)


def _slow(v, ids):
    while True:
        pairs = [(v.ranks.get(a << 20 | b, (1 << 60, 0)), i) for i, (a, b) in enumerate(zip(ids, ids[1:]))]
        if not pairs or min(pairs)[0][0] == 1 << 60:
            return ids
        (_, new), i = min(pairs)
        ids[i : i + 2] = [new]


@pytest.mark.parametrize("n", [0, 1, 2, 500])
def test_automaton(tmp_path, n):
    rng = random.Random(n)
    words = {bytes(rng.choice(b"abcxyz") for _ in range(rng.randint(1, 6))) for _ in range(n)}
    entries = {w: [len(w), *w] for w in words}
    path = tmp_path / "lexicon"
    path.write_bytes(lexicon.to_bytes(lexicon.build(entries)))
    held = lexicon.Lexicon(str(path))
    tried = sorted(words) + [b"", b"abcxyzabc", b"\xff", *[w + b"q" for w in words], *[w[:-1] for w in words]]
    for w, place in zip(tried, held.places(tried).tolist() if tried else []):
        assert (place >= 0) == (w in words)
        if place >= 0:
            assert held.ids(place).tolist() == entries[w]


def test_automaton_shares_suffixes():
    arrays = lexicon.build({a + b"ing": [1] for a in (b"s", b"r", b"k", b"w")})
    assert len(arrays["arc_key"]) == 4 + 3  # four first letters, one shared tail


def test_operator(spark, odd, none, clashing, library):
    for docs in (odd, clashing):
        got = encoding.encode(docs, PATH).collect()
        want = {(r["doc_id"], r["text"] or "") for r in docs.collect()}
        assert {(r["doc_id"], r["decoded"]) for r in got} == want and len(got) == docs.count()
        for r in got:
            assert np.frombuffer(r["ids"], "<u4").tolist() == library.encode(r["decoded"], add_special_tokens=False).ids
    assert encoding.encode(none, PATH).count() == 0


def test_query(spark, library):
    got = {r["doc_id"]: r for r in op1_bpe_encode(spark, "/root/testdata/sf0.001").collect()}
    for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect():
        ids = library.encode(r["text"], add_special_tokens=False).ids
        assert got[r["doc_id"]]["n_tokens"] == len(ids)
        assert got[r["doc_id"]]["ids_sha256"] == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert got[r["doc_id"]]["decoded_sha256"] == hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()
    assert vocabulary_path().endswith("byte_bpe_50k.json")
