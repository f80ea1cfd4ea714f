import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from sievector.llm import lexicon
from sievector.llm.batch_encoder import BatchEncoder, LexiconEncoder, ended
from sievector.llm.subwords import Vocabulary

PATH = public_tokenizers.path("byte_bpe_50k.json")
ODD = [
    "", "a", " a", "a  b", "  ", "\n", "a\n b \n\n c ", "x" * 3000, "w " * 700 + "y" * 600 + " z", "<|endoftext|> hi <|endoftext|>", "Ünï 😀 'll don't  12 3",
    "a\u3000b\u2003 c\xa0 d", "\x1c a \x1d b", " \t\tq", "end ", "<|endoftext|>", "é" * 600 + " tail", " " * 2000 + "x", "b " + " " * 700,
]


@pytest.fixture(scope="module", params=["library", "merged", "lexicon"])
def encoder(request, tmp_path_factory):
    """Through the library, by merges alone, and with the automaton of a few words."""
    vocabulary = Vocabulary.load(PATH)
    if request.param == "library":
        return BatchEncoder(vocabulary)
    if request.param == "merged":
        return LexiconEncoder(vocabulary)
    path = tmp_path_factory.mktemp("lexicon") / "words"
    path.write_bytes(lexicon.to_bytes(lexicon.build({w: vocabulary.merge(w) for w in (b" the", b" of", b"plain", b" here", b"\n", b"  ")})))
    return LexiconEncoder(vocabulary, lexicon.Lexicon(str(path)))


def test_as_the_library(encoder, documents):
    library = Tokenizer.from_file(PATH)
    texts = [r["text"] for r in documents.collect()]
    for batch in ([*ODD, None], texts, ["plain words here"], [t for t in ODD if "  " not in t], []):
        ids, sizes = encoder.encode(pa.array(batch, pa.string()))
        assert len(sizes) == len(batch) and sizes.sum() == len(ids)
        for text, own in zip(batch, np.split(ids, np.cumsum(sizes)[:-1])):
            assert own.tolist() == library.encode(text or "", add_special_tokens=False).ids


def test_ended():
    ids, sizes = ended(np.array([5, 6, 7]), np.array([2, 0, 1]), 9)
    assert ids.tolist() == [5, 6, 9, 9, 7, 9] and sizes.tolist() == [3, 1, 2]
