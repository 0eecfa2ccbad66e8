"""Cut and remembered pieces against the tokenizer on whole texts."""

import array
from pathlib import Path

import public_tokenizers
import pyarrow.parquet as pq
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from voxtable.llm.tokens import Encoder, encoder

KINDS = [("word_bpe_49k.json", "words"), ("byte_bpe_50k.json", "spaces")]
ODD = [
    "", " ", "\n", "a", " a", "a ", "a  b", "a\n\nb", "a \n b", "it's, we'll. THE End.", "x).\ny,", "1,000.5 and 3.", "<|endoftext|> a<|endoftext|>",
    "İstanbul ΣΑΣ. é, É.", "é. É,", "a\x1fb. c", "a b. c", "word.", "word.,", "..., ,", "\t a.\tb", "# $ x.y,z", "a" * 300,
]


def whole(tokenizer, text):
    return array.array("I", tokenizer.encode(text, add_special_tokens=False).ids).tobytes()


@pytest.mark.parametrize("file,cut", KINDS)
def test_odd_texts(file, cut):
    path = public_tokenizers.path(file)
    tokenizer = Tokenizer.from_file(path)
    assert encoder(path, cut).encode(ODD) == [whole(tokenizer, t) for t in ODD]


@pytest.mark.parametrize("file,cut", KINDS)
@settings(max_examples=60, deadline=None)
@given(text=st.text(alphabet=" \n.,'aAsSéİΣ́̇11\x1f -\"(", max_size=30))
def test_random_texts(file, cut, text):
    path = public_tokenizers.path(file)
    assert encoder(path, cut).encode([text])[0] == whole(_kept(path), text)


def test_missing_pieces_are_encoded_together():
    """New words cost a few texts for the tokenizer, not one each; their ids are cut apart again."""
    path = public_tokenizers.path("byte_bpe_50k.json")
    words = [f"{a}{b}{c}" for a in ("Qua", "zé", "\u0120x", "<|endoftext|>") for b in "aeiouy" for c in ("rn", "l.", "k%%%", "'s", "0,7")]
    texts = [" ".join(words), "\n".join(words), "a\t" + "  ".join(words), " b  " + "\x85".join(words)]
    made, sent = Encoder(path, "spaces"), []
    real = made.tokenizer

    class Counting:
        def encode_batch_fast(self, some, **how):
            sent.extend(some)
            return real.encode_batch_fast(some, **how)

    made.tokenizer = Counting()
    assert made.encode(texts) == [whole(real, t) for t in texts]
    assert len(sent) < len(words) // 8
    assert made.encode(texts[:2]) == [whole(real, t) for t in texts[:2]]


_tokenizers = {}


def _kept(path):
    return _tokenizers.setdefault(path, Tokenizer.from_file(path))


@pytest.mark.skipif(not Path("/root/testdata/sf0.01").exists(), reason="needs the given tables")
@pytest.mark.parametrize("file,cut", KINDS)
def test_documents(file, cut):
    texts = pq.read_table("/root/testdata/sf0.01/documents.parquet")["text"].to_pylist()
    path = public_tokenizers.path(file)
    got = encoder(path, cut).encode(texts)
    found = _kept(path).encode_batch_fast(texts, add_special_tokens=False)
    assert [i for i, x in enumerate(found) if got[i] != array.array("I", x.ids).tobytes()] == []
