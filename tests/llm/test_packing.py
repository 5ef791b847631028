"""Ids of the packing operator against the tokenizer on whole texts."""

import random

import numpy as np
import pyarrow as pa
import pytest

from foliant.llm import bpe, packing, queries

PARTS = [*"aaeehrsstdmlJHTWYIKAEN''''\"-.,<>=|019 \t\n\r\x0b\x0c\x1c\x85\xa0\x00\x7f", *"éÉßÿ÷×ñàªºµ²½ÅΣςſİıK日本ไท가ﬁǅ٣😀’“ ​"]
PARTS += [*"̸̱́̌̈̇ͅ", "'s", "'re", "'ll", "don't", "l'eau", " the ", " street"]


@pytest.fixture(scope="module")
def encoder():
    with open(queries.tokenizer_path()) as file:
        return packing.WordTokenizer(file.read())


def check(encoder, texts, special=False):
    bounds, ids = encoder.ids(pa.array(texts, pa.string()), 1, special)
    for k, t in enumerate(texts):
        assert ids[bounds[k] : bounds[k + 1]].tolist() == [*encoder.tokenizer.encode(t or "", add_special_tokens=False).ids, 1], repr(t)


def test_capital_before_mark(encoder):
    """NFC comes before lower case: these capitals don't compose with their marks, the small letters would."""
    check(encoder, ["J̌", "H̱x", "a T̈.", "W̊Y̊", "J̌ ǰ J j"])


def test_odd_texts(encoder):
    rng = random.Random(5)
    texts = ["".join(rng.choices(PARTS, k=rng.randint(0, 30))) for _ in range(4000)]
    texts = [t for t in texts if "<|" not in t]
    check(encoder, [None, "", " ", *texts, "", None])
    check(encoder, ["", None, "\t "])
    check(encoder, [])


def test_long_words(encoder):
    rng = random.Random(6)
    check(encoder, ["".join(rng.choices("abcdeé", k=k)) for k in range(1, 140)] + ["a" * k for k in range(1, 140)] + ["!" * k for k in range(1, 140)])


def test_added_tokens(encoder):
    check(encoder, ["A <|endoftext|>B", "x<|ENDOFTEXT|>", "<|startoftext|><|endoftext|>", None], special=True)


def test_plain_words_stay_off_the_tokenizer(encoder):
    """Each distinct word was a call of the tokenizer, which took most of the time; plain ones are merged as arrays."""
    fresh = packing.WordTokenizer(encoder.tokenizer.to_str())
    rng = random.Random(7)
    words = ["".join(rng.choices("abcdefghinorstuéäñ", k=rng.randint(1, 14))) for _ in range(3000)]
    check(fresh, [" ".join(w + rng.choice(["", ",", ".", "!!", "12"]) for w in words)])
    assert not fresh.newer


def test_blocks(encoder, monkeypatch):
    monkeypatch.setattr(bpe, "BLOCK", 3)
    monkeypatch.setattr(packing, "WORDS_PLACED", 5)
    check(encoder, ["one two, three four's 567 éléphant naïve", "", "x" * 70 + " internationalisation of everything", None, "end"])


def test_other_tokenizers(encoder):
    """A tokenizer of another kind has no merges here and is asked for every word."""
    assert encoder.merges is not None
    import json

    spec = json.loads(encoder.tokenizer.to_str())
    spec["normalizer"]["normalizers"].pop()
    other = packing.WordTokenizer(json.dumps(spec))
    assert other.merges is None
    check(other, ["The Same, words J̌", None, "don't"])


def test_pieces_of_mixed_batches(spark):
    """Texts with and without names of added tokens in one batch."""
    texts = ["plain Text", "A <|endoftext|> b", None, "more", "C<|startoftext|>d"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1)
    got = {r.doc_id: r.ids for r in packing.tokenised_pieces(docs, queries.tokenizer_path(), keep_ids=True).collect()}
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(queries.tokenizer_path())
    assert got == {k: [*tokenizer.encode(t or "", add_special_tokens=False).ids, 1] for k, t in enumerate(texts)}


def test_merges_table(encoder):
    """Every pair of the file is found, with its rank; others aren't."""
    import json

    model = json.loads(encoder.tokenizer.to_str())["model"]
    a, b = (np.array([model["vocab"][m[i]] for m in model["merges"]], np.int32) for i in (0, 1))
    assert (encoder.merges.rank(a, b) == np.arange(len(a))).all()
    pairs = set(zip(a.tolist(), b.tolist(), strict=True))
    rng = np.random.default_rng(1)
    x, y = rng.integers(0, len(model["vocab"]), (2, 50_000)).astype(np.int32)
    assert ((encoder.merges.rank(x, y) != bpe.NONE) == [p in pairs for p in zip(x.tolist(), y.tolist(), strict=True)]).all()
