"""A run without a space takes time in proportion to its length."""

import time

import pytest

pytest.importorskip("limen.llm")
P = pytest.importorskip("public_tokenizers")

from limen.llm import unigram  # noqa: E402


@pytest.mark.parametrize("letter", ["a", " ", "é"])
def test_two_million_letters(letter):
    m = unigram.model(P.path("piece_bpe_32k.model"))
    m.encode("warm up")
    began = time.time()
    ids = m.encode(letter * 2_000_000)
    assert time.time() - began < 60
    assert m.decode(ids) == letter * 2_000_000
