"""Runs of spaces: encoding in units equals one Viterbi over the whole text."""

import random

import pytest

pytest.importorskip("limen.llm")
P = pytest.importorskip("public_tokenizers")

from limen.llm import unigram  # noqa: E402


def test_runs_of_spaces_are_encoded_as_in_the_whole_text():
    m = unigram.model(P.path("piece_bpe_32k.model"))
    rng = random.Random(6)
    gap = lambda: " " * rng.choice([0, 1, 2, *range(3, 21)])
    texts = [f"{' ' * a}of{' ' * b}the house{' ' * c}" for k in range(1, 21) for a, b, c in ((k, 1, 0), (0, k, 0), (0, 1, k), (k, k, k))]
    texts += [gap() + "".join(rng.choice(["def", "x", "the", "\n", "é"]) + gap() for _ in range(6)) for _ in range(60)] + [" ", "   ", " " * 70, "\u2581 \u2581a"]
    for t in texts:
        ids = m.encode(t)
        assert ids.tolist() == m.viterbi("\u2581" + t.replace(" ", "\u2581")), repr(t)
        assert m.decode(ids) == t.replace("\u2581", " ")
