"""op7's CPU seconds (round 3): a word is learned once, whatever its case and the marks after it, and looked up once for many texts."""

from __future__ import annotations

import random

import numpy as np
import pyarrow as pa
import pytest

from corpusloom.llm import packing


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(packing.TOKENIZER)
    return lambda x: t.encode(x or "", add_special_tokens=False).ids


def test_words_are_learned_once():
    words = packing._Words(packing.TOKENIZER)
    list(words.each(pa.array(["The the THE, the.\nthe", None, "", "THE! the, the"])))
    assert set(words.known) == {"the", ",", ".", "!"}


@pytest.mark.parametrize("cut", [1, 60, 1 << 22])
@pytest.mark.parametrize("remembered", [8, packing.REMEMBERED])
def test_ids_of_a_column(library, monkeypatch, cut, remembered):
    monkeypatch.setattr(packing, "CUT", cut)
    monkeypatch.setattr(packing, "PIECE", 20)
    rng = random.Random(3)
    parts = ["The", "the", "it's", "IT'S", "'S.", "don't,", "a.b", "x!?", "<|endoftext|>", "<|ENDOFTEXT|>", "and<|startoftext|>.", "é.", "É", "Σίσυφος", "ΟΔΟΣ.", "Ὀδός", "é,", "É", "İ.", "9.5", "a9", "漢字.", "\t", "\n", "  ", "a_b", "a|b", "a`b", "😀", "Ǩ-"]
    texts = [None, "", " ", "\n", *("".join(rng.choice(parts) + rng.choice(["", " "]) for _ in range(rng.randrange(12))) for _ in range(400))]
    words = packing._Words(packing.TOKENIZER, remembered)
    for given in (pa.array(texts), pa.array(["cut off", *texts], pa.large_string()).slice(1)):
        got = [np.frombuffer(b, "<u4").tolist() for b in words.each(given)]
        assert got == [library(t) for t in texts]
    assert not list(words.each(pa.array([], pa.string())))
