"""Long words in byte-level BPE, against the library, also with vocabularies whose ranks are in no order of learning."""

import base64
import random
import time

import pytest
import tiktoken

from corpusloom.llm import bytebpe


def library(ranks):
    one = tiktoken.Encoding("given", pat_str=bytebpe.PATTERN, mergeable_ranks=ranks, special_tokens={})._core_bpe
    return lambda w: ",".join(map(str, one.encode_single_piece(w.encode())))


def test_long_words(spark):
    own, rng = bytebpe.Codec(), random.Random(3)
    want, tokens = library(own.ranks), [t for t in map(lambda b: b.decode("utf-8", "ignore"), own.ranks) if len(t) > 1]
    words = ["".join(rng.choices(a, k=n)) for a in ("e", "ab", "tion", "-=", "0", "一二", "eéè") for n in (64, 65, 66, 101, 333)]
    words += ["".join(rng.choices(tokens, k=rng.randint(20, 60))) for _ in range(150)]
    for w, ids in zip(words, own.encode_words(words)):
        assert ids == want(w), w
    begun = time.monotonic()
    assert own.encode_words(["e" * 200_003])[0] == want("e" * 200_003) and time.monotonic() - begun < 60


@pytest.mark.parametrize("seed", range(4))
def test_ranks_in_any_order(spark, tmp_path, monkeypatch, seed):
    rng = random.Random(seed)
    tokens = {bytes([b]) for b in b"abc"}
    while len(tokens) < 60:
        tokens.add((rng.choice(sorted(tokens)) + rng.choice(sorted(tokens)))[:9])
    longer = [t for t in sorted(tokens) if len(t) > 1]
    rng.shuffle(longer)
    ranks = {t: n for n, t in enumerate([bytes([b]) for b in range(256)] + longer)}
    path = tmp_path / "odd.tiktoken"
    path.write_bytes(b"".join(base64.b64encode(t) + f" {n}\n".encode() for t, n in ranks.items()))
    monkeypatch.setattr(bytebpe, "LONG", 0)
    own, want = bytebpe.Codec(str(path)), library(ranks)
    words = ["".join(rng.choices("abc", k=rng.randint(2, 40))) for _ in range(400)]
    for w, ids in zip(words, own.encode_words(words)):
        assert ids == want(w), w
