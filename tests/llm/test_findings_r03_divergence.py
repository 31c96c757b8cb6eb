"""op13's CPU seconds (round 3): words are dealt by arrays and the automaton's hits are numbers, counted together for a source."""

from __future__ import annotations

import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from corpusloom.llm import divergence, words


def texts(n: int) -> list[str | None]:
    rng = random.Random(8)
    return [None, "", " ", "a", "A b", "é", *("".join(rng.choice("abAB .,9é漢\n'") for _ in range(rng.randrange(80))) for _ in range(n)), "longer " * 40]


@pytest.mark.parametrize("run", [1, 60, 1 << 20])
def test_words_meet_their_terms(monkeypatch, run):
    monkeypatch.setattr(words, "RUN", run)
    monkeypatch.setattr(divergence, "RUN", run)
    given, slices = texts(300), [1, 2, 5]
    n = len(given)
    cols = [["en"] * n, [f"s{i % 7}" for i in range(n)], [slices[i % 3] for i in range(n)], [10 * (i % 2) for i in range(n)], [1 + i % 4 for i in range(n)], [-i for i in range(n)], given]
    kinds = [pa.string(), pa.string(), pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.string()]
    whole = pa.record_batch([pa.array(c, t) for c, t in zip(cols, kinds)], ["lang", "source", "slices", "first", "shares", "salt", "text"])
    for i in range(n):
        want, got = Counter(), Counter()
        for k, part in enumerate(words.runs(None if given[i] is None else given[i].encode(), divergence._TABLE)):
            want.update((10 * (i % 2) + (k - i) % (1 + i % 4), w.decode()) for w in part)
        terms = sorted({w for _, w in want})
        placed = pa.record_batch([pa.array(["en"] * len(terms), pa.string()), pa.array([slices[i % 3]] * len(terms), pa.int32()), pa.array([1] * len(terms), pa.int32()), pa.array(terms, pa.string())], ["lang", "slices", "shares", "term"])
        (placed,) = divergence._placed(iter([placed]))
        piece = dict(zip(placed.column(3).to_pylist(), placed.column(1).to_pylist()))
        for b in divergence._dealt(iter([whole.slice(i, 1)])):
            for r in b.to_pylist():
                assert r["lang"] == "en" and r["source"] == f"s{i % 7}"
                got.update((r["share"], w) for w in r["words"].split())
                assert all(piece[w] == r["piece"] < slices[i % 3] for w in r["words"].split())
        assert got == want
    # Many rows at once are dealt as each alone.
    rows = lambda bs: Counter(tuple(r.values())[:4] + (w,) for b in bs for r in b.to_pylist() for w in r["words"].split())
    assert rows(divergence._dealt(iter([whole]))) == sum((rows(divergence._dealt(iter([whole.slice(i, 1)]))) for i in range(n)), Counter())


@pytest.mark.parametrize(("passed", "held"), [(1, 1), (20, 3), (1 << 16, 500_000)])
def test_hits_are_counted_by_source(monkeypatch, passed, held):
    monkeypatch.setattr(divergence, "PASSED", passed)
    monkeypatch.setattr(divergence, "HELD", held)
    rng, rows, want = random.Random(2), [], Counter()
    for key in (("de", 0, 0), ("de", 0, 1), ("en", 1, 0), ("fr", 0, 0)):
        terms = [] if key[0] == "fr" else ["a", "bb", "é", "never"]
        rows += [(*key, None, t) for t in terms]
        for source in ("", "x", "y"):
            for _ in range(5):
                w = [rng.choice(["a", "bb", "b", "é", "aa"]) for _ in range(rng.randrange(1, 9))]
                rows.append((*key, source, " ".join(w) + rng.choice(["", " "])))
                want.update((key[0], source, x) for x in w if x in terms)
    kinds = [pa.string(), pa.int32(), pa.int32(), pa.string(), pa.string()]
    for size in (1, 7, len(rows)):
        batches = (pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows[i : i + size]), kinds)], ["lang", "piece", "share", "source", "words"]) for i in range(0, len(rows), size))
        got = Counter()
        for b in divergence._recounted(batches):
            for r in b.to_pylist():
                got[r["lang"], r["source"], r["term"]] += r["n"]
        assert got == want


def test_slices_are_of_like_size():
    terms = [f"{head}{i:x}".encode() for head in ("", "a long beginning that terms share") for i in range(20_000)]
    terms = [t.replace(b" ", b"") for t in terms]
    at = np.cumsum([0, *map(len, terms)])[:-1]
    for s in (2, 3, 7, 64):
        n = np.bincount(divergence._pieces(np.frombuffer(b"".join(terms), np.uint8), at, np.full(len(terms), s)), minlength=s)
        assert n.max() < 1.25 * len(terms) / s and n.min() > 0.75 * len(terms) / s
