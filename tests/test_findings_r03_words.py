"""Searches cut their words outside of Spark's expressions, and places in a corpus meet counts, not texts (findings F13, F19, F20, F21 of round 3)."""

from __future__ import annotations

import random
import re

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from corpusloom.functions import text as T
from corpusloom.operators import retrieval
from corpusloom.plans import catalogue as C

ODD = [None, "", " ", "a", "a b", "ab,cd.EF-9", "漢字kanji漢", "一鿿ꀀ䷿", "é1É2\x00z", "😀a😀", "x\ty\n\nz ", "　w v", "end漢", "漢", "1"]


def odd_texts(n: int) -> list[str | None]:
    rng = random.Random(5)
    return ODD + ["".join(rng.choice("aZ9 \n\t.,é漢一鿿ꀀ䷿😀_-<>") for _ in range(rng.randrange(60))) for _ in range(n)]


@pytest.mark.parametrize("cut", [1, 40, 1 << 22])
def test_words_are_those_of_the_patterns(monkeypatch, cut):
    monkeypatch.setattr(retrieval, "CUT", cut)
    texts = odd_texts(300)
    for kept, single, pattern in ((retrieval._ALNUM, True, "[A-Za-z0-9]+|[一-鿿]"), (retrieval._NO_GAP, False, r"[^ \n\t]+")):
        for given in (pa.array(texts), pa.array(["cut off", *texts], pa.large_string()).slice(1)):
            got = []
            for a, sizes, words in retrieval._words(given, kept, single):
                assert a == len(got)
                at, held = 0, [w.decode() for w in words.to_pylist()]
                for n in sizes.tolist():
                    got.append(held[at : at + n])
                    at += n
                assert at == len(held)
            assert got == [re.findall(pattern, t or "") for t in texts]
    assert not list(retrieval._words(pa.array([], pa.string()), retrieval._ALNUM, True))


def test_bm25_is_the_same_by_postings(spark, monkeypatch):
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(odd_texts(200) * 2)], "doc_id long, text string")
    asked = spark.createDataFrame([(1, "a 漢 9"), (2, "Z a a"), (3, "nowhere"), (4, "")], "query_id long, query_text string")
    places = docs.select("doc_id", (1000 - F.col("doc_id")).alias("corpus_pos"))
    numbered = docs.join(places, "doc_id")
    seen = lambda df: sorted((r["query_id"], r["rank"], r["doc_id"], round(r["score"], 9)) for r in df.collect())
    calls = [lambda: retrieval.bm25(docs, asked, 7), lambda: retrieval.bm25(numbered, asked, 7), lambda: retrieval.bm25(docs, asked, 7, places=places)]
    sent = [seen(f()) for f in calls]
    assert sent[1] == sent[2] != sent[0] and len(sent[0]) > 7
    monkeypatch.setattr(retrieval, "ASKED_ROWS", 0)
    assert [seen(f()) for f in calls] == sent


def test_texts_that_hold_a_passage(spark, tmp_path, monkeypatch):
    passages = ["one two three", "a longest b", "two", " x", "tab\tinner\nend", "漢 字母 漢", "a longest c"]
    texts = [None, "", "zero one two three four", "one twothree", "one two  three", "so a longest b and a longest c", "tab\tinner\nend two x", "漢 字母 漢", *passages, "one two three"]
    spark.createDataFrame(list(enumerate(passages)), "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    want = sorted((q, d) for q, p in enumerate(passages) for d, t in enumerate(texts) if t is not None and p in t)
    for most in (C.BROADCAST_QUESTIONS, 0):
        monkeypatch.setattr(C, "BROADCAST_QUESTIONS", most)
        assert sorted(map(tuple, C.relevant(spark, str(tmp_path)).select("query_id", "doc_id").collect())) == want


def test_corpus_order_shuffles_no_texts(spark, tmp_path, monkeypatch):
    """What is numbered has no text, so what the order moves does not grow with the texts' lengths."""
    from corpusloom.plans import further

    spark.createDataFrame([(1, "one two three")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    spark.createDataFrame([(i, "two", f"s{i % 2}") for i in range(6)], "doc_id long, text string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    seen, numbered = [], further.numbered
    monkeypatch.setattr(further, "numbered", lambda df, *order: seen.append(df.columns) or numbered(df, *order))
    got = further.bm25_corpus_order(spark, str(tmp_path)).orderBy("rank").collect()
    assert [r["doc_id"] for r in got] == [4, 2, 0, 5, 3, 1] and all("text" not in c for c in seen)


def test_texts_without_tags(spark):
    texts = [(t,) for t in [None, "", "a < b", "a > b", "<b>x</b>y<", "<>", "<a\nb>c", "plain"]]
    got = spark.createDataFrame(texts, "t string").select(T.without_tags(F.col("t"))).collect()
    assert [r[0] for r in got] == [re.sub("<[^>]+>", " ", t or "") for (t,) in texts]
