"""Findings of round 4."""

from __future__ import annotations

import hashlib
import random

import duckdb
from pyspark.sql import functions as F

from corpusloom.functions import text as T
from corpusloom.operators import audit, benchmark, chunking, experiments
from corpusloom.plans import catalogue


def test_links_are_all_within_the_threshold(spark):
    """pairs that differ in the first 16 bits, and those of documents that share a fingerprint, were left out."""
    rng = random.Random(7)
    fps = [rng.getrandbits(64) for _ in range(12)]
    fps += [f ^ sum(1 << b for b in rng.sample(range(64), rng.randint(0, 5))) for f in fps for _ in range(6)] + [0, 0, 0, 1 << 63, 7]
    df = spark.createDataFrame([(k, f >> 32, f & 0xFFFFFFFF) for k, f in enumerate(fps)], "doc_id long, fp_hi long, fp_lo long")
    for threshold in (3, 1):
        want = sorted((a, b, (x ^ y).bit_count()) for b, y in enumerate(fps) for a, x in enumerate(fps[:b]) if (x ^ y).bit_count() <= threshold)
        assert sorted(tuple(r) for r in audit.near_duplicate_links(df, threshold).collect()) == want
    fewer = {tuple(r) for r in audit.near_duplicate_pairs(df).collect()}
    assert any((x ^ y).bit_count() <= 3 and (a, b, (x ^ y).bit_count()) not in fewer for b, y in enumerate(fps) for a, x in enumerate(fps[:b]))


def test_review_rows_of_all_links(spark, tmp_path):
    """rows as by SQL where exact duplicates are too few for the sample, and where they fill it."""
    for name, copies in (("few", 1), ("many", 30)):
        rng = random.Random(3)
        words = [f"w{k}x" for k in range(60)]
        texts = ["", None, "ab", "ab"] + [" ".join(rng.choices(words, k=300)) for _ in range(6)]
        texts += [t + f" tail {j}" for t in texts[4:] for j in range(4)] + ["Copy of a text that is long enough to be no short one"] * copies
        spark.createDataFrame([(k, t, "en", "s", len(t or "")) for k, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/{name}/documents.parquet")
        got = sorted(tuple(r) for r in catalogue.QUERIES["review_rows"](spark, f"{tmp_path}/{name}").collect())
        con = duckdb.connect()
        con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{tmp_path}/{name}/documents.parquet/*.parquet')")
        assert got == sorted(con.execute(catalogue.ORACLES["review_rows"]).fetchall()) and sum(r[0] == "duplicate" for r in got) == 20


def some_units(spark, n=40):
    rng = random.Random(11)
    words = ["alpha", "beta", "gamma", "that", "mention", "by ", "both red and blue", "par "]
    texts = ["\n".join(" ".join(rng.choices(words, k=12)) + rng.choice([". ", "; "]) + f"term{'abcdefghij'[k % 10]} is {rng.choice(words)} in part of it." for _ in range(4)) for k in range(n)]
    texts += ["\n".join(["Same beginning of a line " * 6 + f"end {j}" for j in (1, 2)] * 2), "", None, "too short", "  \t a line that has   uneven　space and is long enough \n" * 2]
    return spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "doc_id long, text string")


def test_units_within_their_rows(spark, monkeypatch):
    """units were sorted and shuffled with their texts each time they were read."""
    plans, plain = [], chunking.saved
    monkeypatch.setattr(chunking, "saved", lambda df, label="step": plans.append(df._jdf.queryExecution().executedPlan().toString()) or plain(df, label))
    docs = some_units(spark)
    told = lambda df: sorted(map(repr, df.collect()))
    for rows, moved in ((docs, False), (docs.unionByName(docs.limit(3).selectExpr("doc_id", "concat('Another ', text) AS text")), True), (docs.limit(0), False)):
        got = chunking.saved_units(rows)
        if not moved:
            assert told(got) == told(chunking.article_units(rows))
        assert got.count() == chunking.article_units(rows).count() and ("Exchange" in plans[-1]) == moved


def test_unanswerable_moves_no_texts(spark, monkeypatch):
    """texts met the terms by joins, and those without a term yet were written in each round."""
    columns, plain = [], experiments.saved
    monkeypatch.setattr(experiments, "saved", lambda df, label="step": columns.append(df.columns) or plain(df, label))
    rng = random.Random(5)
    names = [f"t{k}" for k in range(30)]
    units = [(d, p, " ".join(rng.sample(names, rng.choice([3, 29, 30])))) for d in range(12) for p in range(5)]
    terms = [(d, t) for d in range(12) for t in rng.sample(names, rng.choice([2, 25]))]
    df, known = spark.createDataFrame(units, "doc_id long, part int, text string"), spark.createDataFrame(terms, "doc_id long, term string")
    number = lambda x: int(hashlib.md5(x.encode()).hexdigest()[:15], 16)
    ring = sorted({t for _, t in terms}, key=lambda t: (number(t) % 256, number(t), t))
    want = {}
    for d, p, text in units:
        at = number(f"{d}:{p}") % len(ring)
        fits = next((t for t in ring[at:] + ring[:at] if t not in text and (d, t) not in set(terms)), None)
        if fits:
            want.setdefault((d, fits), p)
    told = lambda df: {(r["doc_id"], r["term"]): r["part"] for r in df.collect()}
    assert told(experiments.unanswerable_pairs(df, known)) == want and want
    assert not any("text" in c for c in columns)
    assert told(experiments.unanswerable_pairs(df, known, sent=0)) == want


def test_definition_terms(spark):
    """each sentence's questions of all kinds were made for its term."""
    units = chunking.article_units(some_units(spark))
    found = benchmark.candidates(units).where("question_type = 'definition'")
    want = found.select("doc_id", T.clean_term(F.regexp_extract("gold_answer", benchmark.LATIN.definition, 1)).alias("term"))
    got = sorted(map(tuple, benchmark.definition_terms(units).collect()))
    assert got == sorted(map(tuple, want.where("length(term) >= 2").collect())) and got


def test_quotas_are_filled_by_places(spark, monkeypatch):
    """all candidates were sorted and shuffled with their texts."""
    units = chunking.article_units(some_units(spark)).persist()
    told = lambda df: sorted(map(repr, df.collect()))
    columns, plain = {}, benchmark.saved
    monkeypatch.setattr(benchmark, "saved", lambda df, label="step": columns.setdefault(label, df.columns) and None or plain(df, label))
    for per_doc, per_type in ((2, 5), (6, 200), (1, 1000)):
        got = told(benchmark.quota_candidates(units, per_doc, per_type))
        assert got == told(benchmark.fill_quotas(benchmark.all_candidates(units), per_doc, per_type)) and got
    assert columns["picked"] == ["question_type", "doc_id", "part", "pos"]
    records = benchmark.benchmark_stage(units, 3)[0]
    assert records.where("answerable and size(gold_evidence) > 0 and gold_evidence[0].evidence_text is null").count() == 0 and records.count() > 3
