"""Known answers for the library's operators."""

import json
import math
import re

import pytest
from pyspark.sql import functions as F

from corpusloom.functions import text as T
from corpusloom.functions.presets import ZH
from corpusloom.operators import audit, benchmark, chunking, cleaning, context, evaluation, models, retrieval
from corpusloom.sources import records
from corpusloom.streaming import ingest


def one(spark, column, **values):
    df = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} string" for k in values))
    return df.select(column.alias("x")).first()["x"]


@pytest.mark.parametrize(
    ("given", "want"),
    [("2024-01-02", 2024), ("1734962960000", 2024), ("1734962960", 2024), ("in 1850", None), (None, None), ("no", None), ("99999999999999999999", None)],
)
def test_extract_year(spark, given, want):
    assert one(spark, T.extract_year(F.col("t")), t=given) == want


def test_normalize_text(spark):
    assert one(spark, T.normalize_text(F.col("t")), t="　a <p>b</p>\x1c c\n\n d ") == "a b c d"
    assert one(spark, T.normalize_text(F.col("t")), t=None) == ""


def test_text_functions(spark):
    assert one(spark, T.tokens(F.col("t")), t="Étion 12 第一") == ["tion", "12", "第", "一"]
    assert one(spark, T.char_ngrams(F.col("t")), t="a b\ncd") == ["abc", "bcd"]
    assert one(spark, T.char_ngrams(F.col("t")), t="a b") == ["ab"] and one(spark, T.char_ngrams(F.col("t")), t=" ") == []
    assert one(spark, T.repeated_line_ratio(F.col("t")), t="a\nb\na \n\nc") == 0.5
    assert one(spark, T.low_information_ratio(F.col("t")), t="aaab") == 0.5 and one(spark, T.low_information_ratio(F.col("t")), t="") == 1.0
    assert one(spark, T.split_sentences(F.col("t")), t="One. Two!  \n three") == ["One.", "Two!", "three"]
    assert one(spark, T.longest_overlap(F.col("a"), F.col("b")), a="xxhello worldyy", b="say hello world!") == "hello world"
    assert one(spark, T.sub_once(F.col("t"), "b+"), t="aBb b") == "a b" and one(spark, T.clean_term(F.col("t")), t="term (x), ") == "term"
    assert one(spark, T.is_probably_garbled(F.col("t")), t="ok �") and not one(spark, T.is_probably_garbled(F.col("t")), t=None)
    assert one(spark, T.structure_hints(F.col("t"), ZH.hints), t="第二章 第一章 第二章") == ["第一章", "第二章"]
    assert len(one(spark, T.split_articles(F.col("t"), ZH.article), t="x第一条 a第二条 b")) == 2


def test_payloads(spark):
    for given, status in (('{"a": 1}', "strict"), ('<think>{</think>so {"a": 1} ok', "sliced"), ("none", "fallback"), ('<think> {"a"', "fallback"), (None, "fallback")):
        assert one(spark, T.parse_status(F.col("t")), t=given) == status


def test_fixed_windows(spark):
    df = spark.createDataFrame([(1, "x" * 700), (2, ""), (3, None)], "doc_id long, normalized_text string")
    got = chunking.fixed_windows(df, 300, 50).orderBy("chunk_index").collect()
    assert len(got) == 3 and len(got[0]["text"]) == 300 and got[1]["start_char"] == 250
    with pytest.raises(ValueError, match="overlap"):
        chunking.fixed_windows(df, 50, 50)


def test_packed_sentences():
    p = re.compile("[^。]+[。]?")
    text = "一二三四五六七。" * 3
    assert chunking.pack_sentences(text, 14, 4, p) == [(0, 8), (8, 16), (16, 24)]
    assert chunking.pack_sentences("", 14, 4, p) == [] and chunking.pack_sentences("abc", 500, 100, p) == [(0, 3)]
    many = chunking.pack_sentences("短句子。" * 36, 50, 20, p)
    assert many[-1][1] == 144 and all(a[0] < b[0] for a, b in zip(many, many[1:]))


def test_structure(spark):
    df = spark.createDataFrame([(1, "第一章 总则第一条 甲。第二章 附则第三条 乙。"), (2, None)], "doc_id long, text string")
    got = chunking.structure_chunks(df, 12, 2, preset=ZH).collect()
    assert ["第二章", "第三条"] in [r["section_path"] for r in got]


def test_duplicates_and_anomalies(spark):
    raw = [("a", 1, "same\nbody"), ("b", 2, "same  body"), ("c", 3, "other text that is long enough to be no short one at all"), ("d", 4, None), ("e", 5, "x\nx")]
    docs = audit.build_documents(spark.createDataFrame([(i, t, s) for s, i, t in raw], "doc_id long, text string, source string"))
    assert [r["doc_ids"] for r in audit.exact_duplicates(docs, F.col("normalized_text"), "body").collect()] == ["1|2"]
    found = {(r["doc_id"], r["anomaly"]) for r in audit.anomalies(docs).collect()}
    assert {(4, "empty_body"), (1, "very_short_body"), (5, "template_repetition")} <= found and (4, "very_short_body") not in found
    assert {r["bucket"]: r["n"] for r in audit.length_histogram(docs).collect()}["0"] == 1


def test_cleaning(spark):
    docs = audit.build_documents(spark.createDataFrame([(1, "Copied from: The Daily  the body text", "s"), (2, None, None)], "doc_id long, text string, source string"))
    got = {r["doc_id"]: r for r in cleaning.apply_cleaning(docs, leading=["copied from: the daily"], aliases={"s": "S"}).collect()}
    assert got[1]["cleaned_text"] == "the body text" and got[1]["canonical_source"] == "S" and "source_alias_applied" in got[1]["cleaning_actions"]
    assert got[1]["quality_flags"] == ["cleaned_text_too_short"] and got[2]["canonical_source"] is None


def test_bm25(spark):
    docs = [(1, "apple pear"), (2, "apple apple plum"), (3, "fig"), (4, None)]
    hits = retrieval.bm25(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame([(1, "apple apple x"), (2, None)], "query_id long, query_text string"), 5).collect()
    avg, n = 6 / 4, 4
    score = lambda tf, dl: 2 * math.log(1 + (n - 2 + 0.5) / 2.5) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avg))
    want = sorted([(1, score(1, 2)), (2, score(2, 3))], key=lambda x: -x[1])
    assert [(r["doc_id"], round(r["score"], 9)) for r in sorted(hits, key=lambda r: r["rank"])] == [(d, round(s, 9)) for d, s in want]


def test_fusion(spark):
    a = spark.createDataFrame([(1, 11, 1, 3.0), (1, 12, 2, 1.0)], "query_id long, doc_id long, rank int, score double")
    b = spark.createDataFrame([(1, 12, 1, 9.0), (1, 11, 2, 9.0), (1, 13, 3, 9.0)], "query_id long, doc_id long, rank int, score double")
    assert [r["doc_id"] for r in retrieval.rrf(a, b, 2).orderBy("rank").collect()] == [11, 12]
    fused = {r["doc_id"]: r["score"] for r in retrieval.fuse_scores(a, b, 5).collect()}
    assert fused == {11: 1.0, 12: 0.5, 13: 0.5}


def test_query_variants(spark):
    q = spark.createDataFrame([(1, "a b")], "query_id long, query_text string")
    g = spark.createDataFrame([(1, "hyde", "long"), (1, "multi_query", "ab"), (1, "multi_query", "c")], "query_id long, source string, text string")
    assert [r["text"] for r in retrieval.query_variants(q, g).orderBy("variant_no").collect()] == ["a b", "c", "long"]


def test_contexts(spark):
    rows = [(1, "q one", k, 10 + k, s, t, 5.0, "t") for k, s, t in ((1, "d1", "Alpha beta. One q."), (2, "d1", "Alpha beta. One q. More"), (3, "d1", "Third."), (4, "d2", "Alpha"))]
    hits = spark.createDataFrame(rows, "query_id long, query_text string, rank int, doc_id long, source string, text string, score double, title string")
    assert [r["doc_id"] for r in context.select_contexts(hits, 3, 2).orderBy("rank").collect()] == [11, 12, 14]
    assert [r["doc_id"] for r in context.dedupe_contexts(hits).orderBy("rank").collect()] == [11, 13, 14]
    assert context.compress_contexts(hits, 1, 2).orderBy("rank").collect()[0]["text"] == "One q."
    q = spark.createDataFrame([(1, "q one"), (2, "none")], "query_id long, query_text string")
    got = {r["query_id"]: r for r in context.extractive_answers(hits, q, 2, 3, 1.0).collect()}
    assert got[1]["answer"] == "Alpha beta. One q. More" and got[2]["abstained"] and got[2]["used"] == []
    assert "[1] t (11)" in context.context_block(hits).first()["block"]


def test_guardrails(spark):
    df = spark.createDataFrame([("no brackets", False, 9.0)], "answer string, abstained boolean, top double")
    r = df.select(context.guardrail_reasons(F.col("answer"), F.col("abstained"), F.col("top"), F.lit(1.0), 1.0, 0.5)).first()[0]
    assert r == ["missing_citation"]


def test_metrics(spark):
    hits = spark.createDataFrame([(1, 11, 1), (2, 99, 1), (2, 21, 2)], "query_id long, doc_id long, rank int")
    rel = spark.createDataFrame([(1, 11), (1, 12), (2, 21), (2, 22)], "query_id long, doc_id long")
    q = spark.createDataFrame([(1,), (2,), (3,)], "query_id long")
    m = {r["query_id"]: r for r in evaluation.retrieval_metrics(hits, rel, q, (1, 2)).collect()}
    assert (m[1]["recall_1"], m[1]["precision_1"], m[1]["ndcg_1"], m[1]["mrr"]) == (0.5, 1.0, 1.0, 1.0)
    assert m[2]["recall_2"] == m[2]["precision_2"] == 0.5 and 0 < m[2]["ndcg_2"] < 1 and m[3]["mrr"] == 0.0
    a = spark.createDataFrame([(1, "the answer", False, [1])], "query_id long, answer string, abstained boolean, used array<long>")
    g = spark.createDataFrame([(1, "the answer", [1, 2], True, "t")], "query_id long, reference string, supporting array<long>, answerable boolean, question_type string")
    r = evaluation.generation_metrics(a, g).first()
    assert (r["answer_correctness"], r["citation_precision"], r["citation_recall"], r["abstain_accuracy"]) == (1.0, 1.0, 0.5, 1.0)


def test_benchmark(spark):
    units = spark.createDataFrame([(1, 0, "a thing is a word of that sort. Nothing here to see. The tionword."), (2, 0, "a thing is another one of that kind.")], "doc_id long, part int, text string")
    found = benchmark.candidates(units)
    kinds = {(r["doc_id"], r["question_type"]) for r in found.collect()}
    assert {(1, "definition"), (1, "condition"), (1, "procedure"), (2, "definition")} <= kinds
    final = benchmark.final_selection(benchmark.lexical_dedup(found), 1).collect()
    assert sorted(r["question_type"] for r in final) == ["condition", "definition", "procedure"] and benchmark.semantic_dedup(found).count() <= found.count()


def test_raw_records(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('{"title": "t", "contentText": "", "content": "c", "other": 1}\n\n{"title": "u"}\n')
    (tmp_path / "b.json").write_text(json.dumps([{"title": "v"}]))
    (tmp_path / "c.json").write_text(json.dumps({"data": [{"title": "w"}]}))
    (tmp_path / "d.json").write_text('{"title": "x"}\n{"title": "y"}')
    got = {r["doc_id"]: r for r in records.read_raw(spark, str(tmp_path)).collect()}
    assert {k: v["title"] for k, v in got.items()} == {"a.jsonl:0": "t", "a.jsonl:2": "u", "b.json:0": "v", "c.json:0": "w", "d.json:0": "x", "d.json:1": "y"}
    assert got["a.jsonl:0"]["content_text"] == "c" and json.loads(got["a.jsonl:0"]["extra"])["other"] == 1
    with pytest.raises(ValueError, match="json"):
        records.read_raw(spark, "x.csv")


def test_tables(spark, tmp_path):
    hits = spark.createDataFrame([("q", 2, "c2", 1.0), ("q", 1, "c1", 2.0)], "query_id string, rank int, chunk_id string, score double")
    queries = spark.createDataFrame([("q", "t"), ("r", "u")], "query_id string, query_text string")
    records.write_table(records.nest_hits(hits, queries), str(tmp_path / "r"))
    flat = records.flat_hits(records.read_table(spark, records.RESULT, str(tmp_path / "r")))
    assert sorted((r["query_id"], r["rank"] or 0, r["chunk_id"]) for r in flat.collect()) == [("q", 1, "c1"), ("q", 2, "c2"), ("r", 0, None)]
    assert "| q | t |" in records.markdown("x", {"s": queries})


def test_model_hooks(spark):
    q = spark.createDataFrame([(1, "a b", "ctx")], "query_id long, query_text string, text string")
    v = models.embed(q, models.hashing_encoder).first()["embedding"]
    assert abs(sum(x * x for x in v) - 1) < 1e-5
    assert models.cross_scores(q, lambda: lambda a, b: [float(len(x)) for x in a]).first()["score"] == 3.0
    assert [r["text"] for r in models.expand(q, lambda: lambda p: 'ok {"queries": ["x", "y"]}', 1).collect()] == ["x"]


def test_stream(spark, tmp_path):
    src = tmp_path / "in"
    src.mkdir()
    (src / "a.json").write_text('{"doc_id": 1, "text": "one two", "source": "s", "ts": "2024-01-01T00:00:00Z"}\n{"doc_id": 2, "text": " one  two", "source": "s", "ts": "2024-01-01T00:01:00Z"}\n')
    run = ingest.first_seen(ingest.read_stream(spark, str(src))).writeStream.format("memory").queryName("seen").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    run.awaitTermination(120)
    assert spark.table("seen").count() == 1


def test_queries_match_their_sql(spark):
    import os

    import duckdb

    from corpusloom.plans.catalogue import ORACLES, QUERIES

    sf = "/root/testdata/sf0.001"
    if not os.path.isdir(sf):
        pytest.skip("no test data")
    db = duckdb.connect()
    for t in ("documents", "benchmark", "pages", "events", "embeddings", "conversations"):
        db.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    for name in ("norm_documents", "anomalies", "clean_documents", "chunk_fixed_windows", "bm25_topk", "retrieval_metrics", "guardrails", "candidate_filter"):
        mine, other = QUERIES[name](spark, sf).toPandas(), db.sql(ORACLES[name]).df()
        cols = sorted(mine.columns)
        assert cols == sorted(other.columns)
        assert sorted(map(repr, mine[cols].astype(object).values.tolist())) == sorted(map(repr, other[cols].astype(object).values.tolist())), name


def test_entry():
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries()) and "bm25_topk" in e.queries()
