"""Distributed greedy deduplication, the term ring, adjacent comparisons, hybrid and vector retrieval, ordered reading, merged chunks and auto evaluation."""

import json
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpusloom.operators import answers, benchmark, chunking, context, experiments, retrieval
from corpusloom.plans.stages import STAGES
from corpusloom.sources import records, shared


def grams(q):
    t = "".join(q.split()).lower()
    return {t[i : i + 3] for i in range(max(len(t) - 2, 1))}


def test_greedy_deduplication_in_rounds(spark):
    rng = random.Random(9)
    base = ["".join(rng.choices("abcde ", k=rng.randint(1, 40))) for _ in range(12)] + ["ab", "a", "abc"]
    rows = []
    for k in range(240):
        q = list(rng.choice(base))
        for _ in range(rng.choice([0, 0, 1, 2, 3])):
            q[rng.randrange(len(q))] = rng.choice("abcdeXY")
        rows.append((rng.choice(["definition", "condition"]), rng.randint(0, 60), k, k % 3, "".join(q), "answer"))
    # A long chain, in which each is like the next one only.
    chain = "".join(chr(97 + k % 26) + chr(97 + k // 26) for k in range(60))
    rows += [("procedure", 0, k, 0, chain[2 * k : 2 * k + 40], "x") for k in range(20)]
    df = spark.createDataFrame(rows, "question_type string, doc_id long, part int, pos int, question string, gold_answer string").repartition(5)
    want, seen = [], set()
    for r in sorted(rows, key=lambda r: r[1:4]):
        key = (r[0], " ".join(r[4].split()).lower())
        if key in seen:
            continue
        seen.add(key)
        g = grams(r[4])
        if not any(o[0] == r[0] and len(g & grams(o[4])) >= 0.82 * len(g | grams(o[4])) for o in want):
            want.append(r)
    got = benchmark.semantic_dedup(df).select("question_type", "doc_id", "part", "pos", "question", "gold_answer").collect()
    assert sorted(map(tuple, got)) == sorted(want) and len(want) < len(seen)
    assert benchmark.semantic_dedup(df.limit(0)).count() == 0


def test_units_that_hold_many_terms(spark):
    terms = [f"w{k}x" for k in range(100)]
    rows = [(1, p, " ".join(terms[: -1 - p])) for p in range(3)] + [(2, 0, "none"), (3, 0, " ".join(terms)), (150, 0, "own term w50x is its own")]
    units = spark.createDataFrame(rows, "doc_id long, part int, text string")
    got = {(r["doc_id"], r["part"]): r["term"] for r in experiments.unanswerable_pairs(units, spark.createDataFrame([(100 + k, t) for k, t in enumerate(terms)] + [(7, "w3x")], "doc_id long, term string")).collect()}
    assert got[1, 0] == "w99x" and got[2, 0] in terms and (3, 0) not in got and got[150, 0] != "w50x"
    # Of the units of one document with the same term the first has it.
    assert len({t for (d, _), t in got.items() if d == 1}) == len([d for d, _ in got if d == 1])
    assert experiments.unanswerable_pairs(units, spark.createDataFrame([], "doc_id long, term string")).count() == 0


def test_adjacent_comparisons_have_two_pieces_of_evidence(spark):
    units = spark.createDataFrame([(1, 0, "first unit of the text", "art. 1"), (1, 2, "second unit of the text", "art. 2"), (1, 3, "third one", "art. 2"), (2, 0, "alone", "art. 1")], "doc_id long, part int, text string, label string")
    (c,) = benchmark.adjacent_comparisons(units).collect()
    assert c["pair"] == ["art. 1", "art. 2"] and (c["part"], c["next_part"]) == (0, 2) and c["gold_answer"] == "first unit of the text second unit of the text"
    (r,) = benchmark.to_records(benchmark.adjacent_comparisons(units), units).collect()
    assert [e["chunk_id"] for e in r["gold_evidence"]] == ["1:0", "1:2"] and r["gold_evidence"][1]["evidence_text"] == "second unit of the text"
    (k,) = benchmark.to_candidates(benchmark.adjacent_comparisons(units)).collect()
    assert k["gold_evidence_chunk_ids"] == ["1:0", "1:2"] and k["source_chunk_id"] == "1:0"


def test_reasons_and_malformed_comparisons(spark):
    units = spark.createDataFrame([(d, p, f"a thing{d} is a word of that sort number {p}, made by someone in section {d}.") for d in range(4) for p in range(3)], "doc_id long, part int, text string")
    steps = benchmark.benchmark_steps(units, 3)
    reasons = {(r["question_type"], r["reason"]): r["n"] for r in steps["reasons"].collect()}
    raw = {r["question_type"]: r["count"] for r in steps["raw"].groupBy("question_type").count().collect()}
    assert all(sum(n for (t, _), n in reasons.items() if t == kind) == n for kind, n in raw.items()) and ("comparison", "malformed_comparison") not in reasons
    broken = steps["raw"].where("question_type = 'comparison'").withColumn("pair", F.array(F.lit("one")))
    got = broken.select(benchmark.filter_reason(F.col("question"), F.col("gold_answer"), 1, 500, 0.0, F.col("question_type"), F.col("pair"))).distinct().collect()
    assert [r[0] for r in got] == ["malformed_comparison"]


def test_fusion_keeps_the_second_list_and_its_order(spark):
    cols = "query_id long, query_text string, doc_id long, title string, text string, rank int, score double"
    a = spark.createDataFrame([(1, "apple tree", 10, "x", "of a", 1, 3.0), (1, "apple tree", 11, "apple tree", "of a", 2, 2.0), (1, "apple tree", 12, "x", "of a", 3, 1.0)], cols)
    b = spark.createDataFrame([(1, "apple tree", 13, "x", "of b", 1, 0.9), (1, "apple tree", 12, "x", "of b", 2, 0.5)], cols)
    got = retrieval.fuse(a, b, 10).orderBy("rank").collect()
    assert [r["doc_id"] for r in got] == [11, 12, 10, 13] and got[1]["text"] == "of b" and got[2]["score"] == got[3]["score"]
    assert abs(got[0]["score"] - (1 / 62 + 0.15)) < 1e-12
    scored = {r["doc_id"]: r["score"] for r in retrieval.fuse(a, b, 10, "score").collect()}
    assert scored == {10: 0.5, 11: 0.25 + 0.15, 12: 0.0, 13: 0.5}
    assert [r["doc_id"] for r in retrieval.fuse(a, b, 2).orderBy("rank").collect()] == [11, 12]


@pytest.mark.parametrize("block", [32_768, 20])
def test_inner_products_by_tiles_with_a_floor(spark, monkeypatch, block):
    monkeypatch.setattr(retrieval, "VECTOR_BLOCK", block)
    monkeypatch.setattr(retrieval, "QUERY_BLOCK", 3)
    rng = np.random.default_rng(4)
    x = rng.integers(-3, 4, (150, 5)).astype(float)
    v = spark.createDataFrame([(f"c{i:03}", r.tolist()) for i, r in enumerate(x)] + [("none", None)], "doc_id string, v array<double>")
    q = spark.createDataFrame([(i, x[i].tolist()) for i in range(7)], "query_id long, q array<double>")
    got = {(r["query_id"], r["rank"]): r["doc_id"] for r in retrieval.inner_product_topk(v, q, 6).collect()}
    want = {(i, k + 1): f"c{j:03}" for i in range(7) for k, j in enumerate(sorted(range(150), key=lambda j: (-float(x[i] @ x[j]), j))[:6])}
    assert got == want
    assert retrieval.inner_product_topk(v.limit(0), q, 3).count() == 0 and retrieval.inner_product_topk(v, q.limit(0), 3).count() == 0


def test_vector_mode_reads_the_written_index(spark, tmp_path):
    chunks = [{"chunk_id": f"{m}{i}", "doc_id": f"d{i}", "chunk_method": m, "title": "t", "text": f"word{i} apple{i % 3}"} for m in ("structure", "fixed") for i in range(6)]
    (tmp_path / "chunks.jsonl").write_text("\n".join(map(json.dumps, chunks)))
    (tmp_path / "q.jsonl").write_text(json.dumps({"query_id": "q", "query_text": "t word4 apple1"}))
    at = lambda n: str(tmp_path / n)
    STAGES["build-dense-index"](spark, {"chunks_jsonl": at("chunks.jsonl"), "output": at("index")})
    for mode, method in (("vector", "vector"), ("hybrid", "hybrid_rrf")):
        STAGES["retrieve"](spark, {"chunks_jsonl": at("chunks.jsonl"), "queries_jsonl": at("q.jsonl"), "output_jsonl": at(mode), "mode": mode, "index": at("index"), "k": 3})
        hits = records.flat_hits(records.read_table(spark, records.RESULT, at(mode))).orderBy("rank").collect()
        assert hits[0]["chunk_id"] == "structure4" and hits[0]["retrieval_method"] == method and len(hits) == 3
    plan = records.read_vectors(spark, at("index"), "fixed")._jdf.queryExecution().toString()
    assert "PartitionFilters: [isnotnull(corpus" in plan
    with pytest.raises(ValueError, match="vectors"):
        retrieval.retrieve({}, spark.createDataFrame([], "query_id long, variant_no int, source string, text string"), "vector", 3)


def test_the_original_question_only_where_wanted(spark):
    q = spark.createDataFrame([(1, "a"), (2, "b")], "query_id long, query_text string")
    made = spark.createDataFrame([(1, "multi_query", "c"), (1, "multi_query", " c")], "query_id long, source string, text string")
    told = lambda df: sorted((r["query_id"], r["variant_no"], r["source"]) for r in df.collect())
    assert told(retrieval.query_variants(q, made)) == [(1, 0, "original"), (1, 1, "multi_query"), (2, 0, "original")]
    assert told(retrieval.query_variants(q, made, original=False)) == [(1, 0, "multi_query"), (2, 0, "original")]


def test_corpus_positions(spark):
    rng = random.Random(1)
    rows = [(rng.choice("abc"), rng.randint(0, 50), k) for k in range(300)]
    df = spark.createDataFrame(rows, "c string, x int, k int").repartition(7)
    got = sorted((r["corpus_pos"], r["c"], r["x"], r["k"]) for r in shared.numbered(df, "c", "x", "k").collect())
    assert [g[1:] for g in got] == sorted(rows) and [g[0] for g in got] == list(range(1, 301))
    by = [(r["c"], r["corpus_pos"], r["x"], r["k"]) for r in shared.numbered(df, "x", "k", by="c").collect()]
    assert sorted(by) == [(c, p, x, k) for c in "abc" for p, (x, k) in enumerate(sorted((x, k) for d, x, k in rows if d == c), 1)]
    assert shared.numbered(df.limit(0), "x").count() == 0


def test_bm25_ties_in_corpus_order(spark):
    docs = spark.createDataFrame([(1, "apple pie"), (2, "apple pie"), (3, "apple pie"), (4, "other text")], "doc_id long, text string").withColumn("falling", -F.col("doc_id"))
    q = spark.createDataFrame([(1, "apple")], "query_id long, query_text string")
    got = retrieval.bm25(shared.numbered(docs, "falling").select("doc_id", "corpus_pos", "text"), q, 2).orderBy("rank").collect()
    assert [r["doc_id"] for r in got] == [3, 2] and "corpus_pos" not in got[0].asDict()


def test_errors_name_the_line(spark, tmp_path):
    ok = {"query_id": "a", "question": "q", "question_type": "t", "answerable": True, "gold_answer": "x"}
    (tmp_path / "b.jsonl").write_text("\n".join([json.dumps(ok), "", json.dumps({**ok, "gold_answer": None})]))
    with pytest.raises(Exception, match=r"missing field gold_answer in b.jsonl, line 3"):
        records.read_benchmark(spark, str(tmp_path / "b.jsonl")).collect()


def test_the_last_of_repeated_rows_counts(spark, tmp_path):
    at = lambda n: str(tmp_path / n)
    put = lambda name, rows: (tmp_path / name).write_text("\n".join(map(json.dumps, rows)))
    gold = lambda q: {"query_id": q, "question": "q", "question_type": "t", "answerable": True, "gold_answer": "apple trees", "gold_evidence": [{"chunk_id": "c1"}]}
    put("b.jsonl", [gold("z"), gold("a")])
    hits = lambda q, c: {"query_id": q, "query_text": "q", "hits": [{"rank": 1, "chunk_id": c, "doc_id": "d", "score": 1.0}]}
    put("r.jsonl", [hits("z", "other"), hits("z", "c1"), hits("a", "c1")])
    said = lambda q, text: {"query_id": q, "query_text": "q", "answer": text, "citations": [], "used_context_ids": ["c1"], "generation_method": "m", "abstained": False, "metadata": {"citation_support_ratio": "1.0"}}
    put("s.jsonl", [said("z", "nothing of it"), *[said("a", "apple trees")] * 400, said("a", "wrong words"), said("z", "apple trees")])
    for size in ("1m", "4k"):
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)
        try:
            STAGES["analyze-errors"](spark, {"benchmark_jsonl": at("b.jsonl"), "results_jsonl": at("r.jsonl"), "answers_jsonl": at("s.jsonl"), "output_csv": at(f"e{size}")})
        finally:
            spark.conf.unset("spark.sql.files.maxPartitionBytes")
        got = [(r["query_id"], r["labels"]) for r in spark.read.option("header", True).csv(at(f"e{size}")).collect()]
        assert got == [("z", None), ("a", "generation_hallucination")]


def test_merged_chunks_keep_texts_paths_and_labels(spark):
    rows = [(1, 0, "ab", 0, 2, ["p", ""], ["y"], "first"), (1, 1, "c", 2, 3, ["q", "p"], ["x", "y"], "second"), (1, 2, "long enough", 3, 14, None, None, "third"), (1, 3, "d", 14, 15, ["r"], ["z"], "fourth"), (2, 0, "e", 0, 1, [], [], "alone")]
    df = spark.createDataFrame(rows, "doc_id long, chunk_index int, text string, start_char int, end_char int, section_path array<string>, structure_labels array<string>, title string").repartition(4)
    got = sorted(tuple(r) for r in chunking.merge_short_chunks(df, 5).select("doc_id", "chunk_index", "n_merged", "text", "start_char", "end_char", "section_path", "structure_labels", "title").collect())
    assert got == [(1, 0, 2, "abc", 0, 3, ["p", "q"], ["x", "y"], "first"), (1, 1, 2, "long enoughd", 3, 15, ["r"], ["z"], "third"), (2, 0, 1, "e", 0, 1, [], [], "alone")]


def test_auto_evaluation_by_hand(spark):
    test = spark.createDataFrame([("a", "what apple", "apple tree", "c1", "apple tree grows"), ("b", "q", "t", "c2", "e")], "query_id string, question string, truth string, doc_id string, evidence string")
    said = spark.createDataFrame([("a", "apple grows wild", ["c1", "c9"]), ("b", "", None)], "query_id string, answer string, used array<string>")
    hits = spark.createDataFrame([("a", "c9", 1, "x"), ("a", "c1", 4, "y")], "query_id string, doc_id string, rank int, text string")
    got = {r["query_id"]: r for r in experiments.auto_eval(said, test, hits).collect()}
    a, b = got["a"], got["b"]
    assert [round(a[m], 6) for m in experiments.AUTO] == [round(2 / 3, 6), 0.5, 0.5, 0.25, 0.5, 0.5] and (a["recall_3"], a["recall_5"]) == (0.0, 1.0)
    assert all(b[m] == 0 for m in (*experiments.AUTO, "recall_3", "recall_5"))
    rows = experiments.auto_eval_variants({"v": lambda t: (said, hits), "w": lambda t: (said, hits.limit(0))}, test).collect()
    assert [(r["variant"], r["n"], r["recall_5"]) for r in rows] == [("v", 2, 0.5), ("w", 2, 0.0)]


def test_auto_evaluation_from_files_to_files(spark, tmp_path):
    at = lambda n: str(tmp_path / n)
    chunks = [{"chunk_id": f"c{i}", "doc_id": f"d{i}", "chunk_method": "structure", "title": f"t{i}", "text": f"Word{i} apple grows by river{i}."} for i in range(5)]
    (tmp_path / "chunks.jsonl").write_text("\n".join(map(json.dumps, chunks)))
    client = lambda: lambda prompt: json.dumps({"question": "what " + prompt.split()[-1], "answer": "apple grows"}) if "Word3" not in prompt else "none"
    STAGES["auto-testset"](spark, {"chunks_jsonl": at("chunks.jsonl"), "output_jsonl": at("test"), "n": 5, "report": at("t.md")}, client)
    held = {r["ground_truth_chunk_id"]: r for r in records.read_testset(spark, at("test")).collect()}
    assert sorted(held) == ["c0", "c1", "c2", "c4"] and held["c1"]["ground_truth_doc_id"] == "d1" and "river1" in held["c1"]["evidence_text"]
    STAGES["auto-eval"](spark, {"testset_jsonl": at("test"), "chunks_jsonl": at("chunks.jsonl"), "variants": {"lexical": {"mode": "bm25", "k": 3}, "both": {"mode": "hybrid", "reranker": "heuristic"}}, "output_csv": at("auto"), "report": at("a.md")})
    got = {r["variant"]: r for r in spark.read.option("header", True).csv(at("auto")).collect()}
    assert set(got) == {"lexical", "both"} and float(got["lexical"]["recall_3"]) == 1.0 and got["both"]["n"] == "4"


def test_candidate_files_and_source_references(spark, tmp_path):
    chunks = [{"chunk_id": f"c{i}", "doc_id": f"d{i}", "chunk_method": "structure", "title": "t", "text": f"a thing{i} is a word of that sort made by someone, number {i}."} for i in range(4)]
    (tmp_path / "chunks.jsonl").write_text("\n".join(map(json.dumps, chunks)))
    at = lambda n: str(tmp_path / n)
    STAGES["generate-benchmark"](spark, {"chunks_jsonl": at("chunks.jsonl"), "output_jsonl": at("out"), "quota": 2, "raw_jsonl": at("raw"), "deduped_jsonl": at("deduped"), "report": at("r.md")})
    raw, deduped = records.read_candidates(spark, at("raw")).count(), records.read_candidates(spark, at("deduped")).count()
    assert raw >= deduped > 0 and "filtered" in (tmp_path / "r.md").read_text()
    hits = spark.createDataFrame([(1, 5, "t", "text one.", 1, 1.0, {"source_file": "f.json", "page": " 3 "}), (1, 6, "t", "text two.", 2, 1.0, None)], "query_id long, doc_id long, title string, text string, rank int, score double, metadata map<string,string>")
    c = answers.gathered(hits).select(answers.build_citations(F.array(F.lit("5"), F.lit("6")), F.col("contexts")).alias("c")).first()["c"]
    assert [x["source_ref"] for x in c] == ["f.json | 3", None] and context.NO_ANSWER


def test_rerankers_name_themselves(spark):
    hits = spark.createDataFrame([(1, "q", 1, 0.1, "t", "x", "bm25"), (1, "q", 2, 0.2, "t", "longer", "bm25")], "query_id long, query_text string, doc_id long, score double, title string, text string, retrieval_method string")
    cross = retrieval.build_reranker("cross", make=lambda: lambda q, t: [float(len(x)) for x in t])(hits, 2).orderBy("rank").collect()
    assert [r["doc_id"] for r in cross] == [2, 1] and cross[0]["retrieval_method"] == "bm25+cross_rerank"


def test_experiment_matrix_from_files_to_files(spark, tmp_path):
    import zipfile

    at = lambda n: str(tmp_path / n)
    chunks = [{"chunk_id": f"c{i}", "doc_id": f"d{i}", "chunk_method": "structure", "title": f"t{i}", "text": f"Word{i} apple grows by river{i}."} for i in range(4)]
    (tmp_path / "chunks.jsonl").write_text("\n".join(map(json.dumps, chunks)))
    (tmp_path / "q.jsonl").write_text("\n".join(json.dumps({"query_id": f"q{i}", "query_text": f"word{i} Word{i} river{i}"}) for i in range(2)))
    gold = [{"query_id": f"q{i}", "question": "?", "question_type": "ab"[i], "answerable": True, "gold_answer": f"Word{i} apple grows by river{i}.", "gold_evidence": [{"chunk_id": f"c{i}"}]} for i in range(2)]
    (tmp_path / "b.jsonl").write_text("\n".join(map(json.dumps, gold)))
    STAGES["run-experiments"](spark, {"folder": at("exp"), "matrix": {"modes": ["bm25", "wrong"], "generators": ["extractive"], "contexts": ["raw", "processed"]}, "chunks_jsonl": at("chunks.jsonl"), "queries_jsonl": at("q.jsonl"), "benchmark_jsonl": at("b.jsonl"), "options": {"retrieve": {"k": 2}}})
    told = json.loads((tmp_path / "exp/summary.json").read_text())
    held = {r["variant"]: r for r in told["variants"]}
    assert set(held) == {f"{m}__extractive__{c}" for m in ("bm25", "wrong") for c in ("raw", "processed")}
    assert all(held[f"bm25__extractive__{c}"]["mrr"] == 1.0 and held[f"bm25__extractive__{c}"]["answer_correctness"] > 0.5 for c in ("raw", "processed"))
    assert set(told["failed"]) == {"wrong__extractive__raw", "wrong__extractive__processed"} and told["failed"]["wrong__extractive__raw"].startswith("retrieve: ValueError")
    assert sorted(zipfile.ZipFile(tmp_path / "exp/bundle.zip").namelist()) == ["stages.md", "summary.json", "summary.md"] and "by type" in (tmp_path / "exp/stages.md").read_text()


def test_answers_of_query_transformers(spark):
    from corpusloom.functions import text as T

    said = ['{"multi_queries": ["a", "b"], "hyde": "long"}', 'Sure: {"queries": ["c"]} done', 'no object but "x" and "y", "z", "w"', "{broken", None]
    got = spark.createDataFrame([(i, s) for i, s in enumerate(said)], "i int, s string").select("i", T.transform_payload(F.col("s")).alias("p")).orderBy("i").collect()
    assert [(r["p"]["multi_queries"], r["p"]["hyde"]) for r in got] == [(["a", "b"], "long"), (["c"], ""), (["x", "y", "z"], ""), ([], ""), ([], "")]


def test_grams_are_joined_alike_by_either_way(spark, monkeypatch):
    docs = spark.createDataFrame([(i, f"some text {i} of words {i % 3}") for i in range(12)], "doc_id long, text string")
    q = spark.createDataFrame([(1, "text 3 of words"), (2, "none")], "query_id long, query_text string")
    told = lambda: sorted((r["query_id"], r["doc_id"], round(r["score"], 9)) for r in retrieval.tfidf_cosine(docs, q, 5).collect())
    few = told()
    monkeypatch.setattr(retrieval, "BROADCAST_TERMS", 0)
    assert told() == few and few


def test_expanded_queries_are_asked_once_each(spark, tmp_path):
    chunks = [{"chunk_id": f"c{i}", "doc_id": f"d{i}", "chunk_method": "structure", "title": "t", "text": f"word{i} apple{i % 3}"} for i in range(6)]
    (tmp_path / "chunks.jsonl").write_text("\n".join(map(json.dumps, chunks)))
    (tmp_path / "q.jsonl").write_text(json.dumps({"query_id": "q", "query_text": "word1"}) + "\n" + json.dumps({"query_id": "r", "query_text": "word2"}))
    at = lambda n: str(tmp_path / n)

    def client():
        def ask(prompt):
            with open(at("asked"), "a") as f:
                f.write("x")
            return '{"multi_queries": ["word5", "word4"]}' if "word1" in prompt else "nothing"

        return ask

    base = {"chunks_jsonl": at("chunks.jsonl"), "queries_jsonl": at("q.jsonl"), "mode": "bm25", "k": 5, "multi_query": 2}
    STAGES["retrieve"](spark, {**base, "output_jsonl": at("with")}, None, client)
    assert len((tmp_path / "asked").read_text()) == 2
    STAGES["retrieve"](spark, {**base, "output_jsonl": at("without"), "include_original": False}, None, client)
    hits = lambda n: {q: sorted(r["chunk_id"] for r in records.flat_hits(records.read_table(spark, records.RESULT, at(n))).where(f"query_id = '{q}'").collect()) for q in "qr"}
    assert hits("with") == {"q": ["c1", "c4", "c5"], "r": ["c2"]} and hits("without") == {"q": ["c4", "c5"], "r": ["c2"]}
    told = records.read_table(spark, records.RESULT, at("without")).where("query_id = 'q'").first()
    assert told["query_text"] == "word1"


def test_encoders_from_token_models(spark):
    from corpusloom.operators import models

    def tokens():
        def run(texts):
            n = max(len(t.split()) for t in texts) if texts else 1
            x, mask = np.zeros((len(texts), n, 2)), np.zeros((len(texts), n))
            for i, t in enumerate(texts):
                for j, w in enumerate(t.split()):
                    x[i, j], mask[i, j] = ((1, 0) if w == "a" else (0, 1)), 1
            return x, mask

        return run

    df = spark.createDataFrame([(1, "a a a"), (2, "b"), (3, "a b")], "doc_id long, text string")
    got = {r["doc_id"]: [round(float(v), 4) for v in r["embedding"]] for r in models.embed(df, models.pooled_encoder(tokens)).collect()}
    assert got == {1: [1.0, 0.0], 2: [0.0, 1.0], 3: [0.7071, 0.7071]}
