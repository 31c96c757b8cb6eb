"""Stages of retrieval, generation, chunking, audit and benchmark synthesis on small tables."""

import json
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpusloom.functions.presets import LATIN, ZH
from corpusloom.operators import answers, audit, benchmark, chunking, context, experiments, models, retrieval
from corpusloom.sources import records


def payload(spark, said, contexts=(("c1", "Title", "the law of the land applies"), ("c2", "Other", "something else"))):
    rows = [(said, [(i, "d", t, x, n, 1.0, None) for n, (i, t, x) in enumerate(contexts, 1)])]
    df = spark.createDataFrame(rows, f"said string, contexts array<{answers.CONTEXT}>")
    p = answers.read_payload(F.col("said"))
    r = df.select(p["parse_status"].alias("how"), answers.normalise_payload(p, F.col("contexts")).alias("n")).first()
    return r["how"], r["n"]["schema_status"], r["n"]["used_context_ids"], r["n"]["abstained"], r["n"]["answer"]


def test_payloads(spark):
    assert payload(spark, '{"answer": "a [1]", "used_context_ids": ["c2", "x"], "abstained": false}') == ("strict_json", "filtered_invalid_context_ids", ["c2"], False, "a [1]")
    assert payload(spark, "Well. Nothing is known.") == ("minimal_fallback", "valid", [], True, "Well. Nothing is known.")
    assert payload(spark, '{"answer": "see [2] and [2]", "abstained": false}')[1:3] == ("inferred_context_ids_from_citations", ["c2"])
    assert payload(spark, '{"answer": "law of the land", "used_context_ids": []}')[1:3] == ("inferred_context_ids_from_answer", ["c1"])
    assert payload(spark, '{"answer": "zzzz", "used_context_ids": []}')[1:4] == ("forced_abstain_missing_context_ids", [], True)
    assert payload(spark, '<think>hm {</think>{"answer": "it is \\"so\\"", "abstained": true, "used_context_ids": ["c1"') == ("relaxed_extraction", "valid", [], True, 'it is "so"')
    assert payload(spark, '```json\n{"other": 1}\n``` and } more {')[0] == "relaxed_extraction"
    assert payload(spark, None) == ("minimal_fallback", "valid", [], True, answers.FALLBACK)


def test_guardrails_take_effect(spark):
    q = spark.createDataFrame([(1, "q one"), (2, "none")], "query_id long, query_text string")
    hits = spark.createDataFrame([(1, 7, "t", "Alpha beta. Gamma.", 1, 5.0)], "query_id long, doc_id long, title string, text string, rank int, score double")
    make = answers.build_generator("extractive", least_score=1.0)
    plain = {r["query_id"]: r for r in answers.generation_stage(hits, q, make).collect()}
    assert plain[1]["answer"] == "Alpha beta. Gamma." and plain[1]["used_context_ids"] == ["7"] and plain[1]["citations"][0]["span_text"] == "Alpha beta. Gamma."
    assert plain[1]["alignment"]["alignment_all_valid"] and plain[2]["abstained"] and plain[2]["alignment"]["citation_support_ratio"] == 1.0
    got = {r["query_id"]: r for r in answers.generation_stage(hits, q, make, brackets=True).collect()}
    assert got[1]["guardrail_reasons"] == ["missing_citation_brackets"] and got[1]["answer"] == answers.BLOCKED and got[1]["abstained"] and got[1]["used_context_ids"] == got[1]["citations"] == []
    assert got[1]["alignment"]["alignment_all_valid"] and got[2]["guardrail_status"] == "passed"
    with pytest.raises(ValueError, match="generator"):
        answers.build_generator("x")


def test_llm_generator_and_counts(spark):
    q = spark.createDataFrame([(1, "q one")], "query_id long, query_text string")
    hits = spark.createDataFrame([(1, 7, "t", "Alpha beta.", 1, 5.0)], "query_id long, doc_id long, title string, text string, rank int, score double")
    make = answers.build_generator("llm", make=lambda: lambda p: '{"answer": "Alpha [1]", "used_context_ids": ["7"]}' if "[1] t (7)" in p else "no")
    out = answers.generation_stage(hits, q, make)
    r = out.first()
    assert (r["answer"], r["parse_status"], r["generation_method"]) == ("Alpha [1]", "strict_json", "llm_grounded")
    assert answers.stage_counts(out).first()["n_aligned"] == 1
    assert [x[0] for x in spark.createDataFrame([("JSONDecodeError: bad",), ("http 500",), ("read timed out",), ("schema of x",), ("no citation",), ("model gone",), (None,)], "e string").select(answers.failure_stage(F.col("e"))).collect()] == ["output_parsing", "generation", "timeout", "schema_validation", "citation_postprocess", "model_loading_or_inference", "none"]


def test_retrieval_driver(spark):
    a = spark.createDataFrame([(1, "apple", "apple pear"), (2, "x", "apple apple plum")], "doc_id long, title string, text string")
    b = spark.createDataFrame([(3, "fig", "fig apple")], "doc_id long, title string, text string")
    v = retrieval.query_variants(spark.createDataFrame([(1, "apple")], "query_id long, query_text string"), spark.createDataFrame([(1, "hyde", "fig")], "query_id long, source string, text string"))
    for mode in ("bm25", "dense", "hybrid"):
        got = retrieval.retrieve({"structure": a, "fixed": b}, v, mode, 3, reranker=retrieval.build_reranker("heuristic")).orderBy("rank").collect()
        assert [r["rank"] for r in got] == [1, 2, 3] and {r["doc_id"] for r in got} == {1, 2, 3} and got[0]["retrieval_method"] == f"{mode}{'_rrf' if mode == 'hybrid' else ''}+heuristic_rerank"
    with pytest.raises(ValueError, match="mode"):
        retrieval.retrieve({"a": a}, v, "x", 1)
    with pytest.raises(ValueError, match="reranker"):
        retrieval.build_reranker("x")


def test_hit_dedupe_and_inner_products(spark):
    hits = spark.createDataFrame([(1, 11, 2, 1.0), (1, 11, 1, 0.5), (1, 12, 2, 3.0)], "query_id long, doc_id long, rank int, score double")
    assert [(r["doc_id"], r["rank"]) for r in retrieval.dedupe_hits(hits, F.col("doc_id")).orderBy("rank").collect()] == [(11, 1), (12, 2)]
    rng = np.random.default_rng(0)
    x = rng.normal(size=(300, 8))
    v = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(x)], "doc_id long, v array<double>")
    q = v.where("doc_id < 7").select(F.col("doc_id").alias("query_id"), F.col("v").alias("q"))
    got = retrieval.inner_product_topk(v, q, 4).collect()
    for i in range(7):
        assert [r["doc_id"] for r in sorted(got, key=lambda r: r["rank"]) if r["query_id"] == i] == np.argsort(-(x @ x[i]))[:4].tolist()


def test_context_stage(spark):
    rows = [(1, "q one", k, 10 + k, s, t, 5.0, "t") for k, s, t in ((1, "d1", "Alpha beta. One q."), (2, "d1", "Alpha beta. One q. More"), (3, "d1", "Third."), (4, "d2", "Alpha"))]
    hits = spark.createDataFrame(rows, "query_id long, query_text string, rank int, doc_id long, source string, text string, score double, title string")
    got = context.process_contexts(hits, 2, 2, compress=(1, 2)).orderBy("rank").collect()
    assert [(r["doc_id"], r["text"], r["original_count"], r["compressed"]) for r in got] == [(11, "One q.", 4, True), (13, "Third.", 4, True)]
    assert spark.createDataFrame([({"source_file": "f", "page": "3"},)], "m map<string, string>").select(context.source_ref(F.col("m"))).first()[0] == "f | 3"


def test_cut_parts_begin_with_the_sentences_before():
    sentence, secondary = re.compile("[^。！？；\n]+[。！？；\n]?"), re.compile(ZH.secondary)
    heading = re.compile(ZH.heading)
    text = "第一条 甲甲甲甲。乙乙乙乙。丙丙丙丙。"
    got = chunking.structure(text, 10, 1, heading, ZH.levels, sentence, secondary, 1)
    assert [g[0] for g in got] == ["第一条 甲甲甲甲。", "第一条 甲甲甲甲。乙乙乙乙。丙丙丙丙。"] and got[1][1] == text.index("乙")
    comma = "第一条 甲甲甲甲甲，乙乙乙乙乙，丙丙丙"
    assert [g[0] for g in chunking.structure(comma, 12, 1, heading, ZH.levels, sentence, secondary)] == ["第一条 甲甲甲甲甲，", "乙乙乙乙乙，丙丙丙"]
    assert [g[0] for g in chunking.structure("甲" * 25, 10, 1, heading, ZH.levels, sentence, secondary)] == ["甲" * 10, "甲" * 10, "甲" * 5]


def test_chunk_stage(spark):
    df = spark.createDataFrame([(1, "One. Two.\nThree is here.", "One. Two. Three is here.")], "doc_id long, text string, normalized_text string")
    both = chunking.chunk_stage(df, "both", 10, 2, 1)
    assert {r["chunk_method"] for r in both.collect()} == {"fixed", "structure"} and both.select("chunk_id").distinct().count() == both.count()
    fixed = chunking.chunk_stage(df, "fixed", 10, 2, 1)
    assert chunking.preferred(fixed, "structure").count() == fixed.count() and chunking.preferred(both, "fixed").count() == fixed.count()
    zh = spark.createDataFrame([(1, "总则第一条 甲甲甲甲。第二条 乙乙乙乙。"), (2, "没有条文的文本。")], "doc_id long, text string")
    assert [(r["doc_id"], r["label"], r["text"]) for r in chunking.articles(zh, ZH.article, 5).orderBy("doc_id", "part").collect()] == [(1, "第一条", "第一条 甲甲甲甲。"), (1, "第二条", "第二条 乙乙乙乙。"), (2, None, "没有条文的文本。")]


def test_audit_stage(spark):
    long = "a text that is long enough to be no short one at all, really"
    raw = spark.createDataFrame([(1, long, "s"), (2, long, "s"), (3, "x", None), (4, None, "s")], "doc_id long, text string, source string")
    a = audit.audit_stage(raw)
    detail = a["detail"].collect()
    assert {r["record_type"] for r in detail} == {"exact_title_duplicate", "exact_body_duplicate", "near_duplicate", "anomaly"} and any(r["note"] == "group of 2" for r in detail)
    rows = {(r["sample_type"], r["doc_id"]) for r in audit.review_rows(a["documents"], a["detail"], 2).collect()}
    assert {("duplicate", 1), ("duplicate", 2), ("anomaly", 4)} <= rows and sum(t == "random" for t, _ in rows) == 2
    assert audit.audit_stage(raw, 2)["documents"].count() == 2
    assert {(r["doc_id"], r["first_doc_id"], r["n"]) for r in audit.duplicate_members(a["documents"], F.col("normalized_text")).collect()} == {(1, 1, 2), (2, 1, 2)}


def test_near_pairs_meet_in_bands(spark):
    import random

    rng = random.Random(4)
    fps = [rng.getrandbits(64) for _ in range(20)]
    fps += [f ^ sum(1 << b for b in rng.sample(range(48), rng.randint(0, 5))) for f in fps for _ in range(4)]
    df = spark.createDataFrame([(i, f >> 32, f & 0xFFFFFFFF) for i, f in enumerate(fps)], "doc_id long, fp_hi long, fp_lo long")
    first = {}
    for i, f in enumerate(fps):
        first.setdefault(f, i)
    ids = sorted(first.items(), key=lambda x: x[1])
    want = {(a, b, (f ^ g).bit_count()) for k, (f, a) in enumerate(ids) for g, b in ids[k + 1 :] if (f ^ g).bit_count() <= 3 and f >> 48 == g >> 48}
    want |= {(first[f], i, 0) for i, f in enumerate(fps) if first[f] != i}
    assert {tuple(r) for r in audit.near_duplicate_pairs(df).collect()} == want


def test_benchmark_stage(spark):
    text = "a thing is a word of that sort made by both one and two of them. Nothing here to see at all. The tionword by someone."
    units = spark.createDataFrame([(i, 0, f"{text} Number {i} stands here.") for i in range(6)] + [(9, 0, "another thing is defined as that other kind of word.")], "doc_id long, part int, text string")
    assert {r["question_type"] for r in benchmark.actor_candidates(units).collect()} == {"responsibility"}
    assert ["one", "two"] in [r["pair"] for r in benchmark.comparison_candidates(units).collect()]
    rec, dist = benchmark.benchmark_stage(units, 2)
    got = rec.collect()
    assert len({r["query_id"] for r in got}) == len(got) and all(r["gold_evidence"][0]["evidence_text"] for r in got if r["answerable"])
    assert {r["question_type"] for r in dist.collect()} == set(benchmark.TYPES) and all(r["raw"] >= r["deduped"] >= r["final"] for r in dist.collect())
    with pytest.raises(ValueError, match="fewer"):
        benchmark.benchmark_stage(units, 1, least=1000)
    df = spark.createDataFrame([("comparison", ["a"]), ("unanswerable", None)], "kind string, pair array<string>")
    reasons = df.select(benchmark.filter_reason(F.lit("How do they differ?"), F.lit("they differ a lot"), 5, 80, 0.0, F.col("kind"), F.col("pair"))).collect()
    assert [r[0] for r in reasons] == ["malformed_comparison", "malformed_unanswerable"]


def test_unanswerable_pairs_try_every_term(spark):
    terms = [f"w{k}" for k in range(30)]
    units = spark.createDataFrame([(1, 0, " ".join(terms[:-1])), (2, 0, "none"), (30, 0, " ".join(terms))], "doc_id long, part int, text string")
    got = {r["doc_id"]: r["term"] for r in experiments.unanswerable_pairs(units, spark.createDataFrame([(100 + k, t) for k, t in enumerate(terms)], "doc_id long, term string")).collect()}
    assert got[1] == "w29" and got[2] in terms and 30 not in got


def test_stage_runner(spark):
    one = spark.createDataFrame([(1,)], "x int")

    def fails(done):
        raise ValueError("no model")

    results, failures = experiments.run_stages({"a": {"retrieve": lambda d: one, "generate": lambda d: d["retrieve"].where("x > 5")}, "b": {"retrieve": lambda d: one, "generate": fails, "judge": lambda d: one}})
    assert list(results["a"]) == ["retrieve", "generate"] and list(results["b"]) == ["retrieve"] and failures[0]["stage"] == "generate" and "no model" in failures[0]["error"]


def test_models(spark):
    q = spark.createDataFrame([(1, "a b")], "query_id long, query_text string")
    got = models.expand(q, lambda: lambda p: '{"queries": ["x"], "passage": "long one"}', 2, hyde=True).collect()
    assert sorted((r["source"], r["text"]) for r in got) == [("hyde", "long one"), ("multi_query", "x")] and models.expand(q, lambda: str, multi_query=False).count() == 0
    tokens, mask = np.array([[[1.0, 0.0], [0.0, 3.0]], [[5.0, 5.0], [1.0, 1.0]]]), np.array([[1, 0], [0, 0]])
    assert np.allclose(models.mean_pooled(tokens, mask), [[1, 0], [0, 0]])
    with pytest.raises(ValueError, match="prompt"):
        models.prompt_of(F.lit("q"), F.array(), "x")


def test_sinks_and_reports(spark, tmp_path):
    errors = spark.createDataFrame([("q", ["a", "b"], ["n", "m"])], "query_id string, labels array<string>, notes array<string>")
    assert tuple(records.error_rows(errors).first()) == ("q", "a|b", "n | m")
    records.write_debug({"a": 1}, str(tmp_path / "x" / "d.json"))
    assert json.loads((tmp_path / "x" / "d.json").read_text()) == {"a": 1}
    (tmp_path / "r.md").write_text("# T\n\n## Summary Metrics\n\n- `mrr`: 0.5\n- plain: 3\n\n## Error Counts\n\n- `miss`: 2\n")
    assert sorted(tuple(r)[1:] for r in records.read_report(spark, str(tmp_path / "r.md")).collect()) == [("Error Counts", "miss", "2"), ("Summary Metrics", "mrr", "0.5"), ("Summary Metrics", "plain", "3")]
    lines = "\n".join(json.dumps({"title": f"t{i}"}) if i % 3 else "" for i in range(5000))
    (tmp_path / "big.jsonl").write_text(lines)
    spark.conf.set("spark.sql.files.maxPartitionBytes", "8k")
    got = {r["record_index"]: r["title"] for r in records.read_raw(spark, str(tmp_path / "big.jsonl")).collect()}
    spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert got == {i: f"t{i}" for i in range(5000) if i % 3}
    answered = spark.createDataFrame([("q", "t", "a", False)], "query_id string, query_text string, answer string, abstained boolean")
    records.write_table(answered, str(tmp_path / "a"))
    r = records.read_table(spark, records.ANSWER, str(tmp_path / "a")).first()
    assert r["answer"] == "a" and r["citations"] is None


def test_presets():
    assert LATIN.secondary and ZH.pairs[0] == ("A类", "B类")


def test_stages_from_files_to_files(spark, tmp_path):
    from corpusloom.__main__ import main
    from corpusloom.plans.stages import STAGES

    at = lambda name: str(tmp_path / name)
    body = "Apple trees grow by the river. A thing is a word that names it. The tionword was made by someone else."
    (tmp_path / "raw.jsonl").write_text("\n".join(json.dumps({"title": f"T{i}", "publishSource": "s", "content": f"{body} Number {i} stands here.", "dataTime": "2024-01-02"}) for i in range(4)))
    (tmp_path / "q.jsonl").write_text(json.dumps({"query_id": "q1", "query_text": "apple trees river"}) + "\n" + json.dumps({"query_id": "q2", "query_text": "zzz"}))
    (tmp_path / "audit.json").write_text(json.dumps({"inputs": at("raw.jsonl"), "output_jsonl": at("docs"), "detail_csv": at("detail"), "report": at("audit.md")}))
    main(["stage", "audit", at("audit.json")])
    STAGES["clean"](spark, {"input_jsonl": at("docs"), "output_jsonl": at("clean"), "global_patterns": ["apple"], "source_aliases": {"s": "S"}, "report": at("c.md")})
    STAGES["review-sample"](spark, {"input_jsonl": at("clean"), "detail_csv": at("detail"), "output_csv": at("review"), "size": 2})
    STAGES["chunk"](spark, {"input_jsonl": at("docs"), "output_jsonl": at("chunks"), "size": 200, "overlap": 20, "report": at("k.md")})
    STAGES["retrieve"](spark, {"chunks_jsonl": at("chunks"), "queries_jsonl": at("q.jsonl"), "output_jsonl": at("hits"), "reranker": "heuristic", "report": at("r.md")})
    STAGES["process-contexts"](spark, {"input_jsonl": at("hits"), "output_jsonl": at("contexts"), "report": at("x.md")})
    STAGES["generate"](spark, {"input_jsonl": at("contexts"), "output_jsonl": at("answers"), "report": at("g.md")})
    STAGES["build-dense-index"](spark, {"chunks_jsonl": at("chunks"), "output": at("index")})
    got = {r["query_id"]: r for r in records.read_table(spark, records.ANSWER, at("answers")).collect()}
    assert got["q2"]["abstained"] and got["q1"]["citations"][0]["chunk_id"] == got["q1"]["used_context_ids"][0]
    gold = [{"query_id": "q1", "question": "apple?", "question_type": "definition", "answerable": True, "gold_answer": "Apple trees grow", "gold_evidence": [{"chunk_id": got["q1"]["used_context_ids"][0]}]}]
    (tmp_path / "b.jsonl").write_text("\n".join(map(json.dumps, gold)))
    b = {"benchmark_jsonl": at("b.jsonl")}
    STAGES["eval-retrieval"](spark, {**b, "results_jsonl": at("hits"), "output_csv": at("m1"), "report": at("m1.md")})
    STAGES["eval-generation"](spark, {**b, "answers_jsonl": at("answers"), "output_csv": at("m2"), "report": at("m2.md")})
    STAGES["analyze-errors"](spark, {**b, "results_jsonl": at("hits"), "answers_jsonl": at("answers"), "output_csv": at("e"), "report": at("e.md")})
    STAGES["validate-benchmark"](spark, {**b, "report": at("v.md")})
    STAGES["generate-benchmark"](spark, {"chunks_jsonl": at("chunks"), "output_jsonl": at("made"), "quota": 2, "report": at("gb.md")})
    STAGES["run-ablation"](spark, {"variants": {"a": at("m1"), "b": at("m1")}, "report": at("ab.md")})
    STAGES["run-experiments"](spark, {"folder": at("exp"), "variants": {"a": {"validate-benchmark": {**b, "report": at("v2.md")}}, "b": {"retrieve": {}}}})
    STAGES["debug-llm-generation"](spark, {"input_jsonl": at("hits"), "query_id": "none", "output_json": at("d.json")})
    assert json.loads((tmp_path / "d.json").read_text())["failure_stage"] == "input_lookup" and "failed" in (tmp_path / "exp/summary.md").read_text()
    first = spark.read.option("header", True).csv(at("m1")).where("query_id = 'q1'").first()
    assert float(first["mrr"]) == 1.0 and records.read_benchmark(spark, at("made")).count() > 0
    assert spark.read.option("header", True).csv(at("review")).count() >= 2 and len(STAGES) == 18


def grams(q):
    t = "".join(q.split()).lower()
    return {t[i : i + 3] for i in range(max(len(t) - 2, 1))}


def packed(text, size, overlap):
    """Spans of sentences by the stated rule: as many whole sentences as fit; the next span begins with the first sentence that starts in the last `overlap` characters of this one, but never with the same."""
    ends = [k + 1 for k, c in enumerate(text) if c in ".!?;\n"] + [len(text)]
    starts = [0, *ends]
    # A mark that follows another one at once is a piece without text.
    pieces = [(a, b) for a, b in zip(starts, ends) if text[a:b].strip().strip(".!?;\n") or (a < b and text[a:b].strip() and text[a] not in ".!?;\n")]
    if not pieces:
        return [(a, min(a + size, len(text))) for a in range(0, max(len(text) - overlap, 1), size - overlap)] if text.strip() else []
    out, todo = [], pieces
    while todo:
        start, end = todo[0]
        if end - start > size:
            cuts = range(start, max(end - overlap, start + 1), size - overlap)
            out, todo = out + [(a, min(a + size, end)) for a in cuts], todo[1:]
            continue
        fitting = [p for p in todo if p[1] - start <= size]
        run = [p for p, q in zip(todo, fitting) if p == q]
        out.append((start, run[-1][1]))
        if len(run) == len(todo):
            break
        again = [p for p in run[1:] if p[0] >= run[-1][1] - overlap]
        todo = todo[todo.index(again[0]) :] if again else todo[len(run) :]
    return out


def test_whole_queries_by_brute_force(spark):
    import hashlib
    import os

    from corpusloom.plans import catalogue as C

    sf = "/root/testdata/sf0.001"
    if not os.path.isdir(sf):
        pytest.skip("no test data")
    key = lambda r: (r["doc_id"], r["part"], r["pos"])
    found = [r.asDict() for r in C.found(spark, sf).collect()]

    def quotas(rows, per_doc, per_type):
        h = lambda r: hashlib.md5(f"{r['doc_id']}:{r['part']}:{r['pos']}".encode()).hexdigest()
        out, docs, types = [], {}, {}
        for r in sorted(rows, key=lambda r: (h(r), r["doc_id"])):
            k = (r["question_type"], r["doc_id"])
            docs[k] = docs.get(k, 0) + 1
            if docs[k] <= per_doc:
                types[r["question_type"]] = types.get(r["question_type"], 0) + 1
                if types[r["question_type"]] <= per_type:
                    out.append(r)
        return out

    def lexical(rows):
        seen, out = set(), []
        for r in sorted(rows, key=key):
            q = (r["question_type"], re.sub(r"[?？。.!！,，;；:：\"'《》]", "", " ".join(r["question"].split())).lower())
            if q not in seen:
                seen.add(q)
                out.append(r)
        return out

    semantic = []
    for r in lexical(found):
        g = grams(r["question"])
        if not any(o["question_type"] == r["question_type"] and len(g & grams(o["question"])) >= 0.82 * len(g | grams(o["question"])) for o in semantic):
            semantic.append(r)
    told = lambda rows: sorted((r["question_type"], *key(r)) for r in rows)
    assert told(r.asDict() for r in C.QUERIES["candidate_dedup_semantic"](spark, sf).collect()) == told(semantic)

    rows, docs, parts, taken = quotas(lexical(found), 20, 60), {}, {}, []
    for kind in benchmark.TYPES:
        own = sorted((r for r in rows if r["question_type"] == kind), key=lambda r: (docs.get(r["doc_id"], 0), parts.get((r["doc_id"], r["part"]), 0), key(r)))
        first = []
        for r in own:
            if len(first) < 20 and docs.get(r["doc_id"], 0) < 2 and parts.get((r["doc_id"], r["part"]), 0) < 1:
                first.append(r)
                docs[r["doc_id"]] = docs.get(r["doc_id"], 0) + 1
                parts[r["doc_id"], r["part"]] = 1
        rest = [r for r in own if r not in first][: 20 - len(first)]
        for r in rest:
            docs[r["doc_id"]] = docs.get(r["doc_id"], 0) + 1
            parts[r["doc_id"], r["part"]] = parts.get((r["doc_id"], r["part"]), 0) + 1
        taken += first + rest
    assert told(r.asDict() for r in C.QUERIES["benchmark_select"](spark, sf).collect()) == told(taken)
    docs = C.documents(spark, sf).select("doc_id", "normalized_text").collect()
    want = sorted((r["doc_id"], k, a, b) for r in docs for k, (a, b) in enumerate(packed(r["normalized_text"], 500, 100)))
    got = sorted((r["doc_id"], r["chunk_index"], r["start_char"], r["end_char"]) for r in C.QUERIES["chunk_sentence_pack"](spark, sf).collect())
    assert got == want and all(b - a <= 500 for _, _, a, b in got)
    text = {r["doc_id"]: r["normalized_text"] for r in docs}
    for (d, _, a, b), (e, _, c, f) in zip(got, got[1:]):
        assert d != e or (a < c and f >= b and not text[d][b:c].strip())
