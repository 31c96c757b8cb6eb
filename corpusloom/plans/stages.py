"""Stages from files to files, each driven by a configuration (a mapping with paths and parameters)."""

from __future__ import annotations

import zipfile
from collections.abc import Callable
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.functions import text as T
from corpusloom.functions.presets import LATIN, ZH
from corpusloom.operators import answers, audit, benchmark, chunking, cleaning, context, evaluation, experiments, models, retrieval
from corpusloom.sources import records as R
from corpusloom.sources.shared import saved

Stage = Callable[[SparkSession, dict], None]
STAGES: dict[str, Stage] = {}
PRESETS = {"latin": LATIN, "zh": ZH}


def stage(name: str):
    def put(f: Stage) -> Stage:
        STAGES[name] = f
        return f

    return put


def _paths(value) -> list[str]:
    return [value] if isinstance(value, str) else list(value)


def _report(path: str | None, title: str, sections: dict[str, DataFrame]) -> None:
    if path:
        Path(path).parent.mkdir(parents=True, exist_ok=True)
        Path(path).write_text(R.markdown(title, sections))


def _flat(spark: SparkSession, path) -> DataFrame:
    """Hits of written results; queries without hits have none."""
    hits = R.flat_hits(R.read_table(spark, R.RESULT, *_paths(path))).where("rank is not null")
    return hits.withColumnRenamed("chunk_text", "text")


def _documents(spark: SparkSession, path) -> DataFrame:
    return R.read_table(spark, R.DOCUMENT, *_paths(path))


@stage("audit")
def audit_files(spark: SparkSession, c: dict) -> None:
    """inputs, output_jsonl[, detail_csv, report, limit]: raw records audited and normalised."""
    raw = R.read_raw(spark, *_paths(c["inputs"])).withColumn("published_year", T.extract_year(F.col("data_time")))
    out = audit.audit_stage(raw, c.get("limit"), ("source_file", "record_index"), "content_text", "publish_source", "title")
    docs = out["documents"].select("doc_id", "source_file", F.col("record_index").alias("source_record_index"), "title", "publish_source", "published_year", "content_text", "normalized_text", "structure_hints", "quality_flags")
    R.write_table(docs, c["output_jsonl"])
    if "detail_csv" in c:
        R.write_csv(out["detail"], c["detail_csv"])
    _report(c.get("report"), "Audit", {k: out[k] for k in ("missing", "profile", "histogram", "sources", "anomaly_counts")})


@stage("clean")
def clean_files(spark: SparkSession, c: dict) -> None:
    """input_jsonl, output_jsonl[, title_patterns, leading_patterns, global_patterns, source_aliases, report]."""
    done = cleaning.apply_cleaning(_documents(spark, c["input_jsonl"]), c.get("title_patterns", ()), c.get("leading_patterns", ()), c.get("global_patterns", ()), c.get("source_aliases"))
    R.write_table(done, c["output_jsonl"])
    _report(c.get("report"), "Cleaning", {"actions": cleaning.counts_of(done, "cleaning_actions"), "flags": cleaning.counts_of(done, "quality_flags")})


@stage("review-sample")
def review_files(spark: SparkSession, c: dict) -> None:
    """input_jsonl, detail_csv, output_csv[, size]: rows for a reader to look at."""
    docs = _documents(spark, c["input_jsonl"]).withColumn("text_length", F.char_length("normalized_text"))
    detail = spark.read.option("header", True).csv(_paths(c["detail_csv"]))
    R.write_csv(audit.review_rows(docs, detail, c.get("size", 20)), c["output_csv"])


@stage("chunk")
def chunk_files(spark: SparkSession, c: dict) -> None:
    """input_jsonl, output_jsonl[, method, size, overlap, least, sentence_overlap, preset, report]."""
    held = _documents(spark, c["input_jsonl"])
    body = F.coalesce(F.nullif("cleaned_text", F.lit("")), "normalized_text")
    docs = held.select("doc_id", body.alias("text"), body.alias("normalized_text"))
    made = chunking.chunk_stage(docs, c.get("method", "both"), c.get("size", 500), c.get("overlap", 100), c.get("least", 50), PRESETS[c.get("preset", "latin")], c.get("sentence_overlap", 0))
    chunks = made.join(held.select("doc_id", "title", "source_file", "quality_flags"), "doc_id")
    R.write_in_turn(c["output_jsonl"], *[chunks.where(F.col("chunk_method") == m) for m in ("fixed", "structure") if c.get("method", "both") in (m, "both")])
    written = R.read_table(spark, R.CHUNK, c["output_jsonl"])
    _report(c.get("report"), "Chunking", {"chunks": written.groupBy("chunk_method").agg(F.count("*").alias("n"), F.round(F.avg(F.char_length("text")), 1).alias("mean_length"))})


def _corpora(spark: SparkSession, path) -> dict[str, DataFrame]:
    chunks = R.read_table(spark, R.CHUNK, *_paths(path))
    rows = chunks.select(F.col("chunk_id").alias("doc_id"), "title", T.retrieval_text(F.col("title"), F.col("text")).alias("text"), chunking.partition_column(F.col("chunk_method")).alias("corpus"))
    names = sorted(r[0] for r in rows.select("corpus").distinct().collect())
    return {n: rows.where(F.col("corpus") == n).drop("corpus") for n in names}


@stage("retrieve")
def retrieve_files(spark: SparkSession, c: dict, make: Callable | None = None, client: Callable | None = None) -> None:
    """chunks_jsonl, queries_jsonl, output_jsonl[, mode, k, retrieve_k, reranker, fusion, index, dimensions, multi_query, hyde, include_original, url, model, report].

    Mode vector (and hybrid, if an index is named) reads the index that build-dense-index has written. multi_query (a number) and hyde ask a
    client for variants of each query; with include_original false the query itself is asked only where there are none.
    """
    queries = R.read_table(spark, R.QUERY, *_paths(c["queries_jsonl"])).select("query_id", "query_text")
    corpora = _corpora(spark, c["chunks_jsonl"])
    generated, vectors, encoded = None, None, None
    if c.get("multi_query") or c.get("hyde"):
        ask = client or models.http_client(c["url"], c["model"], c.get("key", ""))
        # A client is asked once, whatever reads the variants.
        generated = saved(models.expand(queries, ask, c.get("multi_query", 0), bool(c.get("multi_query")), bool(c.get("hyde"))), "variants")
    variants = retrieval.query_variants(queries, generated, c.get("include_original", True))
    if "index" in c:
        encode = make or (lambda: models.hashing_encoder(c.get("dimensions", 64)))
        vectors = {n: R.read_vectors(spark, c["index"], n).select(F.col("chunk_id").alias("doc_id"), F.col("embedding").alias("v")) for n in corpora}
        encoded = models.embed(variants, encode).select("query_id", "variant_no", F.col("embedding").alias("q"))
    hits = retrieval.retrieve(corpora, variants, c.get("mode", "hybrid"), c.get("k", 5), c.get("retrieve_k", 20), retrieval.build_reranker(c.get("reranker", "none")), c.get("fusion", "rrf"), vectors, encoded, queries)
    owner = R.read_table(spark, R.CHUNK, *_paths(c["chunks_jsonl"])).select("chunk_id", "doc_id")
    hits = hits.select("query_id", "rank", F.col("doc_id").alias("chunk_id"), "score", "retrieval_method", F.col("text").alias("chunk_text"), "title").join(owner, "chunk_id")
    hits = hits.select("query_id", "rank", "chunk_id", "doc_id", "score", "retrieval_method", "chunk_text", "title")
    R.write_table(R.nest_hits(hits, queries), c["output_jsonl"])
    _report(c.get("report"), "Retrieval", {"methods": hits.groupBy("retrieval_method").agg(F.count("*").alias("n"))})


@stage("build-dense-index")
def index_files(spark: SparkSession, c: dict, make: Callable | None = None) -> None:
    """chunks_jsonl, output[, dimensions]: vectors of all chunks, a folder for each corpus."""
    out = None
    for name, docs in _corpora(spark, c["chunks_jsonl"]).items():
        rows = docs.withColumn("corpus", F.lit(name))
        out = rows if out is None else out.unionByName(rows)
    encode = make or (lambda: models.hashing_encoder(c.get("dimensions", 64)))
    R.write_vectors(models.embed(out, encode).select("corpus", F.col("doc_id").alias("chunk_id"), "embedding"), c["output"])


@stage("process-contexts")
def context_files(spark: SparkSession, c: dict) -> None:
    """input_jsonl, output_jsonl[, max_chunks, max_per_doc, dedupe, max_sentences_per_chunk, max_sentences_total, report]."""
    hits = _flat(spark, c["input_jsonl"])
    compress = (c["max_sentences_per_chunk"], c["max_sentences_total"]) if "max_sentences_per_chunk" in c else None
    one = hits.withColumnRenamed("doc_id", "source").withColumnRenamed("chunk_id", "doc_id")
    kept = context.process_contexts(one, c.get("max_chunks", 5), c.get("max_per_doc", 2), c.get("dedupe", True), compress)
    rows = kept.join(one.select("query_id", "doc_id", "source", "score", "retrieval_method", "title"), ["query_id", "doc_id"])
    rows = rows.select("query_id", "rank", F.col("doc_id").alias("chunk_id"), F.col("source").alias("doc_id"), "score", "retrieval_method", F.col("text").alias("chunk_text"), "title")
    queries = R.read_table(spark, R.RESULT, *_paths(c["input_jsonl"])).select("query_id", "query_text")
    R.write_table(R.nest_hits(rows, queries), c["output_jsonl"])
    _report(c.get("report"), "Contexts", {"contexts": kept.select("query_id", "original_count", "processed_count", "compressed").distinct()})


@stage("generate")
def generate_files(spark: SparkSession, c: dict, make: Callable | None = None) -> None:
    """input_jsonl, output_jsonl[, generator, url, model, least_score, min_top_score, min_support, require_brackets, check_consistency, report]."""
    results = R.read_table(spark, R.RESULT, *_paths(c["input_jsonl"]))
    name = c.get("generator", "extractive")
    options = {"least_score": c.get("least_score", 0.0)} if name == "extractive" else {"make": make or models.http_client(c["url"], c["model"], c.get("key", ""))}
    out = answers.generation_stage(_flat(spark, c["input_jsonl"]), results, answers.build_generator(name, **options), c.get("min_top_score", 0.0), c.get("min_support", answers.CONSISTENT), c.get("require_brackets", False), c.get("check_consistency", False))
    said = lambda k: F.col(k).cast("string")
    extra = F.create_map(F.lit("guardrail_status"), said("guardrail_status"), F.lit("citation_support_ratio"), said("alignment.citation_support_ratio"))
    R.write_table(out.select("query_id", "query_text", "answer", "citations", "used_context_ids", "generation_method", "abstained", extra.alias("metadata")), c["output_jsonl"])
    _report(c.get("report"), "Generation", {"answers": answers.stage_counts(out)})


@stage("debug-llm-generation")
def debug_files(spark: SparkSession, c: dict, make: Callable | None = None) -> None:
    """input_jsonl, query_id, output_json[, url, model]: one query's answer, or the stage in which it failed."""
    try:
        result = R.result_of(R.read_table(spark, R.RESULT, *_paths(c["input_jsonl"])), c["query_id"])
        if result.isEmpty():
            raise ValueError(f"no retrieval result for query_id {c['query_id']}")
        hits = R.flat_hits(result).where("rank is not null").withColumnRenamed("chunk_text", "text")
        generator = answers.build_generator("llm", make=make or models.http_client(c["url"], c["model"], c.get("key", "")))
        row = answers.generation_stage(hits, result, generator).first()
        payload = {"query_id": c["query_id"], "failure_stage": "none", "answer": row.asDict(recursive=True)}
    except Exception as e:  # the failure is what the run is to show
        said = spark.createDataFrame([(f"{type(e).__name__}: {str(e)[:2000]}",)], "e string").select(answers.failure_stage(F.col("e"))).first()[0]
        payload = {"query_id": c["query_id"], "failure_stage": said, "error": str(e)[:2000]}
    R.write_debug(payload, c["output_json"])


def _gold(spark: SparkSession, c: dict, kind: str) -> DataFrame:
    """Gold of its own files, or of benchmark records."""
    if "benchmark_jsonl" in c:
        g = R.gold_of(R.read_benchmark(spark, *_paths(c["benchmark_jsonl"])))
        return g.withColumnRenamed("relevant_chunk_ids", "supporting_chunk_ids") if kind == "generation" else g
    return R.read_gold(spark, kind, *_paths(c["gold_jsonl"]))


def _summary(metrics: DataFrame) -> DataFrame:
    names = [c for c, t in metrics.dtypes if t == "double"]
    return metrics.agg(*[F.round(F.avg(n), 6).alias(n) for n in names])


@stage("eval-retrieval")
def eval_retrieval_files(spark: SparkSession, c: dict) -> None:
    """results_jsonl, gold_jsonl or benchmark_jsonl, output_csv[, ks, report]."""
    hits = _flat(spark, c["results_jsonl"]).select("query_id", F.col("chunk_id").alias("doc_id"), "rank")
    rel = _gold(spark, c, "retrieval").select("query_id", F.explode("relevant_chunk_ids").alias("doc_id"))
    m = evaluation.retrieval_metrics(hits, rel, R.read_table(spark, R.RESULT, *_paths(c["results_jsonl"])), tuple(c.get("ks", (1, 3, 5))))
    R.write_csv(R.metric_columns(m), c["output_csv"])
    _report(c.get("report"), "Retrieval metrics", {"summary": _summary(m)})


def _generation_metrics(answers_of: DataFrame, gold_of: DataFrame) -> DataFrame:
    said = answers_of.withColumnRenamed("used_context_ids", "used")
    gold = gold_of.select("query_id", F.col("reference_answer").alias("reference"), F.coalesce("supporting_chunk_ids", F.array().cast("array<string>")).alias("supporting"), "answerable", "question_type")
    m = evaluation.generation_metrics(said, gold)
    p, r = evaluation.token_precision_recall(F.col("answer"), F.col("reference"))
    held = said.join(gold, "query_id").select("query_id", p.alias("token_precision"), r.alias("token_recall"), F.coalesce(F.try_element_at("metadata", F.lit("citation_support_ratio")).cast("double"), F.lit(0.0)).alias("faithfulness"))
    return m.join(held, "query_id")


@stage("eval-generation")
def eval_generation_files(spark: SparkSession, c: dict) -> None:
    """answers_jsonl, gold_jsonl or benchmark_jsonl, output_csv[, report]."""
    m = _generation_metrics(R.read_table(spark, R.ANSWER, *_paths(c["answers_jsonl"])), _gold(spark, c, "generation"))
    R.write_csv(R.metric_columns(m), c["output_csv"])
    names = [n for n, t in m.dtypes if t == "double"]
    _report(c.get("report"), "Generation metrics", {"summary": _summary(m), "by type": evaluation.means(m, names, "question_type")})


@stage("analyze-errors")
def error_files(spark: SparkSession, c: dict) -> None:
    """results_jsonl, answers_jsonl, benchmark_jsonl, output_csv[, report]: labelled errors in the order of the benchmark; of what repeats a query the last in the files counts."""
    gold = R.last_of(R.gold_of(R.read_benchmark(spark, *_paths(c["benchmark_jsonl"]))), "query_id")
    rel = gold.select("query_id", F.explode("relevant_chunk_ids").alias("chunk_id")).withColumn("rel", F.lit(True))
    results = R.last_of(R.read_in_order(spark, R.RESULT, *_paths(c["results_jsonl"])), "query_id")
    hits = R.flat_hits(results).where("rank is not null").join(rel, ["query_id", "chunk_id"], "left")
    held = hits.groupBy("query_id").agg(F.bool_or(F.col("rel").isNotNull()).alias("hit_any"), F.bool_or(F.col("rel").isNotNull() & (F.col("rank") <= 1)).alias("hit_top"))
    said = R.last_of(R.read_in_order(spark, R.ANSWER, *_paths(c["answers_jsonl"])), "query_id")
    m = _generation_metrics(said, gold.withColumnRenamed("relevant_chunk_ids", "supporting_chunk_ids")).select("query_id", F.col("answer_correctness").alias("correctness"), F.col("faithfulness").alias("support"), F.col("abstained").cast("boolean").alias("abstained"))
    rows = gold.select("query_id", "answerable", "position").join(m, "query_id").join(results.select("query_id"), "query_id").join(held, "query_id", "left")
    errors = evaluation.error_labels(rows.withColumns({k: F.coalesce(k, F.lit(False)) for k in ("hit_any", "hit_top")}))
    R.write_csv(R.error_rows(errors.join(gold.select("query_id", "position"), "query_id").orderBy("position")), c["output_csv"])
    _report(c.get("report"), "Errors", {"Error Counts": cleaning.counts_of(errors, "labels")})


@stage("generate-benchmark")
def benchmark_files(spark: SparkSession, c: dict) -> None:
    """chunks_jsonl, output_jsonl[, method, quota, least, preset, raw_jsonl, deduped_jsonl, report]: benchmark records from chunks, and the candidates on the way."""
    preset = PRESETS[c.get("preset", "latin")]
    chunks = chunking.preferred(R.read_table(spark, R.CHUNK, *_paths(c["chunks_jsonl"])), c.get("method", "both"))
    units = chunking.articles(chunks.select(F.col("chunk_id").alias("doc_id"), "text"), preset.article, c.get("least_length", 40))
    steps = benchmark.benchmark_steps(units, c.get("quota", 10), preset=preset)
    if steps["final"].count() < c.get("least", 0):
        raise ValueError(f"fewer than {c['least']} candidates are left")
    for name in ("raw", "deduped"):
        if f"{name}_jsonl" in c:
            R.write_table(benchmark.to_candidates(steps[name]), c[f"{name}_jsonl"])
    R.write_table(benchmark.to_records(steps["final"], units), c["output_jsonl"])
    counts = benchmark.distribution_by_stage({k: steps[k] for k in ("raw", "deduped", "final")})
    _report(c.get("report"), "Benchmark", {"distribution": counts, "filtered": steps["reasons"]})


@stage("validate-benchmark")
def validate_files(spark: SparkSession, c: dict) -> None:
    """benchmark_jsonl, report: what is wrong with benchmark records."""
    b = R.read_benchmark(spark, *_paths(c["benchmark_jsonl"]))
    _report(c["report"], "Benchmark validation", {"summary": evaluation.validate_benchmark(b.withColumn("n_evidence", F.greatest(F.size("gold_evidence"), F.lit(0))))})


@stage("run-ablation")
def ablation_files(spark: SparkSession, c: dict) -> None:
    """variants (name: metric CSV), report: the variants' mean metrics side by side."""
    out = None
    for name, path in c["variants"].items():
        m = spark.read.option("header", True).option("inferSchema", True).csv(path).withColumn("variant", F.lit(name))
        out = m if out is None else out.unionByName(m, allowMissingColumns=True)
    names = [n for n, t in out.dtypes if t in ("double", "int", "bigint") and n not in ("query_id", "variant")]
    _report(c["report"], "Ablation", {"metrics": evaluation.ablation(out, names, list(c["variants"]))})


@stage("auto-testset")
def testset_files(spark: SparkSession, c: dict, make: Callable | None = None) -> None:
    """chunks_jsonl, output_jsonl[, n, url, model, report]: a test set of questions about chunks, by a client."""
    chunks = R.read_table(spark, R.CHUNK, *_paths(c["chunks_jsonl"]))
    asked = experiments.auto_testset(chunks.select(F.col("chunk_id").alias("doc_id"), "text"), make or models.http_client(c["url"], c["model"], c.get("key", "")), c.get("n", 20))
    owner = chunks.select(F.col("chunk_id").alias("ground_truth_chunk_id"), F.col("doc_id").alias("ground_truth_doc_id"))
    rows = asked.select(F.concat(F.lit("auto_"), "doc_id").alias("query_id"), F.col("question").alias("query"), F.col("answer").alias("ground_truth_answer"), F.col("doc_id").alias("ground_truth_chunk_id"), F.col("evidence").alias("evidence_text"))
    R.write_testset(rows.join(owner, "ground_truth_chunk_id"), c["output_jsonl"])
    _report(c.get("report"), "Test set", {"questions": R.read_testset(spark, c["output_jsonl"]).agg(F.count("*").alias("n"))})


@stage("auto-eval")
def auto_eval_files(spark: SparkSession, c: dict, make: Callable | None = None) -> None:
    """testset_jsonl, chunks_jsonl, variants (name: mode, k, reranker, generator, ...), output_csv[, url, model, report]: each variant retrieves, selects contexts, answers and is scored."""
    testset = R.read_testset(spark, *_paths(c["testset_jsonl"])).select("query_id", F.col("query").alias("question"), F.col("ground_truth_answer").alias("truth"), F.col("ground_truth_chunk_id").alias("doc_id"), F.col("evidence_text").alias("evidence"))
    corpora = _corpora(spark, c["chunks_jsonl"])
    owner = R.read_table(spark, R.CHUNK, *_paths(c["chunks_jsonl"])).select(F.col("chunk_id").alias("doc_id"), F.col("doc_id").alias("source"))

    def variant(v: dict) -> Callable[[DataFrame], tuple[DataFrame, DataFrame]]:
        def run(asked: DataFrame) -> tuple[DataFrame, DataFrame]:
            queries = asked.select("query_id", F.col("question").alias("query_text"))
            hits = retrieval.retrieve(corpora, retrieval.query_variants(queries), v.get("mode", "hybrid"), v.get("k", 5), v.get("retrieve_k", 20), retrieval.build_reranker(v.get("reranker", "none")), v.get("fusion", "rrf"))
            kept = context.select_contexts(hits.join(owner, "doc_id"), v.get("max_chunks", 5), v.get("max_per_doc", 2))
            shown = kept.select("query_id", "query_text", "rank", F.col("doc_id").alias("chunk_id"), F.col("source").alias("doc_id"), "score", "retrieval_method", "text", "title")
            name = v.get("generator", "extractive")
            options = {"least_score": v.get("least_score", 0.0)} if name == "extractive" else {"make": make or models.http_client(c["url"], c["model"], c.get("key", ""))}
            said = answers.generation_stage(shown, queries, answers.build_generator(name, **options), v.get("min_top_score", 0.0))
            return said.select("query_id", "answer", F.col("used_context_ids").alias("used")), hits

        return run

    table = experiments.auto_eval_variants({name: variant(v) for name, v in c["variants"].items()}, testset)
    R.write_csv(table, c["output_csv"])
    _report(c.get("report"), "Auto evaluation", {"variants": spark.read.option("header", True).csv(c["output_csv"])})


@stage("run-experiments")
def experiment_files(spark: SparkSession, c: dict) -> None:
    """folder, and variants (name: stage by name with its configuration) or matrix with chunks_jsonl, queries_jsonl, benchmark_jsonl[, options by stage].

    Each variant's stages run in order; a failure names its stage and stops no other variant. The folder gets a CSV of the stages, the
    variants' mean metrics and those by type of question, a summary and a bundle of all reports.
    """
    folder = c["folder"]
    variants = c["variants"] if "variants" in c else experiments.expanded(folder, c["matrix"], c, c.get("options"))
    rows, done, failed, by_type = [], [], {}, None
    for name, steps in variants.items():
        means: dict[str, object] = {"variant": name}
        for step, config in steps.items():
            try:
                STAGES[step](spark, config)
                rows.append((name, step, "done", ""))
                if step in ("eval-retrieval", "eval-generation"):
                    m = spark.read.option("header", True).option("inferSchema", True).csv(config["output_csv"])
                    numbers = [n for n, t in m.dtypes if t in ("double", "int", "bigint") and n not in ("query_id", "variant")]
                    means |= m.agg(*[F.avg(n).alias(n) for n in numbers]).first().asDict()
                    if "question_type" in m.columns:
                        group = m.groupBy(F.lit(name).alias("variant"), "question_type").agg(F.count("*").alias("n"), *[F.round(F.avg(n), 6).alias(n) for n in numbers])
                        by_type = group if by_type is None else by_type.unionByName(group, allowMissingColumns=True)
            except Exception as e:  # a variant's own failure belongs in the report
                failed[name] = f"{step}: {type(e).__name__}: {str(e)[:300]}"
                rows.append((name, step, "failed", f"{type(e).__name__}: {str(e)[:300]}"))
                break
        done.append(means)
    summary = spark.createDataFrame(rows, "variant string, stage string, status string, error string")
    R.write_csv(summary, f"{folder}/summary_csv")
    bundle = experiments.write_report(folder, done, failed)
    sections = {"stages": summary} | ({"by type": by_type} if by_type is not None else {})
    _report(f"{folder}/stages.md", "Experiments", sections)
    with zipfile.ZipFile(bundle, "a") as z:
        z.write(f"{folder}/stages.md", "stages.md")
