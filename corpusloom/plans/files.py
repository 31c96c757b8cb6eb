"""Queries that write tables to files and read them back by the library's readers, with their DuckDB SQL.

Each writes to a new folder that the cluster shares; what comes back must be what the SQL makes of the tables themselves.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.functions import text as T
from corpusloom.operators import benchmark, chunking, retrieval
from corpusloom.plans import catalogue as C
from corpusloom.plans import sql as S
from corpusloom.sources import records as R
from corpusloom.sources.shared import shared_folder

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def registered(sql: str):
    def put(f):
        QUERIES[f.__name__], ORACLES[f.__name__] = f, sql
        return f

    return put


def _text(name: str, alias: str | None = None):
    return F.col(name).cast("string").alias(alias or name)


def _in_turn(spark: SparkSession, label: str, *tables: DataFrame) -> list[str]:
    """Folders of the tables as JSON Lines, in the order in which readers take them."""
    root = shared_folder(spark, label)
    paths = [f"{root}/{k}" for k in range(len(tables))]
    for path, df in zip(paths, tables):
        R.write_table(df, path)
    return paths


@registered("SELECT doc_id, source AS publish_source, lang AS sub_title, md5(CASE WHEN doc_id % 2 = 0 THEN nullif(text, '') ELSE text END) AS digest FROM documents")
def raw_record_files(spark, sf):
    """Documents as raw records, the text under either of its two names, read in splits."""
    d = C.table(spark, sf, "documents")
    even = F.col("doc_id") % 2 == 0
    raw = d.select(F.col("doc_id").alias("docId"), F.col("source").alias("publishSource"), F.col("lang").alias("subTitle"), F.when(even, F.col("text")).alias("contentText"), F.when(~even, F.col("text")).alias("content"))
    back = R.read_raw(spark, *_in_turn(spark, "raw", raw), by_line=True)
    return back.select(F.get_json_object("extra", "$.docId").cast("long").alias("doc_id"), "publish_source", "sub_title", F.md5("content_text").alias("digest"))


@registered(f"WITH {S.DOCS} SELECT doc_id, title, source AS publish_source, lang AS language, md5(text) AS digest, md5(body) AS normalized_digest, CASE WHEN doc_id % 10 = 0 THEN 'again' ELSE '' END AS actions FROM d")
def document_files(spark, sf):
    """Documents as typed lines, every tenth once more in a later file with an action: the last of each."""
    d = C.documents(spark, sf)
    rows = d.select(_text("doc_id"), "title", F.col("source").alias("publish_source"), F.col("lang").alias("language"), F.col("text").alias("content_text"), "normalized_text")
    later = rows.where(F.col("doc_id").cast("long") % 10 == 0).withColumn("cleaning_actions", F.array(F.lit("again")))
    back = R.last_of(R.read_in_order(spark, R.DOCUMENT, *_in_turn(spark, "documents", rows, later)), "doc_id")
    return back.select(F.col("doc_id").cast("long").alias("doc_id"), "title", "publish_source", "language", F.md5("content_text").alias("digest"), F.md5("normalized_text").alias("normalized_digest"), F.coalesce(F.array_join("cleaning_actions", "|"), F.lit("")).alias("actions"))


@registered(
    f"WITH {C._WINDOWS}, {C._UNITS}, c AS (SELECT doc_id, chunk_index::INT AS chunk_index, 'fixed' AS corpus, md5(text) AS digest FROM k UNION ALL SELECT doc_id, part, 'structure', md5(text) FROM u) "
    "SELECT 'structure' AS asked, * FROM c WHERE corpus = 'structure' UNION ALL SELECT 'articles', * FROM c"
)
def chunk_files(spark, sf):
    """Chunks of two methods in one folder, read for a method that is there and for one that is not, with the corpus that each belongs to."""
    made = {"fixed": chunking.fixed_windows(C.documents(spark, sf)), "structure": C.units(spark, sf).withColumnRenamed("part", "chunk_index")}
    rows = [c.select(F.concat_ws("_", _text("doc_id"), F.lit(m), _text("chunk_index")).alias("chunk_id"), _text("doc_id"), "chunk_index", F.lit(m).alias("chunk_method"), "text") for m, c in made.items()]
    path = shared_folder(spark, "chunks")
    R.write_in_turn(path, *rows)
    chunks = R.read_table(spark, R.CHUNK, path)
    asked = [chunking.preferred(chunks, m).withColumn("asked", F.lit(m)) for m in ("structure", "articles")]
    return asked[0].unionByName(asked[1]).select("asked", F.col("doc_id").cast("long").alias("doc_id"), "chunk_index", chunking.partition_column(F.col("chunk_method")).alias("corpus"), F.md5("text").alias("digest"))


@registered(f"WITH {C._FULL} SELECT q.query_id, rank::INT AS rank, doc_id, round(score, 6) AS score, title, md5(body) AS digest, q.query_id % 2 = 0 AS answerable FROM q LEFT JOIN f USING (query_id)")
def result_files(spark, sf):
    """Queries and their results as lines, read back and flattened; a query without hits keeps a row."""
    asked = C.questions(spark, sf).select(_text("query_id"), "query_text", F.struct((F.col("query_id") % 2 == 0).alias("answerable")).alias("metadata"))
    hits = C.full_hits(spark, sf).select(_text("query_id"), "rank", _text("doc_id", "chunk_id"), _text("doc_id"), "score", F.lit("bm25").alias("retrieval_method"), F.col("text").alias("chunk_text"), "title")
    queries = R.read_table(spark, R.QUERY, *_in_turn(spark, "queries", asked))
    results = R.read_table(spark, R.RESULT, *_in_turn(spark, "results", R.nest_hits(hits, queries)))
    flat = R.flat_hits(results).join(queries.select("query_id", "metadata.answerable"), "query_id")
    return flat.select(F.col("query_id").cast("long").alias("query_id"), "rank", F.col("doc_id").cast("long").alias("doc_id"), F.round("score", 6).alias("score"), "title", F.md5("chunk_text").alias("digest"), "answerable")


@registered(f"WITH {C._ANSWERS} SELECT query_id, md5(CASE WHEN query_id % 7 = 0 THEN 'again: ' ELSE '' END || answer) AS digest, abstained, array_to_string(used, '|') AS used FROM an")
def answer_files(spark, sf):
    """Answers as lines, every seventh once more in a later file: the last of each."""
    rows = C.answers(spark, sf).select(_text("query_id"), "answer", "abstained", F.col("used").cast("array<string>").alias("used_context_ids"), F.lit("extractive").alias("generation_method"))
    later = rows.where(F.col("query_id").cast("long") % 7 == 0).withColumn("answer", F.concat(F.lit("again: "), "answer"))
    back = R.last_of(R.read_in_order(spark, R.ANSWER, *_in_turn(spark, "answers", rows, later)), "query_id")
    return back.select(F.col("query_id").cast("long").alias("query_id"), F.md5("answer").alias("digest"), "abstained", F.array_join("used_context_ids", "|").alias("used"))


_LEAST = f"{S.DOCS}, {S.QUERIES}, {S.QRELS}, gd AS (SELECT query_id, min(doc_id) AS gold FROM rel GROUP BY 1)"


def _least(spark, sf) -> DataFrame:
    """(query_id, query_text, raw, gold): the passages with the least document that holds each, or none."""
    return C.questions(spark, sf).join(C.relevant(spark, sf).groupBy("query_id").agg(F.min("doc_id").alias("gold")), "query_id", "left")


@registered(f"WITH {_LEAST} SELECT query_id, coalesce(gold::VARCHAR, '') AS relevant, md5(raw) AS digest, (query_id % 3)::VARCHAR AS question_type, gold IS NOT NULL AS answerable FROM q LEFT JOIN gd USING (query_id)")
def benchmark_files(spark, sf):
    """Benchmark records as lines, read with their positions and turned into gold."""
    rows, known = _least(spark, sf), F.col("gold").isNotNull()
    evidence = F.when(known, F.array(F.struct(_text("gold", "chunk_id"), _text("gold", "doc_id"), F.lit("").alias("evidence_text")))).otherwise(F.array())
    written = rows.select(_text("query_id"), F.col("query_text").alias("question"), (F.col("query_id") % 3).cast("string").alias("question_type"), known.alias("answerable"), F.col("raw").alias("gold_answer"), evidence.alias("gold_evidence"))
    gold = R.gold_of(R.read_benchmark(spark, *_in_turn(spark, "benchmark", written)))
    return gold.select(F.col("query_id").cast("long").alias("query_id"), F.array_join("relevant_chunk_ids", "|").alias("relevant"), F.md5("reference_answer").alias("digest"), "question_type", "answerable")


@registered(f"WITH {_LEAST} SELECT query_id, md5(query_text) AS query_digest, md5(raw) AS truth_digest, gold AS doc_id, md5(body) AS evidence_digest FROM q JOIN gd USING (query_id) JOIN d ON d.doc_id = gold")
def testset_files(spark, sf):
    """A test set of the passages that some document holds, as lines and back."""
    least = _least(spark, sf)
    docs = retrieval.of_hits(C.table(spark, sf, "documents"), least.select(F.col("gold").alias("doc_id")))
    held = least.join(docs.select(F.col("doc_id").alias("gold"), T.normalize_text(F.col("text")).alias("text")), "gold")
    path = shared_folder(spark, "testset")
    R.write_testset(held.select(_text("query_id"), F.col("query_text").alias("query"), F.col("raw").alias("ground_truth_answer"), _text("gold", "ground_truth_chunk_id"), _text("gold", "ground_truth_doc_id"), F.col("text").alias("evidence_text")), path)
    back = R.read_testset(spark, path)
    return back.select(F.col("query_id").cast("long").alias("query_id"), F.md5("query").alias("query_digest"), F.md5("ground_truth_answer").alias("truth_digest"), F.col("ground_truth_doc_id").cast("long").alias("doc_id"), F.md5("evidence_text").alias("evidence_digest"))


@registered(f"WITH {C._CANDIDATES} SELECT doc_id, doc_id || ':' || part AS chunk_id, question_type, question, md5(gold_answer) AS digest, true AS answerable, doc_id || ':' || part AS evidence FROM cd")
def candidate_files(spark, sf):
    """Candidates of a benchmark as lines and back, with the ids of their evidence."""
    rows = benchmark.to_candidates(C.found(spark, sf).withColumn("next_part", F.lit(None).cast("int")))
    back = R.read_candidates(spark, *_in_turn(spark, "candidates", rows))
    return back.select(F.col("source_doc_id").cast("long").alias("doc_id"), F.col("source_chunk_id").alias("chunk_id"), "question_type", "question", F.md5("gold_answer").alias("digest"), "answerable", F.array_join("gold_evidence_chunk_ids", "|").alias("evidence"))


def _csv(spark: SparkSession, df: DataFrame, label: str) -> DataFrame:
    path = shared_folder(spark, label)
    R.write_csv(df, path)
    return spark.read.option("header", True).csv(path)


@registered(f"WITH {C._EVAL} SELECT query_id, {', '.join(f'printf({chr(39)}%.4f{chr(39)}, {m}) AS {m}' for m in C.METRICS)} FROM me")
def metric_files(spark, sf):
    """Metrics of each query as a CSV file of numbers with four digits, and back."""
    m = R.metric_columns(C.metrics(spark, sf).select("query_id", *[T.format_metric(F.col(x)).alias(x) for x in C.METRICS]))
    return _csv(spark, m, "metrics").withColumn("query_id", F.col("query_id").cast("long"))


@registered(f"WITH {C._ERRORS} SELECT query_id, array_to_string(labels, '|') AS labels FROM er")
def error_files(spark, sf):
    """Error labels of each query as a CSV file, and back."""
    return _csv(spark, R.error_rows(C.errors(spark, sf)), "errors").select(F.col("query_id").cast("long").alias("query_id"), F.coalesce("labels", F.lit("")).alias("labels"))
