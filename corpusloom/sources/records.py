"""Sources and sinks: JSON records, typed tables as JSON Lines, CSV, vector tables and configuration."""

from __future__ import annotations

import json
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

DOCUMENT = "doc_id string, source_file string, source_record_index int, title string, publish_source string, published_year int, content_text string, normalized_text string, cleaned_text string, language string, structure_hints array<string>, quality_flags array<string>, cleaning_actions array<string>"
CHUNK = "chunk_id string, doc_id string, chunk_index int, chunk_method string, text string, start_char int, end_char int, title string, source_file string, section_path array<string>, quality_flags array<string>"
QUERY = "query_id string, query_text string, metadata struct<question_type: string, answerable: boolean>"
HIT = "struct<rank: int, chunk_id: string, doc_id: string, score: double, retrieval_method: string, chunk_text: string, title: string>"
RESULT = f"query_id string, query_text string, hits array<{HIT}>"
CITATION = "struct<label: string, chunk_id: string, doc_id: string, title: string, span_text: string, rank: int, source_ref: string>"
ANSWER = f"query_id string, query_text string, answer string, citations array<{CITATION}>, used_context_ids array<string>, generation_method string, abstained boolean, metadata map<string, string>"
CANDIDATE = "query_id string, question string, question_type string, answerable boolean, gold_answer string, gold_evidence_chunk_ids array<string>, source_doc_id string, source_chunk_id string"
TESTSET = "query_id string, query string, ground_truth_answer string, ground_truth_chunk_id string, ground_truth_doc_id string, evidence_text string"
RETRIEVAL_GOLD = "query_id string, relevant_chunk_ids array<string>"
GENERATION_GOLD = "query_id string, reference_answer string, supporting_chunk_ids array<string>, question_type string, answerable boolean"
BENCHMARK = "query_id string, question string, question_type string, answerable boolean, gold_answer string, gold_evidence array<struct<chunk_id: string, doc_id: string, evidence_text: string>>"
ALIASES = {"title": "title", "sub_title": "subTitle", "data_time": "dataTime", "publish_source": "publishSource", "intro_title": "introTitle"}


def _records(text: DataFrame) -> DataFrame:
    """(source_file, record_index, record variant) of whole files (source_file, value): an array, an object with a data array, or JSON Lines.

    What does not parse as one document is read as JSON Lines.
    """
    whole = text.withColumn("v", F.try_parse_json("value"))
    kind = F.schema_of_variant("v")
    items = F.when(kind.startswith("ARRAY"), F.try_variant_get("v", "$", "array<variant>")).when(kind.startswith("OBJECT"), F.try_variant_get("v", "$.data", "array<variant>"))
    parsed = whole.withColumn("items", items)
    listed = parsed.where("items is not null").select("source_file", F.posexplode("items").alias("record_index", "record"))
    lines = parsed.where("items is null").select("source_file", F.posexplode(F.split("value", "\r?\n")).alias("record_index", "line"))
    return listed.unionByName(_parsed(lines))


def _parsed(lines: DataFrame) -> DataFrame:
    """Records of lines (source_file, record_index, line) but blank ones; a line that is no object is an error."""
    record = F.parse_json("line")
    bad = F.when(~F.schema_of_variant(record).startswith("OBJECT"), F.raise_error(F.concat(F.lit("not an object in "), "source_file")))
    return lines.where(F.btrim("line") != "").select("source_file", F.col("record_index").cast("int").alias("record_index"), F.coalesce(bad.cast("variant"), record).alias("record"))


def read_lines(spark: SparkSession, *paths: str, suffix: str = ".jsonl") -> DataFrame:
    """(path, source_file, record_index, line) of .jsonl files (or others), blank lines counted; a file of any size is read in splits.

    A line's index is its place in its split and the number of lines in the file's splits before that one.
    """
    lines = spark.read.option("pathGlobFilter", f"*{suffix}").text(list(paths)).select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("block"), F.col("value").alias("line"), F.monotonically_increasing_id().alias("at"))
    heads = lines.groupBy("path", "block").agg(F.min("at").alias("first"), F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("path").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    heads = heads.select("path", "block", "first", before.alias("before"))
    return lines.join(heads, ["path", "block"]).select("path", F.element_at(F.split("path", "/"), -1).alias("source_file"), (F.col("before") + F.col("at") - F.col("first")).alias("record_index"), "line")


def read_raw(spark: SparkSession, *paths: str, by_line: bool = False) -> DataFrame:
    """Raw records of .json and .jsonl files (or folders of them), with aliased fields as text and the whole record in `extra`.

    A .json file is read whole, as it may be one array or object; with by_line such files are JSON Lines too, as Spark writes
    them, and are read in splits.
    """
    if any(Path(p).suffix not in ("", ".json", ".jsonl") for p in paths):
        raise ValueError("only .json and .jsonl files can be read")
    rows = _parsed(read_lines(spark, *paths))
    if by_line:
        rows = rows.unionByName(_parsed(read_lines(spark, *paths, suffix=".json")))
    else:
        text = spark.read.option("pathGlobFilter", "*.json").text(list(paths), wholetext=True).select(F.element_at(F.split(F.input_file_name(), "/"), -1).alias("source_file"), "value")
        rows = rows.unionByName(_records(text))
    get = lambda k: F.try_variant_get("record", f"$.{k}", "string")
    body = F.coalesce(F.nullif(get("contentText"), F.lit("")), get("content"))
    return rows.select(F.concat_ws(":", "source_file", F.col("record_index").cast("string")).alias("doc_id"), "source_file", "record_index", *[get(j).alias(c) for c, j in ALIASES.items()], body.alias("content_text"), F.to_json("record").alias("extra"))


def read_table(spark: SparkSession, schema: str, *paths: str) -> DataFrame:
    """A typed JSON Lines table; absent fields are null."""
    return spark.read.schema(schema).json(list(paths))


def write_table(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """JSON Lines; mode append adds to what is there."""
    df.write.mode(mode).json(path)


def write_in_turn(path: str, *tables: DataFrame) -> None:
    """The first table replaces what is there, the others are added to it."""
    for k, df in enumerate(tables):
        write_table(df, path, "append" if k else "overwrite")


def result_of(results: DataFrame, query_id: str) -> DataFrame:
    """The result of one query, a row or none."""
    return results.where(F.col("query_id") == query_id).limit(1)


def read_in_order(spark: SparkSession, schema: str, *paths: str) -> DataFrame:
    """A typed JSON Lines table with `position`, the file and the number of the line (from 1) that a row comes from, which order rows whatever the partitioning."""
    lines = read_lines(spark, *paths, suffix="").where(F.btrim("line") != "")
    rows = lines.select(F.struct("path", "source_file", (F.col("record_index") + 1).alias("line")).alias("position"), F.from_json("line", schema).alias("r"))
    return rows.select("r.*", "position")


def last_of(rows: DataFrame, *key: str) -> DataFrame:
    """Of rows with equal keys the one that came last in the files."""
    own = [c for c in rows.columns if c not in (*key, "position")]
    return rows.groupBy(*key).agg(F.max_by(F.struct(*own), "position").alias("_r"), F.max("position").alias("position")).select(*key, "_r.*", "position")


def required(df: DataFrame, *names: str) -> DataFrame:
    """df, failing when it is read on a row that lacks one of the fields; with a position the error names its file and line."""
    at = F.concat(F.lit(" in "), F.col("position.source_file"), F.lit(", line "), F.col("position.line").cast("string")) if "position" in df.columns else F.lit("")
    check = lambda n: F.when(F.col(n).isNull(), F.raise_error(F.concat(F.lit(f"missing field {n}"), at))).otherwise(F.col(n))
    return df.withColumns({n: check(n) for n in names})


def read_gold(spark: SparkSession, kind: str, *paths: str) -> DataFrame:
    """Plain gold, retrieval or generation; what lacks counts as an answerable question of type other."""
    g = read_table(spark, {"retrieval": RETRIEVAL_GOLD, "generation": GENERATION_GOLD}[kind], *paths)
    return g if kind == "retrieval" else g.withColumns({"question_type": F.coalesce("question_type", F.lit("other")), "answerable": F.coalesce("answerable", F.lit(True))})


def read_benchmark(spark: SparkSession, *paths: str) -> DataFrame:
    """Benchmark records with their position; one that lacks a field is an error that names its file and line."""
    return required(read_in_order(spark, BENCHMARK, *paths), "query_id", "question", "question_type", "answerable", "gold_answer")


def gold_of(benchmark: DataFrame) -> DataFrame:
    """(query_id, relevant_chunk_ids, reference_answer, question_type, answerable) from benchmark records."""
    position = ["position"] if "position" in benchmark.columns else []
    return benchmark.select(*position, "query_id", F.col("gold_evidence.chunk_id").alias("relevant_chunk_ids"), F.col("gold_answer").alias("reference_answer"), F.coalesce("question_type", F.lit("other")).alias("question_type"), F.coalesce("answerable", F.lit(True)).alias("answerable"))


def nest_hits(hits: DataFrame, queries: DataFrame) -> DataFrame:
    """A row per query with its hits in rank order; queries without hits have none. A query's hits are its top k."""
    cols = ["rank", *[c for c in hits.columns if c not in ("query_id", "rank", "query_text")]]
    lists = hits.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct(*cols))).alias("hits"))
    return queries.select("query_id", "query_text").join(lists, "query_id", "left")


def flat_hits(results: DataFrame) -> DataFrame:
    """A row per hit; queries without hits keep one row without a rank."""
    return results.select("query_id", "query_text", F.explode_outer("hits").alias("h")).select("query_id", "query_text", "h.*")


def details(duplicates: DataFrame, anomalies: DataFrame) -> DataFrame:
    """Duplicates (kind, fingerprint, doc_ids) and anomalies (doc_id, anomaly, severity) as rows of one report."""
    d = duplicates.select(F.col("kind").alias("record_type"), F.col("fingerprint").alias("key"), "doc_ids", F.lit("medium").alias("severity"))
    a = anomalies.select(F.lit("anomaly").alias("record_type"), F.col("anomaly").alias("key"), F.col("doc_id").cast("string").alias("doc_ids"), "severity")
    return d.unionByName(a)


def error_rows(errors: DataFrame) -> DataFrame:
    """Errors (query_id, labels[, notes]) for a CSV: labels joined by |, notes by a | between spaces."""
    notes = F.array_join("notes", " | ") if "notes" in errors.columns else F.lit("")
    return errors.select("query_id", F.array_join("labels", "|").alias("labels"), notes.alias("notes"))


def write_debug(payload: dict, path: str) -> None:
    """One run's payload as indented JSON."""
    Path(path).parent.mkdir(parents=True, exist_ok=True)
    Path(path).write_text(json.dumps(payload, ensure_ascii=False, indent=2, default=str) + "\n")


def read_report(spark: SparkSession, *paths: str) -> DataFrame:
    """(source_file, section, key, value) of the `- key: value` lines of Markdown reports, in the section above each."""
    text = spark.read.text(list(paths), wholetext=True).select(F.element_at(F.split(F.input_file_name(), "/"), -1).alias("source_file"), F.posexplode(F.split("value", "\n## ")).alias("_n", "part"))
    lines = text.where("_n > 0").select("source_file", F.btrim(F.split_part("part", F.lit("\n"), F.lit(1))).alias("section"), F.explode(F.split("part", "\n")).alias("line"))
    found = lambda k: F.regexp_extract("line", r"^- `?([^`:]+)`?: (.*)$", k)
    return lines.where(F.col("line").rlike(r"^- `?[^`:]+`?: ")).select("source_file", "section", found(1).alias("key"), F.btrim(found(2)).alias("value"))


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).csv(path)


def metric_columns(metrics: DataFrame) -> DataFrame:
    """query_id first, then the metrics in the order of their names."""
    return metrics.select("query_id", *sorted(c for c in metrics.columns if c != "query_id"))


def write_testset(rows: DataFrame, path: str) -> None:
    """A test set (TESTSET) as JSON Lines."""
    write_table(rows.select(*[c.split()[0] for c in TESTSET.split(", ")]), path)


def read_testset(spark: SparkSession, *paths: str) -> DataFrame:
    """A test set; a row without an id, a query or the chunk that it is about is an error."""
    return required(read_in_order(spark, TESTSET, *paths), "query_id", "query", "ground_truth_chunk_id").drop("position")


def read_candidates(spark: SparkSession, *paths: str) -> DataFrame:
    """Benchmark candidates that a stage has written."""
    return required(read_in_order(spark, CANDIDATE, *paths), "question", "question_type").drop("position")


def write_vectors(vectors: DataFrame, path: str) -> None:
    """A vector index (corpus, pos, chunk_id, embedding), a folder per corpus."""
    vectors.write.mode("overwrite").partitionBy("corpus").parquet(path)


def read_vectors(spark: SparkSession, path: str, corpus: str | None = None) -> DataFrame:
    v = spark.read.parquet(path)
    return v.where(F.col("corpus") == corpus) if corpus else v


def load_config(path: str) -> dict:
    """A configuration file (JSON, or YAML where that library is there); it must be a mapping."""
    text = Path(path).read_text()
    if path.endswith(".json"):
        out = json.loads(text)
    else:
        import yaml

        out = yaml.safe_load(text)
    if not isinstance(out, dict):
        raise ValueError("a configuration must be a mapping")
    return out


def markdown(title: str, sections: dict[str, DataFrame], most: int = 100) -> str:
    """A report of small aggregates; of each the first `most` rows."""
    out = [f"# {title}"]
    for name, df in sections.items():
        out += ["", f"## {name}", "", "| " + " | ".join(df.columns) + " |", "|" + "-|" * len(df.columns)]
        out += ["| " + " | ".join("" if v is None else str(v) for v in r) + " |" for r in df.limit(most).collect()]
    return "\n".join(out) + "\n"
