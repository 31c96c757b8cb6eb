"""Further queries: the stages of retrieval, generation, chunking, audit and benchmark synthesis, with their DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.functions import text as T
from corpusloom.operators import answers, audit, benchmark, chunking, context, evaluation, retrieval
from corpusloom.plans import catalogue as C
from corpusloom.plans import sql as S

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def registered(sql: str | None = None):
    def put(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return put


# Audit

_NEAR = C.ORACLES["near_duplicate_pairs"]
#: All documents within the threshold, each with each.
_LINKS = f"WITH {C._simhash_sql()} SELECT x.doc_id AS a, y.doc_id AS b, ({C._APART})::BIGINT AS distance FROM fp x JOIN fp y ON x.doc_id < y.doc_id WHERE {C._APART} <= 3"


@registered(f"WITH {S.DOCS}, k AS (SELECT doc_id, sha1(trim(body)) AS f FROM d WHERE trim(body) <> '') SELECT doc_id, min(doc_id) OVER (PARTITION BY f) AS first_doc_id, count(*) OVER (PARTITION BY f) AS n FROM k QUALIFY n > 1")
def exact_duplicate_members(spark, sf):
    return audit.duplicate_members(C.documents(spark, sf), F.col("normalized_text"))


@registered(f"WITH p AS ({_NEAR}), g AS (SELECT b, list_sort(list_distinct(list_append(list(DISTINCT a), b))) AS ids FROM p GROUP BY b) SELECT DISTINCT len(ids)::INT AS n, array_to_string(ids, '|') AS doc_ids FROM g")
def near_duplicate_groups(spark, sf):
    return audit.near_duplicate_groups(audit.near_duplicate_pairs(audit.simhash_halves(C.table(spark, sf, "documents"))))


_DETAIL = f"""WITH e AS ({C.ORACLES['exact_title_duplicates']}), b AS ({C.ORACLES['exact_body_duplicates']}), n AS ({ORACLES['near_duplicate_groups']}), a AS ({C.ORACLES['anomalies']}),
det AS (SELECT kind || '_duplicate' AS record_type, fingerprint AS key, doc_ids, NULL::VARCHAR AS severity, 'group of ' || n AS note FROM (SELECT * FROM e UNION ALL SELECT * FROM b)
 UNION ALL SELECT 'near_duplicate', md5(doc_ids), doc_ids, NULL, 'group of ' || n FROM n UNION ALL SELECT 'anomaly', anomaly, doc_id::VARCHAR, severity, NULL FROM a)"""


@registered(f"{_DETAIL} SELECT record_type, md5(key || ':' || doc_ids) AS digest, severity, note FROM det")
def audit_detail(spark, sf):
    d = audit.audit_stage(C.table(spark, sf, "documents"))["detail"]
    return d.select("record_type", F.md5(F.concat_ws(":", "key", "doc_ids")).alias("digest"), "severity", "note")


@registered(
    f"{_DETAIL.replace(_NEAR, _LINKS)}, i AS (SELECT record_type, key, unnest(string_split(doc_ids, '|'))::BIGINT AS doc_id, generate_subscripts(string_split(doc_ids, '|'), 1) AS pos FROM det), "
    "f AS (SELECT CASE WHEN contains(record_type, 'duplicate') THEN 'duplicate' ELSE 'anomaly' END AS sample_type, doc_id, min({'t': record_type, 'k': key, 'p': pos}) AS place FROM i GROUP BY ALL), "
    "p AS (SELECT sample_type, doc_id FROM f QUALIFY row_number() OVER (PARTITION BY sample_type ORDER BY place, doc_id) <= 20 UNION ALL SELECT 'random', doc_id FROM (SELECT doc_id FROM documents ORDER BY md5(doc_id::VARCHAR), doc_id LIMIT 20)), "
    f"{S.DOCS} SELECT sample_type, doc_id, title, source, length(body)::INT AS text_length, CASE WHEN length(body) = 0 THEN 'empty_body' WHEN length(body) < 30 THEN 'short_body' ELSE '' END AS flags, left(body, 300) AS preview FROM p JOIN d USING (doc_id)"
)
def review_rows(spark, sf):
    docs, detail, near = audit.audit_for_review(C.table(spark, sf, "documents"))
    return audit.review_rows(docs, detail, 20, near=near)


# Retrieval

def _variants(spark, sf):
    return retrieval.query_variants(C.questions(spark, sf).select("query_id", "query_text"))


def _merged(name: str, hits: str, prior: str) -> str:
    """What merging the list of one corpus and the original queries gives."""
    return f"{name}0 AS (SELECT query_id, doc_id, 65e-2 * {S.minmax('score', 'PARTITION BY query_id')} + 3e-1 / (6e1 + rank) + {prior} + 8e-2 AS score FROM {hits}), {name} AS (SELECT *, {S.RANK} AS rank FROM {name}0)"


_DRIVER = f"""{C._BOTH}, {_merged('mb', 'bm', '8e-2')}, {_merged('mt', 'te', '8e-2')}, {S.fused('fr', 'mb', 'mt', C.TOP)},
dx AS (SELECT query_id, doc_id, score + 4e-1 * {S.overlap(S.tokens('query_text'), S.tokens('title'))} + 4e-1 * {S.overlap(S.tokens('query_text'), S.tokens('left(body, 500)'))} AS score FROM fr JOIN q USING (query_id) JOIN d USING (doc_id)), dr AS (SELECT *, {S.RANK} AS rank FROM dx QUALIFY rank <= 5)"""


def piped(spark, sf):
    docs = C.documents(spark, sf).select("doc_id", "title", F.col("normalized_text").alias("text"))
    return retrieval.retrieve({"structure": docs}, _variants(spark, sf), "hybrid", 5, C.TOP, retrieval.build_reranker("heuristic"), searched={"structure": C.searched(spark, sf)})


@registered(f"WITH {_DRIVER} SELECT query_id, rank::INT AS rank, doc_id, round(score, 6) AS score, 'hybrid_rrf+heuristic_rerank' AS retrieval_method FROM dr")
def retrieval_pipeline(spark, sf):
    return piped(spark, sf).select("query_id", "rank", "doc_id", F.round("score", 6).alias("score"), "retrieval_method")


@registered(f"WITH {C._BOTH}, u AS (SELECT query_id, doc_id, rank, score FROM bm UNION ALL SELECT query_id, doc_id, rank, score FROM te), w AS (SELECT * FROM u QUALIFY row_number() OVER (PARTITION BY query_id, doc_id ORDER BY rank, score DESC) = 1) SELECT query_id, doc_id, row_number() OVER (PARTITION BY query_id ORDER BY rank, score DESC, doc_id)::INT AS rank FROM w")
def hit_dedupe(spark, sf):
    both = C.bm25_hits(spark, sf).unionByName(C.tfidf_hits(spark, sf))
    key = T.hit_key(F.lit(None).cast("string"), F.col("doc_id").cast("string"), F.lit(""), F.lit(""))
    return retrieval.dedupe_hits(both, key).select("query_id", "doc_id", "rank")


# Contexts and answers

_KEPT = C.ORACLES["context_dedupe"].rpartition(" SELECT query_id, generate_subscripts")[0]


@registered(
    f"{_KEPT}, e AS (SELECT query_id, generate_subscripts(kept, 1) AS rank, unnest(list_transform(kept, lambda x: x.doc_id)) AS doc_id, unnest(list_transform(kept, lambda x: x.source)) AS source FROM l), "
    "s1 AS (SELECT * FROM e QUALIFY row_number() OVER (PARTITION BY query_id, source ORDER BY rank) <= 2), s2 AS (SELECT query_id, doc_id, row_number() OVER (PARTITION BY query_id ORDER BY rank) AS place FROM s1 QUALIFY place <= 5) "
    "SELECT query_id, place::INT AS rank, doc_id, (SELECT count(*) FROM f WHERE f.query_id = s2.query_id) AS original_count, count(*) OVER (PARTITION BY query_id) AS processed_count, false AS compressed FROM s2"
)
def context_stage(spark, sf):
    c = context.process_contexts(C.full_hits(spark, sf), 5, 2)
    return c.select("query_id", "rank", "doc_id", "original_count", "processed_count", "compressed")


_SAID = """CASE event_id % 6
 WHEN 0 THEN '{"answer": "It is ' || event_type || ' [1].", "used_context_ids": ["e' || event_id || '", "none"], "abstained": false}'
 WHEN 1 THEN '<think>{ hm</think> Sure: {"answer": "It is ' || event_type || '", "used_context_ids": ["f' || event_id || '"]} done'
 WHEN 2 THEN '{"answer": "It is \\\\"so\\\\" [2] [9]", "abstained": false, "used_context_ids": ["e' || event_id
 WHEN 3 THEN 'Nothing here is an object.'
 WHEN 4 THEN '{"answer": "we saw that ' || event_type || ' took place", "used_context_ids": [7, "gone"]}'
 ELSE '{"answer": "?!", "abstained": "no"}' END"""


@registered(
    """SELECT event_id, CASE event_id % 6 WHEN 0 THEN 'It is ' || event_type || ' [1].' WHEN 1 THEN 'It is ' || event_type WHEN 2 THEN 'It is "so" [2] [9]' WHEN 3 THEN 'Nothing here is an object.' WHEN 4 THEN 'we saw that ' || event_type || ' took place' ELSE '?!' END AS answer,
 event_id % 6 IN (3, 5) AS abstained,
 CASE event_id % 6 WHEN 0 THEN 'e' || event_id WHEN 1 THEN 'f' || event_id WHEN 2 THEN 'f' || event_id WHEN 4 THEN 'e' || event_id ELSE '' END AS used,
 CASE event_id % 6 WHEN 0 THEN 'none' WHEN 4 THEN 'gone' ELSE '' END AS invalid,
 CASE event_id % 6 WHEN 0 THEN 'filtered_invalid_context_ids' WHEN 2 THEN 'inferred_context_ids_from_citations' WHEN 4 THEN 'inferred_context_ids_from_answer' ELSE 'valid' END AS schema_status,
 CASE event_id % 6 WHEN 0 THEN 'strict_json' WHEN 1 THEN 'loose_json' WHEN 2 THEN 'relaxed_extraction' WHEN 3 THEN 'minimal_fallback' ELSE 'strict_json' END AS parse_status FROM events"""
)
def llm_answer_normalisation(spark, sf):
    e = C.table(spark, sf, "events").withColumn("said", F.expr(_SAID.replace("\\\\\\\\", "\\\\")))
    one = lambda p, title, text: F.struct(F.concat(F.lit(p), F.col("event_id").cast("string")).alias("chunk_id"), F.lit("d").alias("doc_id"), F.lit(title).alias("title"), text.alias("text"), F.lit(1).alias("rank"), F.lit(1.0).alias("score"))
    contexts = F.array(one("e", "First", F.concat(F.lit("we saw that "), "event_type", F.lit(" took place"))), one("f", "Second", F.lit("another 0123456789")))
    n = answers.normalise_payload(answers.read_payload(F.col("said")), contexts)
    rows = e.select("event_id", n.alias("n"), answers.read_payload(F.col("said"))["parse_status"].alias("parse_status"))
    return rows.select("event_id", "n.answer", "n.abstained", F.array_join("n.used_context_ids", "|").alias("used"), F.array_join("n.invalid_context_ids", "|").alias("invalid"), "n.schema_status", "parse_status")


_STAGE = f"""{C._SELECT}, st1 AS (SELECT query_id, rank, doc_id, body FROM cx WHERE rank <= 3 AND score >= 1e0),
se AS (SELECT query_id, rank, unnest({S.sentences('body')}) AS s, generate_subscripts({S.sentences('body')}, 1) AS pos FROM st1),
fs AS (SELECT query_id, s, rank, pos FROM se QUALIFY row_number() OVER (PARTITION BY query_id, s ORDER BY rank, pos) = 1),
fk AS (SELECT * FROM fs QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY rank, pos) <= 4),
an AS (SELECT q.query_id, coalesce(a.answer, '{context.NO_ANSWER}') AS answer, a.answer IS NULL AND b.used IS NULL AS abstained, coalesce(b.used, []) AS used FROM q LEFT JOIN (SELECT query_id, string_agg(s, ' ' ORDER BY rank, pos) AS answer FROM fk GROUP BY 1) a USING (query_id) LEFT JOIN (SELECT query_id, list(doc_id ORDER BY rank) AS used FROM st1 GROUP BY 1) b USING (query_id)),
tp AS (SELECT query_id, arg_min(score, rank) AS top, list(list_distinct({S.tokens("title || ' ' || body")})) AS held FROM cx GROUP BY 1),
sx AS (SELECT query_id, unnest(list_filter(list_transform(regexp_split_to_array(regexp_replace(answer, '\\[[0-9]+\\]', '', 'g'), '[.!?;\\n]'), lambda s: {S.space('s')}), lambda s: s <> '')) AS s FROM an),
co AS (SELECT query_id, avg(CASE WHEN len(list_filter(coalesce(held, []), lambda t: (CASE WHEN len({S.tokens('s')}) = 0 OR len(t) = 0 THEN 0e0 ELSE len(list_intersect(list_distinct({S.tokens('s')}), t))::DOUBLE / len(list_distinct({S.tokens('s')})) END) >= 4e-1)) > 0 THEN 1e0 ELSE 0e0 END) AS support FROM sx LEFT JOIN tp USING (query_id) GROUP BY 1),
gu AS (SELECT an.*, coalesce(top, 0e0) AS top, coalesce(support, 0e0) AS support FROM an LEFT JOIN tp USING (query_id) LEFT JOIN co USING (query_id)),
gr AS (SELECT *, list_filter([CASE WHEN top < 5e0 THEN 'top_score_below_threshold' END, CASE WHEN support < 5e-1 THEN 'nli_guardrail_failed' END], lambda x: x IS NOT NULL) AS r FROM gu)"""


def staged(spark, sf):
    generator = answers.build_generator("extractive", most_contexts=3, most_sentences=4, least_score=1.0)
    return answers.generation_stage(C.contexts(spark, sf), C.questions(spark, sf), generator, 5.0, 0.5, False, True)


@registered(f"WITH {_STAGE} SELECT query_id, array_to_string(r, '|') AS reasons, CASE WHEN len(r) > 0 THEN 'blocked' ELSE 'passed' END AS guardrail_status, md5(CASE WHEN len(r) > 0 THEN '{answers.BLOCKED}' ELSE answer END) AS digest, abstained OR len(r) > 0 AS abstained, CASE WHEN len(r) > 0 THEN '' ELSE array_to_string(used, '|') END AS used, round(support, 6) AS support, 1e0 AS used_valid FROM gr")
def generation_stage(spark, sf):
    g = staged(spark, sf)
    return g.select("query_id", F.array_join("guardrail_reasons", "|").alias("reasons"), "guardrail_status", F.md5("answer").alias("digest"), "abstained", F.array_join("used_context_ids", "|").alias("used"), F.round("guardrail_support", 6).alias("support"), F.col("alignment.used_context_id_valid_ratio").alias("used_valid"))


@registered(f"WITH {_STAGE} SELECT 'extractive' AS generation_method, count(*) AS n, count_if(abstained OR len(r) > 0)::BIGINT AS n_abstained, count(*) AS n_aligned, count_if(len(r) > 0)::BIGINT AS n_blocked FROM gr")
def generation_stage_counts(spark, sf):
    return answers.stage_counts(staged(spark, sf))


_SPANS = f"""{C._SELECT}, ci AS (SELECT query_id, rank, doc_id, trim(left(body, 120)) AS span, lead(body) OVER w AS other, body FROM cx WINDOW w AS (PARTITION BY query_id ORDER BY rank))"""


@registered(
    f"WITH {_SPANS}, x AS (SELECT query_id, doc_id, contains(body, span) AS own, other IS NOT NULL AND (contains(other, span) OR {S.overlap(S.tokens('span'), S.tokens('other'))} >= 6e-1) AS next_holds, other IS NOT NULL AS has_next FROM ci) "
    "SELECT query_id, doc_id, CASE WHEN has_next THEN 5e-1 ELSE 0e0 END AS used_valid, CASE WHEN has_next THEN 1e0 ELSE 0e0 END AS cited_valid, CASE WHEN has_next AND next_holds THEN 1e0 ELSE 0e0 END AS supported, has_next AND next_holds AND false AS all_valid, (CASE WHEN has_next AND next_holds THEN 0 ELSE 1 END)::INT AS unsupported FROM x"
)
def alignment_report(spark, sf):
    """Each context's span cited for the context after it: what alignment says of a wrong id and of a span from elsewhere."""
    from pyspark.sql import Window

    w = Window.partitionBy("query_id").orderBy("rank")
    c = C.contexts(spark, sf).withColumns({"next_id": F.lead("doc_id").over(w).cast("string"), "next_text": F.lead("text").over(w)})
    one = F.struct(F.col("next_id").alias("chunk_id"), F.col("next_id").alias("doc_id"), F.lit("").alias("title"), F.col("next_text").alias("text"), F.lit(1).alias("rank"), F.lit(1.0).alias("score"), F.lit(None).cast("string").alias("source_ref"))
    held = F.when(F.col("next_id").isNotNull(), F.array(one)).otherwise(F.array().cast(f"array<{answers.CONTEXT}>"))
    cited = F.array(F.struct(F.lit("1").alias("label"), F.coalesce("next_id", F.lit("none")).alias("chunk_id"), F.lit("").alias("doc_id"), F.lit("").alias("title"), F.btrim(F.left("text", F.lit(120))).alias("span_text"), F.lit(1).alias("rank")))
    used = F.array(F.coalesce("next_id", F.lit("none")), F.lit("no such id"))
    a = c.withColumn("a", answers.alignment(used, cited, held))
    return a.select("query_id", "doc_id", F.col("a.used_context_id_valid_ratio").alias("used_valid"), F.col("a.citation_id_valid_ratio").alias("cited_valid"), F.col("a.citation_support_ratio").alias("supported"), F.col("a.alignment_all_valid").alias("all_valid"), F.col("a.unsupported_citation_count").alias("unsupported"))


# Benchmark synthesis

_ASCII = lambda seed: f"list_sum(list_transform(string_split({seed}, ''), lambda c: ascii(c)))::BIGINT % 2"
_SENTENCES = f"{C._UNITS}, sn AS (SELECT doc_id, part, list_filter(list_transform(regexp_split_to_array(text, '[.!?;\\n]'), lambda s: {S.space('s')}), lambda s: s <> '') AS ss FROM u), s AS (SELECT doc_id, part, (generate_subscripts(ss, 1) - 1)::INT AS pos, unnest(ss) AS sentence FROM sn)"


@registered(
    f"WITH {_SENTENCES}, x AS (SELECT * FROM s WHERE length(sentence) >= 12 AND (contains(sentence, 'by ') OR contains(sentence, 'par ') OR contains(sentence, 'von ')) AND (contains(sentence, 'by ') OR contains(sentence, 'par '))) "
    f"SELECT doc_id, part, pos, ['Who is responsible under part ' || part || '?', 'Whom does part ' || part || ' name as responsible?'][1 + {_ASCII('''doc_id::VARCHAR || ':' || pos::VARCHAR || ':responsibility' ''')}] AS question, md5(sentence) AS digest FROM x"
)
def benchmark_actors(spark, sf):
    return benchmark.actor_candidates(C.units(spark, sf)).select("doc_id", "part", "pos", "question", F.md5("gold_answer").alias("digest"))


_TERM = lambda k: f"trim(regexp_replace(regexp_extract(text, 'both ([a-z]{{1,12}}) and ([a-z]{{1,12}})', {k}), '[（(][^）)]*[）)]', '', 'g'))"


@registered(
    f"WITH {C._UNITS}, p AS (SELECT doc_id, part, text, list_filter([CASE WHEN contains(text, 'the') AND contains(text, 'and') THEN ['the', 'and'] END, CASE WHEN contains(text, 'le') AND contains(text, 'et') THEN ['le', 'et'] END, CASE WHEN regexp_matches(text, 'both ([a-z]{{1,12}}) and ([a-z]{{1,12}})') THEN [{_TERM(1)}, {_TERM(2)}] END], lambda x: x IS NOT NULL) AS ps FROM u), "
    "e AS (SELECT doc_id, part, text, (generate_subscripts(ps, 1) - 1)::INT AS pos, unnest(ps) AS pair FROM p) "
    f"SELECT doc_id, part, pos, ['How do ' || pair[1] || ' and ' || pair[2] || ' differ?', 'What sets ' || pair[1] || ' apart from ' || pair[2] || '?'][1 + {_ASCII('''doc_id::VARCHAR || ':' || pos::VARCHAR || ':comparison' ''')}] AS question, md5(text) AS digest FROM e"
)
def benchmark_comparisons(spark, sf):
    return benchmark.comparison_candidates(C.units(spark, sf)).select("doc_id", "part", "pos", "question", F.md5("gold_answer").alias("digest"))


@registered()
def benchmark_records(spark, sf):
    records, _ = benchmark.benchmark_stage(chunking.saved_units(C.table(spark, sf, "documents")), 20)
    return records.select("query_id", "question_type", "question", "answerable", F.size("gold_evidence").alias("n_evidence"))


# Chunking


@registered()
def chunk_stage_counts(spark, sf):
    d = C.documents(spark, sf).select("doc_id", "text", "normalized_text")
    return chunking.chunk_stage(d, "both", sentences=1).groupBy("chunk_method").agg(F.count("*").alias("n"), F.sum(F.char_length("text")).alias("n_chars"))


# Evaluation


@registered(f"WITH {C._GEN}, t AS (SELECT al.query_id, list_distinct({S.tokens('answer')}) AS a, list_distinct({S.tokens('reference')}) AS r FROM al JOIN gg USING (query_id)), x AS (SELECT query_id, len(list_intersect(a, r)) AS n, len(a) AS na, len(r) AS nr FROM t) SELECT query_id, round(CASE WHEN na = 0 THEN 0e0 ELSE n::DOUBLE / na END, 6) AS token_precision, round(CASE WHEN nr = 0 THEN 0e0 ELSE n::DOUBLE / nr END, 6) AS token_recall FROM x")
def token_precision_recall(spark, sf):
    rows = C.answers(spark, sf).join(C.gold(spark, sf), "query_id")
    p, r = evaluation.token_precision_recall(F.col("answer"), F.col("reference"))
    return rows.select("query_id", F.round(p, 6).alias("token_precision"), F.round(r, 6).alias("token_recall"))
