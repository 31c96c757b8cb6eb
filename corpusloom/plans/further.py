"""Queries of the hybrid and vector drivers, corpus order, chunk merging, benchmark synthesis and auto evaluation, with their DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corpusloom.functions import text as T
from corpusloom.functions.presets import LATIN
from corpusloom.operators import audit, benchmark, chunking, context, experiments, retrieval
from corpusloom.plans import catalogue as C
from corpusloom.plans import sql as S
from corpusloom.sources import records
from corpusloom.sources.shared import numbered, shared_folder

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def registered(sql: str | None = None):
    def put(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return put


# Retrieval


def _fusing(spark, sf, fusion):
    asked = C.questions(spark, sf).select("query_id", "query_text")
    titles = lambda hits: audit.build_documents(retrieval.of_hits(C.table(spark, sf, "documents"), hits)).select("doc_id", "title")
    full = lambda hits: hits.join(titles(hits), "doc_id").join(asked, "query_id")
    return C.rounded(retrieval.fuse(full(C.bm25_hits(spark, sf)), full(C.tfidf_hits(spark, sf)), C.TOP, fusion))


@registered(f"WITH {C._BOTH}, {S.fused('fr', 'bm', 'te', C.TOP)} {C._HITS} fr")
def hybrid_rrf(spark, sf):
    return _fusing(spark, sf, "rrf")


@registered(f"WITH {C._BOTH}, {S.fused('fr', 'bm', 'te', C.TOP, False)} {C._HITS} fr")
def hybrid_score(spark, sf):
    return _fusing(spark, sf, "score")


@registered(
    f"WITH {S.bm25(C.TOP)}, po AS (SELECT doc_id, row_number() OVER (ORDER BY source, doc_id DESC) AS corpus_pos FROM documents), "
    f"r AS (SELECT query_id, doc_id, score, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, corpus_pos) AS rank FROM bs JOIN po USING (doc_id) QUALIFY rank <= {C.TOP}) {C._HITS} r"
)
def bm25_corpus_order(spark, sf):
    """BM25 with ties in the order of the corpus, which here is by source and falling id."""
    places = numbered(C.table(spark, sf, "documents").select("doc_id", "source", (-F.col("doc_id")).alias("falling")), "source", "falling")
    return C.rounded(retrieval.bm25(C.searched(spark, sf), C.questions(spark, sf).select("query_id", "query_text"), C.TOP, places=places))


_CORPUS = "CASE WHEN vec_id % 3 = 0 THEN 'structure' ELSE 'fixed' END"


@registered(
    f"WITH s AS (SELECT q.vec_id AS query_id, c.vec_id AS doc_id, {_CORPUS.replace('vec_id', 'c.vec_id')} AS corpus, list_inner_product(q.embedding::DOUBLE[], c.embedding::DOUBLE[]) AS score FROM embeddings q, embeddings c WHERE q.vec_id % 100 = 0), "
    "l AS (SELECT *, row_number() OVER (PARTITION BY query_id, corpus ORDER BY round(score, 9) DESC, doc_id) AS rank FROM s QUALIFY rank <= 20), "
    f"m AS (SELECT query_id, doc_id, 65e-2 * {S.minmax('score', 'PARTITION BY query_id, corpus')} + 3e-1 / (6e1 + rank) + CASE corpus WHEN 'structure' THEN 8e-2 ELSE 2e-2 END + 8e-2 AS score FROM l), r AS (SELECT *, {S.RANK} AS rank FROM m QUALIFY rank <= {C.TOP}) "
    "SELECT query_id, rank::INT AS rank, doc_id, round(score, 6) AS score, 'vector' AS retrieval_method FROM r"
)
def vector_pipeline(spark, sf):
    """The driver's mode vector: all vectors as an index of two corpora in folders of their own, each searched by tiles, then merged."""
    e = C.table(spark, sf, "embeddings")
    path = shared_folder(spark, "index")
    records.write_vectors(e.select(F.expr(_CORPUS).alias("corpus"), F.col("vec_id").alias("chunk_id"), "embedding"), path)
    vectors = {n: records.read_vectors(spark, path, n).select(F.col("chunk_id").alias("doc_id"), F.col("embedding").alias("v")) for n in ("structure", "fixed")}
    corpora = {n: v.select("doc_id", F.lit("").alias("title"), F.lit("").alias("text")) for n, v in vectors.items()}
    asked = e.where("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), "embedding")
    variants = retrieval.query_variants(asked.select("query_id", F.col("query_id").cast("string").alias("query_text")))
    encoded = asked.select("query_id", F.lit(0).alias("variant_no"), F.col("embedding").alias("q"))
    hits = retrieval.retrieve(corpora, variants, "vector", C.TOP, 20, vectors=vectors, encoded=encoded)
    return hits.select("query_id", "rank", "doc_id", F.round("score", 6).alias("score"), "retrieval_method")


_GRAMSET = lambda x: f"list_distinct({S.ngrams(x)})"
_RUNS = "list_transform(range(3, 25), lambda n: list_filter(list_transform(range(1, greatest(length(query_text) - n + 2, 1)), lambda i: substr(query_text, i, n)), lambda s: length(s) = n AND contains(body, s))[1])"


@registered(
    f"WITH {C._FULL} SELECT query_id, doc_id, round(CASE WHEN len({_GRAMSET('query_text')}) = 0 OR len({_GRAMSET('body')}) = 0 THEN 0e0 ELSE len(list_intersect({_GRAMSET('query_text')}, {_GRAMSET('body')}))::DOUBLE / len(list_distinct(list_concat({_GRAMSET('query_text')}, {_GRAMSET('body')}))) END, 6) AS gram_jaccard, "
    f"coalesce(list_filter({_RUNS}, lambda s: s IS NOT NULL)[-1], '') AS longest_overlap, md5(concat_ws(' ', nullif(trim(title), ''), nullif(trim(body), ''))) AS text_digest, "
    "'doc:' || doc_id AS hit_key, coalesce(regexp_extract(query_text, '^([A-Za-z]+) ', 1), '') AS subject, printf('%.4f', score) AS score_text FROM f"
)
def hit_features(spark, sf):
    """How like each hit is to its query, by grams and by their longest common run, and the hit's key, text and score as files have them."""
    h = C.full_hits(spark, sf)
    q, t = F.col("query_text"), F.col("text")
    return h.select(
        "query_id",
        "doc_id",
        F.round(T.jaccard(T.gram_set(q), T.gram_set(t)), 6).alias("gram_jaccard"),
        T.longest_overlap(q, t).alias("longest_overlap"),
        F.md5(T.retrieval_text(F.col("title"), t)).alias("text_digest"),
        T.hit_key(F.lit(""), F.col("doc_id").cast("string"), F.col("title"), t).alias("hit_key"),
        F.coalesce(T.question_subject(q, (r"^([A-Za-z]+) ",)), F.lit("")).alias("subject"),
        T.format_metric(F.col("score")).alias("score_text"),
    )


# Chunking


@registered(
    f"WITH {C._UNITS}, c AS (SELECT u.doc_id, part, u.text, lang, (row_number() OVER w - 1)::INT AS k, sum(length(u.text)) OVER w AS e FROM u JOIN documents d ON d.doc_id = u.doc_id WINDOW w AS (PARTITION BY u.doc_id ORDER BY part)), "
    "o AS (SELECT *, sum(CASE WHEN length(text) >= 200 OR k = 0 THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY k) AS island FROM c), "
    "m AS (SELECT doc_id, (island - 1)::INT AS chunk_index, count(*) AS n_merged, string_agg(text, '' ORDER BY k) AS t, (max(e) - sum(length(text)))::INT AS start_char, max(e)::INT AS end_char, list(part % 3 ORDER BY k) AS ps, any_value(lang) AS lang FROM o GROUP BY doc_id, island) "
    "SELECT doc_id, chunk_index, n_merged, md5(t) AS digest, start_char, end_char, array_to_string(list_transform(list_filter(ps, lambda x, i: list_position(ps, x) = i), lambda x: 'path ' || x), '|') AS path, "
    "array_to_string(list_sort(list_distinct(list_concat(list_transform(ps, lambda x: 'label ' || (x + 1)), list_filter([lang], lambda x: x <> '')))), '|') AS labels FROM m"
)
def chunk_merge_texts(spark, sf):
    """Units of a document as chunks, short ones merged into those before them, with their paths and labels."""
    w = Window.partitionBy("doc_id").orderBy("part")
    u = C.units(spark, sf).join(C.table(spark, sf, "documents").select("doc_id", "lang"), "doc_id")
    three = lambda head, k: F.concat(F.lit(head), (F.col("part") % 3 + k).cast("string"))
    end = F.sum(F.char_length("text")).over(w)
    chunks = u.select("doc_id", (F.row_number().over(w) - 1).alias("chunk_index"), "text", (end - F.char_length("text")).cast("int").alias("start_char"), end.cast("int").alias("end_char"), F.array(three("path ", 0), F.lit("")).alias("section_path"), F.array("lang", three("label ", 1)).alias("structure_labels"))
    m = chunking.merge_short_chunks(chunks, 200)
    return m.select("doc_id", "chunk_index", "n_merged", F.md5("text").alias("digest"), "start_char", "end_char", F.array_join("section_path", "|").alias("path"), F.array_join("structure_labels", "|").alias("labels"))


#: Headings of four levels in prose: a capitalised word with the mark that follows it.
PROSE = replace(LATIN, heading=r"([A-Z][a-z]+[.,;:])", levels=(".", ",", ";"))


@registered(
    f"WITH h0 AS (SELECT doc_id, list_concat([''], regexp_extract_all(text, '{PROSE.heading}')) AS hs, regexp_split_to_array(text, '{PROSE.heading}') AS gs FROM documents WHERE text IS NOT NULL), "
    "h1 AS (SELECT doc_id, generate_subscripts(hs, 1) - 1 AS section, unnest(hs) AS label, unnest(gs) AS rest FROM h0), "
    "h2 AS (SELECT doc_id, section, label, label || rest AS text, CASE WHEN section = 0 THEN 0 WHEN contains(label, '.') THEN 1 WHEN contains(label, ',') THEN 2 WHEN contains(label, ';') THEN 3 ELSE 4 END AS level FROM h1), "
    f"h3 AS (SELECT *, sum(length(text)) OVER w AS e, {', '.join(f'last_value(CASE WHEN level BETWEEN 1 AND {n} THEN level END IGNORE NULLS) OVER w AS v{n}, last_value(CASE WHEN level BETWEEN 1 AND {n} THEN label END IGNORE NULLS) OVER w AS x{n}' for n in range(1, 5))} FROM h2 WINDOW w AS (PARTITION BY doc_id ORDER BY section)) "
    f"SELECT doc_id, section::INT AS section, label, level, (e - length(text))::INT AS start_char, e::INT AS end_char, concat_ws('|', {', '.join(f'CASE WHEN v{n} = {n} THEN x{n} END' for n in range(1, 5))}) AS path, md5(text) AS digest FROM h3 WHERE {S.space('text')} <> ''"
)
def section_paths(spark, sf):
    """The sections between headings of all texts, with the labels that enclose each."""
    s = chunking.sections(C.table(spark, sf, "documents"), PROSE)
    return s.select("doc_id", "section", "label", "level", "start_char", "end_char", F.array_join("path", "|").alias("path"), F.md5("text").alias("digest"))


@registered(
    f"WITH a0 AS (SELECT doc_id, {S.space('text')} AS t FROM documents), a1 AS (SELECT doc_id, t, regexp_extract_all(t, '{PROSE.heading}') AS h, regexp_split_to_array(t, '{PROSE.heading}') AS g FROM a0 WHERE length(t) >= 40), "
    f"a2 AS (SELECT doc_id, CASE WHEN len(h) = 0 THEN [t] ELSE list_transform(h, lambda x, i: x || g[i + 1]) END AS ps FROM a1), a3 AS (SELECT doc_id, (generate_subscripts(ps, 1) - 1)::INT AS part, unnest(ps) AS raw FROM a2), a4 AS (SELECT doc_id, part, {S.space('raw')} AS text FROM a3) "
    f"SELECT doc_id, part, nullif(regexp_extract(text, '^{PROSE.heading}', 1), '') AS label, md5(text) AS digest FROM a4 WHERE length(text) >= 40 QUALIFY row_number() OVER (PARTITION BY doc_id, left(text, 120) ORDER BY part) = 1"
)
def article_sections(spark, sf):
    """All texts parted at headings as articles are, with their labels; a text without one is whole."""
    a = chunking.articles(C.table(spark, sf, "documents"), PROSE.heading)
    return a.select("doc_id", "part", "label", F.md5("text").alias("digest"))


# Benchmark synthesis

_SEED = "doc_id || ':' || part || ':' || next_part || ':neighbours'"


@registered(
    f"WITH {C._UNITS}, n AS (SELECT doc_id, part, text, lead(part) OVER w AS next_part, lead(text) OVER w AS next_text FROM u WINDOW w AS (PARTITION BY doc_id ORDER BY part)), "
    "x AS (SELECT *, 'part ' || part AS a, 'part ' || next_part AS b FROM n WHERE next_part IS NOT NULL) "
    f"SELECT doc_id, part, next_part, ['How do ' || a || ' and ' || b || ' differ?', 'What do ' || a || ' and ' || b || ' each say?'][1 + list_sum(list_transform(string_split({_SEED}, ''), lambda c: ascii(c)))::BIGINT % 2] AS question, a || '|' || b AS pair, md5({S.space("text || ' ' || next_text")}) AS digest FROM x"
)
def benchmark_neighbours(spark, sf):
    """Comparisons of neighbouring units, with the pair and the evidence of both."""
    c = benchmark.adjacent_comparisons(C.units(spark, sf))
    return c.select("doc_id", "part", "next_part", "question", F.array_join("pair", "|").alias("pair"), F.md5("gold_answer").alias("digest"))


_NUMBER = lambda x: f"('0x' || substr(md5({x}), 1, 15))::BIGINT"
_UNIT = "u.doc_id || ':' || u.part"


@registered(
    f"WITH {C._CANDIDATES}, t0 AS (SELECT DISTINCT doc_id, trim(regexp_replace(regexp_extract(gold_answer, '([a-z]{{2,24}}) is ', 1), '[（(][^）)]*[）)]', '', 'g')) AS term FROM cd WHERE question_type = 'definition'), "
    f"t1 AS (SELECT term, list(doc_id) AS docs, {_NUMBER('term')} AS h FROM t0 WHERE length(term) >= 2 GROUP BY term), t2 AS (SELECT term, docs, row_number() OVER (ORDER BY h % 256, h, term) - 1 AS place, count(*) OVER () AS total FROM t1), "
    f"p AS (SELECT u.doc_id, u.part, term, (place - {_NUMBER(_UNIT)} % total + total) % total AS turn FROM u JOIN t2 ON NOT list_contains(docs, u.doc_id) AND NOT contains(u.text, term)), "
    "f AS (SELECT * FROM p QUALIFY row_number() OVER (PARTITION BY doc_id, part ORDER BY turn) = 1) SELECT doc_id, part, term FROM f QUALIFY row_number() OVER (PARTITION BY doc_id, term ORDER BY part) = 1"
)
def benchmark_unanswerable(spark, sf):
    """For each unit the first defined term that it does not hold."""
    units = chunking.saved_units(C.table(spark, sf, "documents"))
    return experiments.unanswerable_pairs(units, benchmark.definition_terms(units))


# Evaluation


def _auto_sql(name: str, hits: str) -> str:
    """Mean metrics of one variant: extractive answers from its first hits, scored against the least document that holds the passage."""
    words = lambda x: f"list_distinct({S.tokens(x)})"
    share = lambda of, by: f"(CASE WHEN len({of}) = 0 THEN 0e0 ELSE len(list_intersect({of}, {by}))::DOUBLE / len({of}) END)"
    metrics = {
        "faithfulness": share(words("answer"), words("evidence")),
        "answer_relevancy": share(words("question"), words("answer")),
        "answer_relevance": share(words("question"), words("answer")),
        "context_precision": "coalesce(1e0 / place, 0e0)",
        "citation_support_rate": "(CASE WHEN len(used) = 0 THEN 0e0 ELSE len(list_filter(used, lambda u: u = gold))::DOUBLE / len(used) END)",
        "answer_correctness": share(words("truth"), words("answer")),
        "recall_3": "(CASE WHEN place <= 3 THEN 1e0 ELSE 0e0 END)",
        "recall_5": "(CASE WHEN place <= 5 THEN 1e0 ELSE 0e0 END)",
    }
    return f"""{name}0 AS (SELECT h.*, d.body FROM {hits} h JOIN d USING (doc_id)),
{name}1 AS (SELECT query_id, s, rank, pos FROM (SELECT query_id, rank, unnest({S.sentences('body')}) AS s, generate_subscripts({S.sentences('body')}, 1) AS pos FROM {name}0 WHERE rank <= 3 AND score >= 1e-1) QUALIFY row_number() OVER (PARTITION BY query_id, s ORDER BY rank, pos) = 1),
{name}2 AS (SELECT query_id, string_agg(s, ' ' ORDER BY rank, pos) AS answer FROM (SELECT * FROM {name}1 QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY rank, pos) <= 4) GROUP BY 1),
{name}3 AS (SELECT query_id, list(doc_id ORDER BY rank) AS used FROM {name}0 WHERE rank <= 3 AND score >= 1e-1 GROUP BY 1),
{name}5 AS (SELECT ts.query_id, min(rank) AS place FROM ts JOIN {name}0 h ON h.query_id = ts.query_id AND h.doc_id = gold GROUP BY 1),
{name}4 AS (SELECT ts.*, coalesce(answer, '{context.NO_ANSWER}') AS answer, coalesce(used, []) AS used, place FROM ts LEFT JOIN {name}2 USING (query_id) LEFT JOIN {name}3 USING (query_id) LEFT JOIN {name}5 USING (query_id)),
{name} AS (SELECT '{name}' AS variant, count(*) AS n, {', '.join(f'round(avg({v}), 6) AS {k}' for k, v in metrics.items())} FROM {name}4)"""


@registered(f"WITH {C._BOTH}, {S.QRELS}, gd AS (SELECT query_id, min(doc_id) AS gold FROM rel GROUP BY 1), ts AS (SELECT query_id, query_text AS question, raw AS truth, gold, body AS evidence FROM gd JOIN q USING (query_id) JOIN d ON d.doc_id = gold), {_auto_sql('lexical', 'bm')}, {_auto_sql('grams', 'te')} SELECT * FROM lexical UNION ALL SELECT * FROM grams")
def auto_eval_variants(spark, sf):
    """Two ways of retrieval, each with extractive answers, scored on the passages that some document holds."""
    gold = C.relevant(spark, sf).groupBy("query_id").agg(F.min("doc_id").alias("doc_id"))
    evidence = retrieval.of_hits(C.table(spark, sf, "documents"), gold).select("doc_id", T.normalize_text(F.col("text")).alias("evidence"))
    testset = C.questions(spark, sf).join(gold, "query_id").join(evidence, "doc_id").select("query_id", F.col("query_text").alias("question"), F.col("raw").alias("truth"), "doc_id", "evidence")

    def variant(find):
        def run(asked):
            found = find(spark, sf)
            texts = retrieval.of_hits(C.table(spark, sf, "documents"), found).select("doc_id", T.normalize_text(F.col("text")).alias("text"))
            hits = found.join(texts, "doc_id")
            return context.extractive_answers(hits, asked.select("query_id"), 3, 4, 0.1), hits

        return run

    table = experiments.auto_eval_variants({"lexical": variant(C.bm25_hits), "grams": variant(C.tfidf_hits)}, testset)
    return table.select("variant", "n", *[F.round(c, 6).alias(c) for c in table.columns if c not in ("variant", "n")])
