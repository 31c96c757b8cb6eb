"""The registered queries and, where SQL can express them, their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corpusloom.functions import text as T
from corpusloom.operators import audit, benchmark, chunking, cleaning, context, evaluation, retrieval
from corpusloom.plans import sql as S
from corpusloom.sources.shared import saved

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
TOP = 10
#: Passages, so many at most, are sent to the documents.
BROADCAST_QUESTIONS = 100_000


def registered(sql: str | None = None):
    def put(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return put


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def documents(spark: SparkSession, sf: str) -> DataFrame:
    return audit.build_documents(table(spark, sf, "documents"))


def bodies(spark: SparkSession, sf: str) -> DataFrame:
    """(doc_id, text): the normalised texts, as retrieval reads them."""
    return table(spark, sf, "documents").select("doc_id", T.normalize_text(F.col("text")).alias("text"))


def searched(spark: SparkSession, sf: str) -> DataFrame:
    """(doc_id, text): what searches find in `bodies`, as their words and grams leave white space out; it is not made even, which costs more than the search."""
    return table(spark, sf, "documents").select("doc_id", T.without_tags(F.col("text")).alias("text"))


def questions(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "benchmark").select(F.col("item_id").alias("query_id"), T.normalize_text(F.col("text")).alias("query_text"), F.col("text").alias("raw"))


def relevant(spark: SparkSession, sf: str) -> DataFrame:
    """(query_id, doc_id) of the documents that hold a benchmark passage verbatim.

    A document that does holds the passage's inner words whole: the longest of them is what the two are joined on, and only
    such pairs are compared. Passages of fewer than three words have none; they meet every document.
    """
    gap = r"[ \n\t]+"
    q, d = questions(spark, sf).select("query_id", "raw"), table(spark, sf, "documents").select("doc_id", "text")
    parts = F.split("raw", gap)
    inner = F.transform(F.slice(parts, 2, F.greatest(F.size(parts) - 2, F.lit(0))), lambda w: F.struct(F.char_length(w).alias("n"), w.alias("w")))
    q = q.withColumn("word", F.array_max(inner)["w"])
    n, n_short = q.agg(F.count("*"), F.count_if(F.col("word").isNull())).first()
    words = F.explode(F.array_distinct(F.split(F.coalesce("text", F.lit("")), gap))).alias("word")
    if n <= BROADCAST_QUESTIONS:
        # Texts stay where they are, and only asked words leave them.
        asked = [r[0] for r in q.where("word is not null").select("word").distinct().collect()]
        met = retrieval.holding(d, asked).join(F.broadcast(q.where("word is not null")), "word")
    else:
        pairs = d.select("doc_id", words).join(q.where("word is not null"), "word").select("query_id", "doc_id", "raw")
        met = d.join(pairs, "doc_id")
    met = met.where(F.contains("text", "raw")).select("query_id", "doc_id")
    if n_short:
        met = met.unionByName(d.join(q.where("word is null"), F.contains("text", "raw")).select("query_id", "doc_id"))
    return saved(met, "relevant")


def bm25_hits(spark: SparkSession, sf: str, k: int = TOP) -> DataFrame:
    return retrieval.bm25(searched(spark, sf), questions(spark, sf).select("query_id", "query_text"), k)


def rounded(hits: DataFrame) -> DataFrame:
    return hits.select("query_id", "rank", "doc_id", F.round("score", 6).alias("score"))


def full_hits(spark: SparkSession, sf: str, hits: DataFrame | None = None) -> DataFrame:
    """BM25 hits (those given, or else found) with the query, title, source and normalised text of their documents, worked out once."""
    hits = bm25_hits(spark, sf) if hits is None else hits
    d = audit.build_documents(retrieval.of_hits(table(spark, sf, "documents"), hits)).select("doc_id", "title", "source", F.col("normalized_text").alias("text"))
    return saved(hits.join(d, "doc_id").join(questions(spark, sf).select("query_id", "query_text"), "query_id"), "full")


# Normalisation and profiles


@registered(f"WITH {S.DOCS} SELECT doc_id, length(body) AS n, md5(body) AS digest FROM d")
def norm_documents(spark, sf):
    d = documents(spark, sf)
    return d.select("doc_id", F.col("text_length").cast("long").alias("n"), F.md5("normalized_text").alias("digest"))


@registered(f"SELECT page_id, length(t) AS n, md5(t) AS digest FROM (SELECT page_id, {S.norm('html')} AS t FROM pages)")
def norm_pages_html(spark, sf):
    p = table(spark, sf, "pages").select("page_id", T.normalize_text(F.col("html")).alias("t"))
    return p.select("page_id", F.char_length("t").cast("long").alias("n"), F.md5("t").alias("digest"))


@registered("SELECT event_id, year(ts)::INT AS year, year(ts)::INT AS year_of_date FROM events")
def year_extract_events(spark, sf):
    e = table(spark, sf, "events")
    return e.select("event_id", T.extract_year(F.unix_millis(F.col("ts").cast("timestamp")).cast("string")).cast("int").alias("year"), T.extract_year(F.date_format("ts", "yyyy-MM-dd")).alias("year_of_date"))


@registered(f"WITH {S.DOCS} SELECT doc_id, len(t) AS n_tokens, len(list_distinct(t)) AS n_distinct FROM (SELECT doc_id, {S.tokens('body')} AS t FROM d)")
def token_stats(spark, sf):
    d = bodies(spark, sf).withColumn("t", T.tokens(F.col("text")))
    return d.select("doc_id", F.size("t").cast("long").alias("n_tokens"), F.size(F.array_distinct("t")).cast("long").alias("n_distinct"))


@registered(f"WITH {S.DOCS} SELECT g AS gram, count(*) AS df FROM (SELECT unnest(list_distinct({S.ngrams('body')})) AS g FROM d) GROUP BY g")
def char_ngram_df(spark, sf):
    return bodies(spark, sf).select(F.explode(T.gram_set(F.col("text"))).alias("gram")).groupBy("gram").agg(F.count("*").alias("df"))


@registered(f"WITH {S.DOCS} SELECT doc_id, len({S.sentences('body')}) AS n_sentences FROM d")
def sentence_counts(spark, sf):
    return bodies(spark, sf).select("doc_id", F.size(T.split_sentences(F.col("text"))).cast("long").alias("n_sentences"))


@registered(
    "SELECT field, missing, missing::DOUBLE / greatest(n, 1) AS rate FROM (SELECT count(*) AS n, unnest(['text', 'lang', 'source']) AS field, "
    "unnest([count_if(trim(coalesce(text, '')) = ''), count_if(trim(coalesce(lang, '')) = ''), count_if(trim(coalesce(source, '')) = '')]::BIGINT[]) AS missing FROM documents)"
)
def missing_field_profile(spark, sf):
    return audit.missing_fields(table(spark, sf, "documents"), ["text", "lang", "source"])


@registered(f"WITH {S.DOCS} SELECT count(*) AS n_docs, min(length(body)) AS min_length, max(length(body)) AS max_length, sum(length(body))::BIGINT AS sum_length, round(avg(length(body)), 6) AS mean_length FROM d")
def length_profile(spark, sf):
    return audit.length_profile(documents(spark, sf)).withColumn("mean_length", F.round("mean_length", 6))


_BUCKET = "CASE " + " ".join(f"WHEN n <= {m} THEN '{b}'" for m, b in audit.BUCKETS) + f" ELSE '{audit.LAST_BUCKET}' END"


@registered(f"WITH {S.DOCS}, b AS (SELECT {_BUCKET} AS bucket FROM (SELECT length(body) AS n FROM d)) SELECT x.bucket, count(b.bucket) AS n FROM (SELECT unnest([{', '.join(repr(b) for _, b in audit.BUCKETS)}, '{audit.LAST_BUCKET}']) AS bucket) x LEFT JOIN b USING (bucket) GROUP BY x.bucket")
def length_histogram(spark, sf):
    return audit.length_histogram(documents(spark, sf))


@registered("SELECT coalesce(source, 'UNKNOWN') AS key, count(*) AS n FROM documents GROUP BY 1 ORDER BY n DESC, key LIMIT 20")
def source_distribution(spark, sf):
    return audit.distribution(table(spark, sf, "documents"), F.col("source"), 20)


@registered("SELECT coalesce(year(ts)::VARCHAR, 'UNKNOWN') AS key, count(*) AS n FROM events GROUP BY 1")
def year_distribution(spark, sf):
    return audit.distribution(table(spark, sf, "events"), F.year("ts"))


def _duplicates(field: str, kind: str) -> str:
    return f"WITH {S.DOCS} SELECT '{kind}' AS kind, sha1(trim({field})) AS fingerprint, count(*) AS n, array_to_string(list(doc_id ORDER BY doc_id), '|') AS doc_ids FROM d WHERE trim({field}) <> '' GROUP BY 2 HAVING count(*) > 1"


@registered(_duplicates("body", "exact_body"))
def exact_body_duplicates(spark, sf):
    return audit.exact_duplicates(documents(spark, sf), F.col("normalized_text"), "exact_body")


@registered(_duplicates("title", "exact_title"))
def exact_title_duplicates(spark, sf):
    return audit.exact_duplicates(documents(spark, sf), F.col("title"), "exact_title")


def _simhash_sql() -> str:
    stride = "greatest(greatest(length(t) - 2, 0) // 128, 1)"
    grams = f"CASE WHEN length(t) = 0 THEN [NULL] WHEN length(t) < 3 THEN [t] ELSE list_transform(list_slice(list_filter(range(0, length(t) - 2), lambda i: i % {stride} = 0), 1, 128), lambda i: substr(t, i + 1, 3)) END"
    half = lambda at: f"coalesce(('0x' || substr(h, {at}, 8))::BIGINT, 0)"
    word = lambda c: " + ".join(f"(CASE WHEN sum(({c} >> {b}) & 1) * 2 > count(h) THEN {1 << b} ELSE 0 END)" for b in range(32))
    return f"""{S.DOCS}, g AS (SELECT doc_id, md5(unnest({grams})) AS h FROM (SELECT doc_id, left(body, 2000) AS t FROM d)),
x AS (SELECT doc_id, h, {half(1)} AS hi, {half(9)} AS lo FROM g),
fp AS (SELECT doc_id, ({word('hi')})::BIGINT AS fp_hi, ({word('lo')})::BIGINT AS fp_lo FROM x GROUP BY doc_id)"""


@registered(f"WITH {_simhash_sql()} SELECT * FROM fp")
def simhash_fingerprints(spark, sf):
    return audit.simhash_halves(table(spark, sf, "documents"))


_APART = "bit_count(xor(x.fp_hi, y.fp_hi)) + bit_count(xor(x.fp_lo, y.fp_lo))"


@registered(
    f"WITH {_simhash_sql()}, l AS (SELECT fp_hi, fp_lo, min(doc_id) AS doc_id FROM fp GROUP BY ALL) "
    f"SELECT x.doc_id AS a, y.doc_id AS b, ({_APART})::BIGINT AS distance FROM l x JOIN l y ON x.fp_hi >> 16 = y.fp_hi >> 16 AND x.doc_id < y.doc_id WHERE {_APART} <= 3 "
    "UNION ALL SELECT l.doc_id, fp.doc_id, 0 FROM fp JOIN l USING (fp_hi, fp_lo) WHERE fp.doc_id <> l.doc_id"
)
def near_duplicate_pairs(spark, sf):
    fps = audit.simhash_halves(table(spark, sf, "documents"))
    return audit.near_duplicate_pairs(fps)


_MARKS = " OR ".join(f"contains(body, '{m}')" for m in audit.T.MOJIBAKE_MARKERS)
_LINES = f"list_filter(list_transform(string_split(coalesce(text, ''), chr(10)), lambda x: {S.space('x')}), lambda x: x <> '')"
_ANOMALY = f"""{S.DOCS}, l AS (SELECT doc_id, unnest({_LINES}) AS line FROM d), c AS (SELECT doc_id, line, count(*) AS n FROM l GROUP BY ALL),
r AS (SELECT doc_id, CASE WHEN sum(n) < 2 THEN 0e0 ELSE sum(CASE WHEN n > 1 THEN n ELSE 0 END)::DOUBLE / sum(n) END AS repeated FROM c GROUP BY doc_id),
i AS (SELECT doc_id, CASE WHEN body = '' THEN 1e0 ELSE 1 - len(list_distinct(string_split(body, '')))::DOUBLE / length(body) END AS low FROM d),
a AS (SELECT doc_id, 'empty_body' AS anomaly, 'high' AS severity FROM d WHERE body = ''
 UNION ALL SELECT doc_id, 'very_short_body', 'medium' FROM d WHERE length(body) BETWEEN 1 AND 29
 UNION ALL SELECT doc_id, 'garbled_text', 'high' FROM d WHERE {_MARKS}
 UNION ALL SELECT doc_id, 'template_repetition', 'medium' FROM d JOIN r USING (doc_id) WHERE body <> '' AND repeated >= 5e-1
 UNION ALL SELECT doc_id, 'low_information_density', 'low' FROM d JOIN i USING (doc_id) WHERE low > 85e-2 AND length(body) >= 30)"""


@registered(f"WITH {_ANOMALY} SELECT * FROM a")
def anomalies(spark, sf):
    return audit.anomalies(documents(spark, sf))


@registered(f"WITH {_ANOMALY} SELECT anomaly, count(*) AS n FROM a GROUP BY 1")
def anomaly_counts(spark, sf):
    return audit.anomalies(documents(spark, sf)).groupBy("anomaly").agg(F.count("*").alias("n"))


@registered(f"WITH {_ANOMALY} SELECT doc_id, round(coalesce(repeated, 0), 6) AS repeated, round(low, 6) AS low FROM i LEFT JOIN r USING (doc_id)")
def repeated_lines_low_information(spark, sf):
    d = documents(spark, sf)
    return d.select("doc_id", F.round(T.repeated_line_ratio(F.col("text")), 6).alias("repeated"), F.round(T.low_information_ratio(F.col("normalized_text")), 6).alias("low"))


@registered(f"WITH {S.DOCS}, h AS (SELECT doc_id, unnest(list_distinct(regexp_extract_all(body, '([A-Z][a-z]+\\.)'))) AS x FROM d), k AS (SELECT doc_id, x FROM h QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY x) <= 20) SELECT doc_id, string_agg(x, '|' ORDER BY x) AS hints FROM k GROUP BY doc_id")
def structure_hints(spark, sf):
    d = documents(spark, sf).where(F.size("structure_hints") > 0)
    return d.select("doc_id", F.array_join("structure_hints", "|").alias("hints"))


# Cleaning

ALIASES = {"src0": "main", "src1": "main"}
LEADING, GLOBAL = "[a-z]+ (the|of) ", "all rights reserved\\.?"


def cleaned(spark, sf):
    return cleaning.apply_cleaning(documents(spark, sf), title=["^the "], leading=[LEADING], everywhere=[GLOBAL], aliases=ALIASES)


_CLEAN = f"""{S.DOCS}, b AS (SELECT *, regexp_matches(title, '(?i)^the ') AS t1, regexp_matches(body, '(?i){LEADING}') AS b1 FROM d),
b2 AS (SELECT *, CASE WHEN b1 THEN {S.norm(f"regexp_replace(body, '(?i){LEADING}', '')")} ELSE body END AS x, CASE WHEN t1 THEN {S.norm("regexp_replace(title, '(?i)^the ', '')")} ELSE title END AS ct FROM b),
b3 AS (SELECT *, regexp_matches(x, '(?i){GLOBAL}') AS g1 FROM b2),
c AS (SELECT doc_id, CASE WHEN g1 THEN {S.norm(f"regexp_replace(x, '(?i){GLOBAL}', ' ', 'g')")} ELSE x END AS cleaned, coalesce(nullif(ct, ''), title) AS cleaned_title, CASE WHEN source IN ('src0', 'src1') THEN 'main' ELSE source END AS canonical_source,
 list_filter([CASE WHEN b1 THEN 'body_leading_pattern:{LEADING}' END, CASE WHEN g1 THEN 'body_global_pattern:{GLOBAL}' END, CASE WHEN source IN ('src0', 'src1') THEN 'source_alias_applied' END, CASE WHEN t1 THEN 'title_pattern:^the ' END], lambda z: z IS NOT NULL) AS actions FROM b3)"""


@registered(f"WITH {_CLEAN} SELECT doc_id, md5(cleaned) AS digest, cleaned_title, canonical_source, array_to_string(list_sort(actions), '|') AS actions FROM c")
def clean_documents(spark, sf):
    return cleaned(spark, sf).select("doc_id", F.md5("cleaned_text").alias("digest"), "cleaned_title", "canonical_source", F.array_join("cleaning_actions", "|").alias("actions"))


@registered(f"WITH {_CLEAN} SELECT key, count(*) AS n FROM (SELECT unnest(actions) AS key FROM c) GROUP BY key")
def cleaning_action_counts(spark, sf):
    return cleaning.counts_of(cleaned(spark, sf), "cleaning_actions")


@registered("SELECT source, CASE WHEN source IN ('src0', 'src1') THEN 'main' ELSE source END AS canonical, count(*) AS n FROM documents GROUP BY ALL")
def source_alias(spark, sf):
    return table(spark, sf, "documents").groupBy("source", cleaning.canonical_source(F.col("source"), ALIASES).alias("canonical")).agg(F.count("*").alias("n"))


@registered("SELECT doc_id, lang, source FROM documents ORDER BY md5(doc_id::VARCHAR), doc_id LIMIT 50")
def review_samples(spark, sf):
    return cleaning.review_sample(table(spark, sf, "documents").select("doc_id", "lang", "source"), 50)


# Chunking

_WINDOWS = f"""{S.DOCS}, w AS (SELECT doc_id, unnest(range(0, greatest(0, length(body) - 101) + 1, 400)) AS start_char, body FROM d WHERE body <> ''),
k AS (SELECT doc_id, start_char::INT AS start_char, trim(substr(body, start_char + 1, 500)) AS text, (row_number() OVER (PARTITION BY doc_id ORDER BY start_char) - 1)::INT AS chunk_index FROM w)"""


@registered(f"WITH {_WINDOWS} SELECT doc_id, chunk_index, start_char, (start_char + length(text))::INT AS end_char, md5(text) AS digest FROM k")
def chunk_fixed_windows(spark, sf):
    c = chunking.fixed_windows(documents(spark, sf))
    return c.select("doc_id", "chunk_index", "start_char", "end_char", F.md5("text").alias("digest"))


@registered(
    f"WITH {_WINDOWS}, o AS (SELECT *, sum(CASE WHEN length(text) >= 200 OR chunk_index = 0 THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY chunk_index) AS island FROM k) "
    "SELECT doc_id, (island - 1)::INT AS chunk_index, count(*) AS n_merged, min(start_char)::INT AS start_char, max(start_char + length(text))::INT AS end_char FROM o GROUP BY doc_id, island"
)
def short_chunk_merge(spark, sf):
    return chunking.merge_short(chunking.fixed_windows(documents(spark, sf)), 200)


#: Greedy packing as a recursion over each document's sentences: pieces cover the text, so that their lengths tell where they are.
_PACK = f"""WITH RECURSIVE {S.DOCS}, pc AS (SELECT doc_id, regexp_extract_all(body, '[^.!?;\n]+[.!?;\n]?|[.!?;\n]') AS p FROM d),
po AS (SELECT doc_id, k, s, sum(length(s)) OVER (PARTITION BY doc_id ORDER BY k) AS b FROM (SELECT doc_id, generate_subscripts(p, 1) AS k, unnest(p) AS s FROM pc)),
sp AS (SELECT doc_id, list({{'a': b - length(s), 'b': b}} ORDER BY k) AS sp FROM po WHERE trim(s) <> '' AND NOT regexp_matches(s, '^[.!?;\n]') GROUP BY doc_id),
st(doc_id, n, i, a, b, cut) AS (
 SELECT doc_id, 0, 1, NULL::BIGINT, NULL::BIGINT, false FROM sp
 UNION ALL SELECT doc_id, n + 1, CASE WHEN long THEN i + 1 WHEN last >= len(sp) THEN NULL ELSE greatest(i + 1, coalesce(i - 1 + list_position(list_transform(sp[i:last], lambda x: x.a >= e - 100), true), last + 1)) END, start, e, long
 FROM (SELECT *, CASE WHEN long THEN sp[i].b ELSE sp[last].b END AS e FROM (SELECT *, i - 1 + len(list_filter(sp[i:], lambda x: x.b - start <= 500)) AS last FROM
  (SELECT st.doc_id, n, i, sp, sp[i].a AS start, sp[i].b - sp[i].a > 500 AS long FROM st JOIN sp USING (doc_id) WHERE i <= len(sp))))),
ch AS (SELECT doc_id, n, a AS s, b AS e FROM st WHERE a IS NOT NULL AND NOT cut
 UNION ALL SELECT doc_id, n, s, least(s + 500, b) FROM (SELECT doc_id, n, unnest(range(a, greatest(b - 100, a + 1), 400)) AS s, b FROM st WHERE cut)
 UNION ALL SELECT doc_id, 1, s, least(s + 500, length(body)) FROM (SELECT doc_id, body, unnest(range(0, greatest(length(body) - 100, 1), 400)) AS s FROM d WHERE trim(body) <> '' AND doc_id NOT IN (SELECT doc_id FROM sp)))
SELECT doc_id, (row_number() OVER (PARTITION BY doc_id ORDER BY n, s) - 1)::INT AS chunk_index, s::INT AS start_char, e::INT AS end_char, md5(trim(substr(body, s + 1, e - s))) AS digest FROM ch JOIN d USING (doc_id)"""


@registered(_PACK)
def chunk_sentence_pack(spark, sf):
    c = chunking.sentence_chunks(documents(spark, sf))
    return c.select("doc_id", "chunk_index", "start_char", "end_char", F.md5("text").alias("digest"))


@registered()
def chunk_structure(spark, sf):
    return chunking.structure_chunks(table(spark, sf, "documents"))


_UNITS = f"""u0 AS (SELECT doc_id, (generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) - 1)::INT AS part, unnest(string_split(coalesce(text, ''), chr(10))) AS line FROM documents),
u1 AS (SELECT doc_id, part, {S.space('line')} AS text FROM u0),
u AS (SELECT * FROM u1 WHERE length(text) BETWEEN 40 AND 2000 QUALIFY row_number() OVER (PARTITION BY doc_id, left(text, 120) ORDER BY part) = 1)"""


def units(spark, sf):
    return chunking.article_units(table(spark, sf, "documents"))


@registered(f"WITH {_UNITS} SELECT doc_id, part, md5(text) AS digest FROM u")
def article_units(spark, sf):
    return units(spark, sf).select("doc_id", "part", F.md5("text").alias("digest"))


# Retrieval

_HITS = "SELECT query_id, rank::INT AS rank, doc_id, round(score, 6) AS score FROM"


@registered(f"WITH {S.bm25(TOP)} {_HITS} bm")
def bm25_topk(spark, sf):
    return rounded(bm25_hits(spark, sf))


@registered(f"WITH {S.bm25(TOP, True)} {_HITS} bm")
def bm25_okapi_topk(spark, sf):
    return rounded(retrieval.bm25(searched(spark, sf), questions(spark, sf).select("query_id", "query_text"), TOP, okapi=True))


def tfidf_hits(spark, sf):
    return retrieval.tfidf_cosine(searched(spark, sf), questions(spark, sf).select("query_id", "query_text"), TOP)


@registered(f"WITH {S.DOCS}, {S.QUERIES}, {S.tfidf(TOP)} {_HITS} te")
def dense_tfidf_topk(spark, sf):
    return rounded(tfidf_hits(spark, sf))


@registered(
    f"WITH s AS (SELECT q.vec_id AS query_id, c.vec_id AS doc_id, list_inner_product(q.embedding::DOUBLE[], c.embedding::DOUBLE[]) AS score FROM embeddings q, embeddings c WHERE q.vec_id % 100 = 0), "
    f"r AS (SELECT *, {S.RANK} AS rank FROM s QUALIFY rank <= {TOP}) {_HITS} r"
)
def vector_topk(spark, sf):
    e = table(spark, sf, "embeddings")
    q = e.where("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("q"))
    return rounded(retrieval.inner_product_topk(e.select(F.col("vec_id").alias("doc_id"), F.col("embedding").alias("v")), q, TOP))


_BOTH = f"{S.bm25(TOP)}, {S.tfidf(TOP)}"


@registered(
    f"WITH {_BOTH}, h AS (SELECT query_id, doc_id, rank, score, 8e-2 AS prior, 'a' AS l FROM bm UNION ALL SELECT query_id, doc_id, rank, score, 2e-2, 'b' FROM te), "
    f"m AS (SELECT query_id, doc_id, 65e-2 * {S.minmax('score', 'PARTITION BY query_id, l')} + 3e-1 / (6e1 + rank) + prior + 8e-2 AS s FROM h), "
    f"g AS (SELECT query_id, doc_id, max(s) AS score FROM m GROUP BY ALL), r AS (SELECT *, {S.RANK} AS rank FROM g QUALIFY rank <= {TOP}) {_HITS} r"
)
def corpus_merge(spark, sf):
    tagged = lambda h, corpus: h.withColumns({"corpus": F.lit(corpus), "variant": F.lit("original")})
    return rounded(retrieval.merge_corpora(tagged(bm25_hits(spark, sf), "structure").unionByName(tagged(tfidf_hits(spark, sf), "fixed")), TOP))


_RRF = f"{_BOTH}, g AS (SELECT query_id, doc_id, sum(1e0 / (6e1 + rank)) AS score FROM (SELECT query_id, doc_id, rank FROM bm UNION ALL SELECT query_id, doc_id, rank FROM te) GROUP BY ALL), rf AS (SELECT *, {S.RANK} AS rank FROM g QUALIFY rank <= {TOP})"


@registered(f"WITH {_RRF} {_HITS} rf")
def rrf_fusion(spark, sf):
    return rounded(retrieval.rrf(bm25_hits(spark, sf), tfidf_hits(spark, sf), TOP))


@registered(
    f"WITH {_BOTH}, g AS (SELECT query_id, doc_id, sum(s) AS score FROM (SELECT query_id, doc_id, 5e-1 * {S.minmax('score', 'PARTITION BY query_id')} AS s FROM bm UNION ALL SELECT query_id, doc_id, 5e-1 * {S.minmax('score', 'PARTITION BY query_id')} FROM te) GROUP BY ALL), "
    f"t AS (SELECT query_id, doc_id, score + 15e-2 * {S.overlap(S.tokens('query_text'), S.tokens('title'))} AS score FROM g JOIN q USING (query_id) JOIN d USING (doc_id)), r AS (SELECT *, {S.RANK} AS rank FROM t QUALIFY rank <= {TOP}) {_HITS} r"
)
def score_fusion(spark, sf):
    fused = retrieval.fuse_scores(bm25_hits(spark, sf), tfidf_hits(spark, sf), 2 * TOP).drop("rank")
    titled = fused.join(audit.build_documents(retrieval.of_hits(table(spark, sf, "documents"), fused)).select("doc_id", "title"), "doc_id").join(questions(spark, sf), "query_id")
    return rounded(retrieval.ranked(titled.withColumn("score", F.col("score") + retrieval.title_bonus(F.col("query_text"), F.col("title"))), TOP))


_RERANK = f"""{S.bm25(TOP)}, x AS (SELECT query_id, doc_id, score + 4e-1 * {S.overlap(S.tokens('query_text'), S.tokens('title'))} + 4e-1 * {S.overlap(S.tokens('query_text'), S.tokens('left(body, 500)'))} AS score FROM bm JOIN q USING (query_id) JOIN d USING (doc_id)),
rr AS (SELECT *, {S.RANK} AS rank FROM x)"""


@registered(f"WITH {_RERANK} {_HITS} rr")
def heuristic_rerank(spark, sf):
    return rounded(retrieval.rerank(full_hits(spark, sf), TOP))


# Contexts and answers

_FULL = f"{S.bm25(TOP)}, f AS (SELECT bm.*, d.body, d.source, d.title, q.query_text FROM bm JOIN d USING (doc_id) JOIN q USING (query_id))"
_SELECT = f"{_FULL}, s1 AS (SELECT * FROM f QUALIFY row_number() OVER (PARTITION BY query_id, source ORDER BY rank) <= 2), s2 AS (SELECT * REPLACE (row_number() OVER (PARTITION BY query_id ORDER BY rank) AS rank) FROM s1), cx AS (SELECT * FROM s2 WHERE rank <= 5)"


def contexts(spark, sf, hits=None):
    return context.select_contexts(full_hits(spark, sf, hits), 5, 2)


@registered(f"WITH {_SELECT} {_HITS} cx")
def context_select(spark, sf):
    return rounded(contexts(spark, sf))


@registered(
    f"WITH RECURSIVE {_FULL}, k(query_id, i, kept) AS (SELECT DISTINCT query_id, 0::BIGINT, CAST([] AS STRUCT(doc_id BIGINT, source VARCHAR, p VARCHAR)[]) FROM f "
    "UNION ALL SELECT k.query_id, k.i + 1, CASE WHEN len(list_filter(k.kept, lambda x: x.source = f.source AND (starts_with(x.p, left(f.body, 120)) OR starts_with(left(f.body, 120), x.p)))) > 0 THEN k.kept "
    "ELSE list_append(k.kept, {'doc_id': f.doc_id, 'source': f.source, 'p': left(f.body, 120)}) END FROM k JOIN f ON f.query_id = k.query_id AND f.rank = k.i + 1), "
    "l AS (SELECT query_id, kept FROM k QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY i DESC) = 1) "
    "SELECT query_id, generate_subscripts(kept, 1)::INT AS rank, unnest(list_transform(kept, lambda x: x.doc_id)) AS doc_id FROM l"
)
def context_dedupe(spark, sf):
    return context.dedupe_contexts(full_hits(spark, sf))


@registered(
    f"WITH {_SELECT}, e AS (SELECT query_id, rank, doc_id, query_text, unnest({S.sentences('body')}) AS sentence, generate_subscripts({S.sentences('body')}, 1) AS pos FROM cx), "
    f"o AS (SELECT *, {S.overlap(S.tokens('query_text'), S.tokens('sentence'))} AS l FROM e), n AS (SELECT *, row_number() OVER (PARTITION BY query_id, rank ORDER BY l DESC, pos) AS n FROM o QUALIFY n <= 3), "
    "a AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rank, n) AS k FROM n QUALIFY k <= 8) SELECT query_id, rank::INT AS rank, doc_id, string_agg(sentence, ' ' ORDER BY n) AS text FROM a GROUP BY ALL"
)
def context_compress(spark, sf):
    return context.compress_contexts(contexts(spark, sf), 3, 8)


_ANSWERS = f"""{_SELECT}, st1 AS (SELECT query_id, rank, doc_id, body FROM cx WHERE rank <= 3 AND score >= 1e0),
se AS (SELECT query_id, rank, unnest({S.sentences('body')}) AS s, generate_subscripts({S.sentences('body')}, 1) AS pos FROM st1),
fs AS (SELECT query_id, s, rank, pos FROM se QUALIFY row_number() OVER (PARTITION BY query_id, s ORDER BY rank, pos) = 1),
fk AS (SELECT * FROM fs QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY rank, pos) <= 4),
an AS (SELECT q.query_id, coalesce(a.answer, '{context.NO_ANSWER}') AS answer, a.answer IS NULL AS abstained, coalesce(b.used, []) AS used FROM q LEFT JOIN (SELECT query_id, string_agg(s, ' ' ORDER BY rank, pos) AS answer FROM fk GROUP BY 1) a USING (query_id) LEFT JOIN (SELECT query_id, list(doc_id ORDER BY rank) AS used FROM st1 GROUP BY 1) b USING (query_id))"""


def answers(spark, sf, held=None):
    return context.extractive_answers(contexts(spark, sf) if held is None else held, questions(spark, sf), 3, 4, 1.0)


@registered(f"WITH {_ANSWERS} SELECT query_id, md5(answer) AS digest, abstained, array_to_string(used, '|') AS used FROM an")
def extractive_answers(spark, sf):
    return answers(spark, sf).select("query_id", F.md5("answer").alias("digest"), "abstained", F.array_join(F.col("used").cast("array<string>"), "|").alias("used"))


_SUPPORT = f"""{_ANSWERS}, cl AS (SELECT query_id, list(body) AS bodies, max(score) AS top FROM cx GROUP BY 1),
sn AS (SELECT query_id, unnest({S.sentences("regexp_replace(answer, '\\[[0-9]+\\]', '', 'g')")}) AS s FROM an),
sp AS (SELECT query_id, avg(CASE WHEN len(list_filter(coalesce(bodies, []), lambda c: contains(c, s) OR {S.overlap(S.tokens('s'), S.tokens('c'))} >= 6e-1)) > 0 THEN 1e0 ELSE 0e0 END) AS support FROM sn LEFT JOIN cl USING (query_id) GROUP BY 1),
al AS (SELECT an.*, coalesce(top, 0e0) AS top, coalesce(support, 1e0) AS support FROM an LEFT JOIN sp USING (query_id) LEFT JOIN cl USING (query_id))"""


def aligned(spark, sf, chosen=None):
    chosen = contexts(spark, sf) if chosen is None else chosen
    held = chosen.groupBy("query_id").agg(F.collect_list("text").alias("bodies"), F.max("score").alias("top"))
    rows = answers(spark, sf, chosen).join(held, "query_id", "left").withColumn("bodies", F.coalesce("bodies", F.array().cast("array<string>")))
    return rows.withColumns({"support": context.support_ratio(F.col("answer"), F.col("bodies")), "top": F.coalesce("top", F.lit(0.0))}).drop("bodies")


@registered(f"WITH {_SUPPORT} SELECT query_id, round(support, 6) AS support, support >= 1 AS all_valid FROM al")
def citation_alignment(spark, sf):
    return aligned(spark, sf).select("query_id", F.round("support", 6).alias("support"), (F.col("support") >= 1).alias("all_valid"))


@registered(
    f"WITH {_SUPPORT}, g AS (SELECT query_id, list_filter([CASE WHEN top < 5e0 THEN 'low_score' END, CASE WHEN NOT abstained AND NOT regexp_matches(answer, '\\[[0-9]+\\]') THEN 'missing_citation' END, CASE WHEN support < 5e-1 THEN 'inconsistent' END], lambda x: x IS NOT NULL) AS r FROM al) "
    "SELECT query_id, array_to_string(r, '|') AS reasons, len(r) > 0 AS blocked FROM g"
)
def guardrails(spark, sf):
    r = context.guardrail_reasons(F.col("answer"), F.col("abstained"), F.col("top"), F.col("support"), 5.0, 0.5)
    return aligned(spark, sf).withColumn("r", r).select("query_id", F.array_join("r", "|").alias("reasons"), (F.size("r") > 0).alias("blocked"))


@registered("SELECT event_id, CASE event_id % 3 WHEN 0 THEN 'strict' WHEN 1 THEN 'sliced' ELSE 'fallback' END AS status, CASE WHEN event_id % 3 < 2 THEN json_extract_string(props, '$.k') END AS k FROM events")
def llm_payload_parse(spark, sf):
    e = table(spark, sf, "events")
    said = F.when(F.col("event_id") % 3 == 0, F.col("props")).when(F.col("event_id") % 3 == 1, F.concat(F.lit("<think>hm {</think> Sure: "), "props", F.lit(" done"))).otherwise(F.lit("no object"))
    # get_json_object gives null for an object as a whole only where it does not parse.
    return e.withColumn("said", said).select("event_id", T.parse_status(F.col("said")).alias("status"), F.get_json_object(T.json_payload(F.col("said")), "$.k").alias("k"))


# Evaluation

METRICS = ["mrr"] + [f"{m}_{k}" for k in (1, 3, 5) for m in ("recall", "hit", "precision", "ndcg")]


def _metric_sql() -> str:
    cols = ["coalesce(1e0 / min(CASE WHEN r.rel THEN r.rank END), 0e0) AS mrr"]
    for k in (1, 3, 5):
        found, top = f"count_if(r.rel AND r.rank <= {k})", f"count_if(r.rank <= {k})"
        ideal = f"list_sum(list_transform(range(1, least(any_value(n_gold), {k}) + 1), lambda i: 1e0 / log2(i + 1e0)))"
        cols += [
            f"coalesce({found}::DOUBLE / any_value(n_gold), 0e0) AS recall_{k}",
            f"(CASE WHEN {found} > 0 THEN 1e0 ELSE 0e0 END) AS hit_{k}",
            f"coalesce({found}::DOUBLE / nullif({top}, 0), 0e0) AS precision_{k}",
            f"coalesce(sum(CASE WHEN r.rel AND r.rank <= {k} THEN 1e0 / log2(r.rank + 1e0) ELSE 0e0 END) / {ideal}, 0e0) AS ndcg_{k}",
        ]
    return f"""ng AS (SELECT query_id, count(*) AS n_gold FROM rel GROUP BY 1),
hr AS (SELECT h.query_id, h.rank, rel.doc_id IS NOT NULL AS rel FROM bm h LEFT JOIN rel USING (query_id, doc_id)),
me AS (SELECT q.query_id, q.query_id % 3 AS kind, {', '.join(cols)} FROM q LEFT JOIN hr r USING (query_id) LEFT JOIN ng USING (query_id) GROUP BY 1, 2)"""


_EVAL = f"{S.bm25(TOP)}, {S.QRELS}, {_metric_sql()}"
_ROUNDED = ", ".join(f"round({m}, 6) AS {m}" for m in METRICS)


def metrics(spark, sf):
    return evaluation.retrieval_metrics(bm25_hits(spark, sf), relevant(spark, sf), questions(spark, sf))


@registered(f"WITH {_EVAL} SELECT query_id, {_ROUNDED} FROM me")
def retrieval_metrics(spark, sf):
    return metrics(spark, sf).select("query_id", *[F.round(m, 6).alias(m) for m in METRICS])


@registered(f"WITH {_EVAL} SELECT CASE WHEN grouping(kind) = 1 THEN 'all' ELSE kind::VARCHAR END AS kind, count(*) AS n, {', '.join(f'round(avg({m}), 6) AS {m}' for m in METRICS)} FROM me GROUP BY GROUPING SETS ((), (kind))")
def retrieval_metrics_by_type(spark, sf):
    m = metrics(spark, sf).withColumn("kind", (F.col("query_id") % 3).cast("string"))
    return evaluation.means(m, METRICS, "kind").select(F.coalesce("kind", F.lit("all")).alias("kind"), "n", *[F.round(x, 6).alias(x) for x in METRICS])


GENERATION = ["answer_correctness", "citation_precision", "citation_recall", "abstained", "abstain_accuracy", "wrong_abstain"]
_GOLD = "gg AS (SELECT q.query_id, q.raw AS reference, coalesce(s.ids, []) AS supporting, s.ids IS NOT NULL AS answerable, (q.query_id % 3)::VARCHAR AS question_type FROM q LEFT JOIN (SELECT query_id, list(doc_id) AS ids FROM rel GROUP BY 1) s USING (query_id))"
_F1 = lambda a, r: f"(CASE WHEN len(list_intersect(list_distinct({a}), list_distinct({r}))) = 0 THEN 0e0 ELSE 2e0 * len(list_intersect(list_distinct({a}), list_distinct({r}))) / (len(list_distinct({a})) + len(list_distinct({r}))) END)"
_OVER = lambda n, d: f"(CASE WHEN {d} = 0 THEN 0e0 ELSE ({n})::DOUBLE / {d} END)"
_GEN = f"""{_SUPPORT}, {S.QRELS}, {_GOLD}, gm AS (SELECT query_id, question_type, {_F1(S.tokens('answer'), S.tokens('reference'))} AS answer_correctness,
{_OVER('len(list_intersect(used, supporting))', 'len(used)')} AS citation_precision, {_OVER('len(list_intersect(used, supporting))', 'len(supporting)')} AS citation_recall,
abstained::INT::DOUBLE AS abstained, (abstained <> answerable)::INT::DOUBLE AS abstain_accuracy, (abstained AND answerable)::INT::DOUBLE AS wrong_abstain FROM al JOIN gg USING (query_id))"""


def gold(spark, sf, rel=None):
    ids = (relevant(spark, sf) if rel is None else rel).groupBy("query_id").agg(F.collect_list("doc_id").alias("ids"))
    q = questions(spark, sf).join(ids, "query_id", "left")
    return q.select("query_id", F.col("raw").alias("reference"), F.coalesce("ids", F.array().cast("array<long>")).alias("supporting"), F.col("ids").isNotNull().alias("answerable"), (F.col("query_id") % 3).cast("string").alias("question_type"))


@registered(f"WITH {_GEN} SELECT query_id, question_type, {', '.join(f'round({m}, 6) AS {m}' for m in GENERATION)} FROM gm")
def generation_metrics(spark, sf):
    m = evaluation.generation_metrics(answers(spark, sf), gold(spark, sf))
    return m.select("query_id", "question_type", *[F.round(x, 6).alias(x) for x in GENERATION])


@registered(f"WITH {_GEN} SELECT CASE WHEN grouping(question_type) = 1 THEN 'all' ELSE question_type END AS question_type, count(*) AS n, {', '.join(f'round(avg({m}), 6) AS {m}' for m in GENERATION)} FROM gm GROUP BY GROUPING SETS ((), (question_type))")
def generation_metrics_grouped(spark, sf):
    m = evaluation.means(evaluation.generation_metrics(answers(spark, sf), gold(spark, sf)), GENERATION, "question_type")
    return m.select(F.coalesce("question_type", F.lit("all")).alias("question_type"), "n", *[F.round(x, 6).alias(x) for x in GENERATION])


_PAIRS = "t AS (SELECT conv_id, turn, role, text, lead(role) OVER w AS next_role, lead(text) OVER w AS next_text FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)), p AS (SELECT conv_id, turn, text AS question, next_text AS answer FROM t WHERE role = 'user' AND next_role = 'assistant')"


@registered(f"WITH {_PAIRS} SELECT conv_id, turn, round({S.overlap(S.tokens('question'), S.tokens('answer'))}, 6) AS answer_relevancy, round({_F1(S.tokens('answer'), S.tokens('question'))}, 6) AS f1 FROM p")
def auto_eval_metrics(spark, sf):
    w = Window.partitionBy("conv_id").orderBy("turn")
    t = table(spark, sf, "conversations").withColumns({"next_role": F.lead("role").over(w), "answer": F.lead("text").over(w)})
    p = t.where("role = 'user' AND next_role = 'assistant'")
    q, a = F.col("text"), F.col("answer")
    return p.select("conv_id", "turn", F.round(T.overlap_ratio(T.tokens(q), T.tokens(a)), 6).alias("answer_relevancy"), F.round(evaluation.token_f1(a, q), 6).alias("f1"))


def _mode_recall(name: str, hits: str) -> str:
    found = lambda k: f"(SELECT count(*) FROM {hits} h JOIN rel USING (query_id, doc_id) WHERE h.query_id = ng.query_id AND h.rank <= {k})::DOUBLE / n_gold"
    return f"SELECT '{name}' AS mode, round(sum({found(3)}) / (SELECT count(*) FROM q), 6) AS recall_3, round(sum({found(5)}) / (SELECT count(*) FROM q), 6) AS recall_5 FROM ng"


@registered(f"WITH {_RRF}, {S.QRELS}, ng AS (SELECT query_id, count(*) AS n_gold FROM rel GROUP BY 1) {_mode_recall('bm25', 'bm')} UNION ALL {_mode_recall('tfidf', 'te')} UNION ALL {_mode_recall('hybrid', 'rf')}")
def hybrid_mode_table(spark, sf):
    a, b = bm25_hits(spark, sf), tfidf_hits(spark, sf)
    rel, q, out = relevant(spark, sf), questions(spark, sf), None
    for mode, hits in (("bm25", a), ("tfidf", b), ("hybrid", retrieval.rrf(a, b, TOP))):
        m = evaluation.retrieval_metrics(hits, rel, q, (3, 5)).agg(F.round(F.avg("recall_3"), 6).alias("recall_3"), F.round(F.avg("recall_5"), 6).alias("recall_5")).select(F.lit(mode).alias("mode"), "recall_3", "recall_5")
        out = m if out is None else out.unionByName(m)
    return out


_ERRORS = f"""{_GEN}, hg AS (SELECT bm.query_id, bool_or(rel.doc_id IS NOT NULL) AS hit_any, bool_or(rel.doc_id IS NOT NULL AND bm.rank <= 1) AS hit_top FROM bm LEFT JOIN rel USING (query_id, doc_id) GROUP BY 1),
er AS (SELECT al.query_id, list_filter([CASE WHEN answerable AND NOT coalesce(hit_any, false) THEN 'retrieval_miss' WHEN answerable AND NOT coalesce(hit_top, false) THEN 'ranking_miss' END, CASE WHEN support < 1 THEN 'citation_mismatch' END,
CASE WHEN al.abstained = answerable THEN 'wrong_abstain' END, CASE WHEN answerable AND NOT al.abstained AND answer_correctness < 5e-1 THEN 'generation_hallucination' END], lambda x: x IS NOT NULL) AS labels
FROM al JOIN gg USING (query_id) JOIN gm USING (query_id) LEFT JOIN hg USING (query_id))"""


def errors(spark, sf):
    # Each step is worked out once, however often it is read.
    found, rel = bm25_hits(spark, sf), relevant(spark, sf)
    chosen = contexts(spark, sf, found)
    hits = found.join(rel.withColumn("rel", F.lit(True)), ["query_id", "doc_id"], "left")
    held = hits.groupBy("query_id").agg(F.bool_or(F.col("rel").isNotNull()).alias("hit_any"), F.bool_or(F.col("rel").isNotNull() & (F.col("rank") <= 1)).alias("hit_top"))
    g = gold(spark, sf, rel)
    correct = evaluation.generation_metrics(answers(spark, sf, chosen), g).select("query_id", F.col("answer_correctness").alias("correctness"))
    rows = aligned(spark, sf, chosen).join(g, "query_id").join(correct, "query_id").join(held, "query_id", "left")
    return evaluation.error_labels(rows.withColumns({c: F.coalesce(c, F.lit(False)) for c in ("hit_any", "hit_top")}))


@registered(f"WITH {_ERRORS} SELECT query_id, array_to_string(labels, '|') AS labels FROM er")
def error_labels(spark, sf):
    return errors(spark, sf).select("query_id", F.array_join("labels", "|").alias("labels"))


@registered(f"WITH {_ERRORS} SELECT key, count(*) AS n FROM (SELECT unnest(labels) AS key FROM er) GROUP BY key")
def error_counts(spark, sf):
    return cleaning.counts_of(errors(spark, sf), "labels")


# Benchmark synthesis

_CANDIDATES = f"""{_UNITS}, sn AS (SELECT doc_id, part, list_filter(list_transform(regexp_split_to_array(text, '[.!?;\\n]'), lambda s: {S.space('s')}), lambda s: s <> '') AS ss FROM u),
s AS (SELECT doc_id, part, (generate_subscripts(ss, 1) - 1)::INT AS pos, unnest(ss) AS sentence FROM sn),
x AS (SELECT *, trim(regexp_replace(regexp_extract(sentence, '([a-z]{{2,24}}) is ', 1), '[（(][^）)]*[）)]', '', 'g')) AS term, doc_id::VARCHAR || ':' || pos::VARCHAR AS seed, 'part ' || part::VARCHAR AS label FROM s WHERE length(sentence) >= 12),
k AS (SELECT doc_id, part, pos, 'definition' AS question_type, ['What is ' || term || '?', 'How is ' || term || ' defined?'] AS o, seed, sentence FROM x WHERE length(term) >= 2
 UNION ALL SELECT doc_id, part, pos, 'condition', ['Which conditions does ' || label || ' set?', 'When does ' || label || ' apply?'], seed, sentence FROM x WHERE contains(sentence, 'that') OR contains(sentence, 'que') OR contains(sentence, 'der')
 UNION ALL SELECT doc_id, part, pos, 'procedure', ['Which steps does ' || label || ' name?', 'How does one proceed under ' || label || '?'], seed, sentence FROM x WHERE contains(sentence, 'tion') OR contains(sentence, 'ment') OR contains(sentence, 'keit')),
cd AS (SELECT doc_id, part, pos, question_type, o[1 + list_sum(list_transform(string_split(seed || ':' || question_type, ''), lambda c: ascii(c)))::BIGINT % 2] AS question, sentence AS gold_answer FROM k)"""


def found(spark, sf):
    return benchmark.candidates(units(spark, sf))


@registered(f"WITH {_CANDIDATES} SELECT doc_id, part, pos, question_type, question, md5(gold_answer) AS digest FROM cd")
def benchmark_candidates(spark, sf):
    return found(spark, sf).select("doc_id", "part", "pos", "question_type", "question", F.md5("gold_answer").alias("digest"))


_GRAM = lambda x: S.ngrams(x, 2)


@registered(
    f"WITH {_CANDIDATES}, r AS (SELECT *, CASE WHEN length(question) < 16 THEN 'too_short' WHEN length(question) > 80 THEN 'too_long' WHEN regexp_matches(question, '\\?\\?|__|TODO') THEN 'placeholder' WHEN trim(gold_answer) = '' THEN 'missing_evidence' "
    f"WHEN {S.overlap(_GRAM('question'), _GRAM('gold_answer'))} < 12e-2 THEN 'weak_question_evidence_overlap' ELSE 'kept' END AS reason FROM cd) SELECT question_type, reason, count(*) AS n FROM r GROUP BY ALL"
)
def candidate_filter(spark, sf):
    r = F.coalesce(benchmark.filter_reason(F.col("question"), F.col("gold_answer"), 16, 80, 0.12), F.lit("kept"))
    return found(spark, sf).groupBy("question_type", r.alias("reason")).agg(F.count("*").alias("n"))


_KEY = f"lower(regexp_replace({S.space('question')}, '[?？。.!！,，;；:：\"''《》]', '', 'g'))"


@registered(f"WITH {_CANDIDATES} SELECT doc_id, part, pos, question_type, question FROM cd QUALIFY row_number() OVER (PARTITION BY question_type, {_KEY} ORDER BY doc_id, part, pos) = 1")
def candidate_dedup_lexical(spark, sf):
    return benchmark.lexical_dedup(found(spark, sf)).drop("gold_answer")


@registered()
def candidate_dedup_semantic(spark, sf):
    return benchmark.semantic_dedup(found(spark, sf))


@registered()
def benchmark_select(spark, sf):
    return benchmark.final_selection(benchmark.lexical_dedup(found(spark, sf)), 20)


@registered(f"WITH {_UNITS}, n AS (SELECT doc_id, part, text, lead(part) OVER w AS next_part, lead(text) OVER w AS next_text FROM u WINDOW w AS (PARTITION BY doc_id ORDER BY part)) SELECT doc_id, part, next_part FROM n WHERE next_part IS NOT NULL AND text <> next_text")
def adjacent_pairs(spark, sf):
    return benchmark.adjacent_pairs(units(spark, sf))


@registered(f"WITH {S.DOCS}, {S.QUERIES}, {S.QRELS} SELECT q.query_id FROM q LEFT JOIN rel USING (query_id) WHERE rel.doc_id IS NULL")
def unanswerable_queries(spark, sf):
    return questions(spark, sf).select("query_id").join(relevant(spark, sf), "query_id", "left_anti")


@registered(f"WITH {S.DOCS}, {S.QUERIES}, {S.QRELS}, b AS (SELECT q.query_id, CASE WHEN q.query_id % 4 = 0 THEN '' ELSE q.raw END AS gold_answer, count(rel.doc_id) AS n FROM q LEFT JOIN rel USING (query_id) GROUP BY ALL) SELECT 0::BIGINT AS duplicate_ids, count_if(n = 0 AND gold_answer <> '')::BIGINT AS unanswerable_with_answer, 0::BIGINT AS answerable_without_evidence, count_if(n = 0 AND gold_answer <> '') = 0 AS is_valid FROM b")
def benchmark_validate(spark, sf):
    g = gold(spark, sf).select("query_id", "answerable", F.when(F.col("query_id") % 4 == 0, F.lit("")).otherwise(F.col("reference")).alias("gold_answer"), F.size("supporting").alias("n_evidence"))
    return evaluation.validate_benchmark(g)


@registered(f"WITH {_BOTH}, {S.QRELS}, ng AS (SELECT query_id, count(*) AS n_gold FROM rel GROUP BY 1), v AS ({_mode_recall('bm25', 'bm')} UNION ALL {_mode_recall('tfidf', 'te')}) SELECT m AS metric, max(CASE WHEN mode = 'bm25' THEN x END) AS bm25, max(CASE WHEN mode = 'tfidf' THEN x END) AS tfidf FROM (SELECT mode, unnest(['recall_3', 'recall_5']) AS m, unnest([recall_3, recall_5]) AS x FROM v) GROUP BY m")
def ablation_pivot(spark, sf):
    rel, q = relevant(spark, sf), questions(spark, sf)
    of = lambda hits, name: evaluation.retrieval_metrics(hits, rel, q, (3, 5)).withColumn("variant", F.lit(name))
    rows = of(bm25_hits(spark, sf), "bm25").unionByName(of(tfidf_hits(spark, sf), "tfidf"))
    return evaluation.ablation(rows, ["recall_3", "recall_5"], ["bm25", "tfidf"]).select("metric", F.round("bm25", 6).alias("bm25"), F.round("tfidf", 6).alias("tfidf"))


@registered("WITH c AS (SELECT coalesce(lang, '') AS corpus, count(*) AS n_docs FROM documents GROUP BY 1) SELECT retriever, generator, contexts, corpus, n_docs, retriever || '__' || generator || '__' || contexts || '__' || corpus AS variant FROM c, (SELECT unnest(['bm25', 'dense', 'hybrid']) AS retriever), (SELECT unnest(['extractive', 'llm']) AS generator), (SELECT unnest(['raw', 'processed']) AS contexts)")
def experiment_matrix(spark, sf):
    """Every combination of methods for each corpus that the documents make, by language, with its size."""
    corpora = table(spark, sf, "documents").groupBy(F.coalesce("lang", F.lit("")).alias("corpus")).agg(F.count("*").alias("n_docs"))
    rows = corpora.crossJoin(F.broadcast(evaluation.experiment_matrix(spark, ["bm25", "dense", "hybrid"], ["extractive", "llm"], ["raw", "processed"])))
    return rows.withColumn("variant", F.concat_ws("__", "variant", "corpus"))


@registered(f"WITH {S.bm25(3)} SELECT query_id, rank::VARCHAR AS label, doc_id, trim(left(body, 120)) AS span_text FROM bm JOIN d USING (doc_id)")
def citations(spark, sf):
    d = bodies(spark, sf)
    return context.citations(bm25_hits(spark, sf, 3).join(d, "doc_id"))


from corpusloom.plans import files as _files  # noqa: E402
from corpusloom.plans import further as _further  # noqa: E402
from corpusloom.plans import more as _more  # noqa: E402

for _module in (_more, _further, _files):
    QUERIES.update(_module.QUERIES)
    ORACLES.update(_module.ORACLES)
