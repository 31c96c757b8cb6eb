"""Common table expressions that the oracles share, in DuckDB's dialect."""

TOKEN = r"[A-Za-z0-9]+|[\x{4e00}-\x{9fff}]"
SPACE = r"[\s\x0b\x1c-\x1f\x85\pZ]+"


def space(x: str) -> str:
    return f"trim(regexp_replace(coalesce({x}, ''), '{SPACE}', ' ', 'g'))"


def norm(x: str) -> str:
    return space(f"regexp_replace(translate(coalesce({x}, ''), chr(12288) || chr(160), '  '), '<[^>]+>', ' ', 'g')")


def tokens(x: str) -> str:
    return f"regexp_extract_all({x}, '{TOKEN}')"


def sentences(x: str) -> str:
    """Of a text without line ends, with their delimiters."""
    return f"list_filter(list_transform(regexp_extract_all({x}, '[^.!?;]*[.!?;]|[^.!?;]+'), lambda s: trim(s)), lambda s: s <> '')"


def overlap(a: str, b: str) -> str:
    return f"(CASE WHEN len({a}) = 0 OR len({b}) = 0 THEN 0e0 ELSE len(list_intersect(list_distinct({a}), list_distinct({b})))::DOUBLE / len(list_distinct({a})) END)"


def minmax(score: str, by: str) -> str:
    return f"(CASE WHEN max({score}) OVER ({by}) = min({score}) OVER ({by}) THEN 1e0 ELSE ({score} - min({score}) OVER ({by})) / (max({score}) OVER ({by}) - min({score}) OVER ({by})) END)"


TITLE = norm("left(split_part(coalesce(text, ''), chr(10), 1), 60)")
DOCS = f"d AS (SELECT doc_id, text, lang, source, n_chars, {norm('text')} AS body, {TITLE} AS title FROM documents)"
QUERIES = f"q AS (SELECT item_id AS query_id, {norm('text')} AS query_text, text AS raw FROM benchmark)"
QRELS = "rel AS (SELECT q.query_id, d.doc_id FROM q JOIN d ON contains(d.text, q.raw))"
RANK = "row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, doc_id)"


def bm25(k: int, okapi: bool = False) -> str:
    plain = "ln(1 + (n - df + 5e-1) / (df + 5e-1))"
    raw = "ln(n - df + 5e-1) - ln(df + 5e-1)"
    idf = f"SELECT term, CASE WHEN {raw} < 0 THEN (SELECT avg({raw}) FROM df, st) * 25e-2 ELSE {raw} END AS idf FROM df, st" if okapi else f"SELECT term, {plain} AS idf FROM df, st"
    return f"""{DOCS}, {QUERIES},
tok AS (SELECT doc_id, {tokens('body')} AS ts FROM d),
post AS (SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest(ts) AS term FROM tok) GROUP BY ALL),
dl AS (SELECT doc_id, len(ts) AS dl FROM tok), st AS (SELECT count(*) AS n, avg(dl) AS avgdl FROM dl),
df AS (SELECT term, count(*) AS df FROM post GROUP BY term),
qt AS (SELECT query_id, term, count(*) AS qtf FROM (SELECT query_id, unnest({tokens('query_text')}) AS term FROM q) GROUP BY ALL),
idf AS ({idf}),
bs AS (SELECT query_id, doc_id, sum(qtf * idf * tf * 25e-1 / (tf + 15e-1 * (25e-2 + 75e-2 * dl / avgdl))) AS score
  FROM qt JOIN idf USING (term) JOIN post USING (term) JOIN dl USING (doc_id), st GROUP BY ALL),
bm AS (SELECT *, {RANK} AS rank FROM bs QUALIFY rank <= {k})"""


def ngrams(x: str, n: int = 3) -> str:
    """All n-grams: from each of n offsets the texts of n characters that follow one another."""
    t = f"regexp_replace({x}, '{SPACE}', '', 'g')"
    parts = ", ".join(f"regexp_extract_all(substr({t}, {k}), '.{{{n}}}')" for k in range(1, n + 1))
    return f"(CASE WHEN length({t}) = 0 THEN [] WHEN length({t}) < {n} THEN [{t}] ELSE list_concat({parts}) END)"


def tfidf(k: int) -> str:
    """Needs d and q."""
    return f"""gram AS (SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest({ngrams('body')}) AS term FROM d) GROUP BY ALL),
gdf AS (SELECT term, count(*) AS df FROM gram GROUP BY term), gn AS (SELECT count(*) AS n FROM d),
gw AS (SELECT doc_id, term, tf * (ln((1 + n)::DOUBLE / (1 + df)) + 1) AS w FROM gram JOIN gdf USING (term), gn),
gnorm AS (SELECT doc_id, sqrt(sum(w * w)) AS norm FROM gw GROUP BY doc_id),
gq AS (SELECT query_id, term, count(*) AS qtf FROM (SELECT query_id, unnest({ngrams('query_text')}) AS term FROM q) GROUP BY ALL),
gqw AS (SELECT query_id, term, qtf * (ln((1 + n)::DOUBLE / (1 + coalesce(df, 0))) + 1) AS qw FROM gq LEFT JOIN gdf USING (term), gn),
gqn AS (SELECT query_id, sqrt(sum(qw * qw)) AS qnorm FROM gqw GROUP BY query_id),
gs AS (SELECT query_id, doc_id, sum(w * qw) / (any_value(norm) * any_value(qnorm)) AS score FROM gw JOIN gqw USING (term) JOIN gnorm USING (doc_id) JOIN gqn USING (query_id) GROUP BY ALL),
te AS (SELECT *, {RANK} AS rank FROM gs WHERE score > 0 QUALIFY rank <= {k})"""


def fused(name: str, a: str, b: str, k: int, rrf: bool = True) -> str:
    """Two lists as one with the bonus for titles; ties keep the order of a, then of what only b has. Needs d and q."""
    s = "1e0 / (6e1 + rank)" if rrf else f"5e-1 * {minmax('score', 'PARTITION BY query_id')}"
    return f"""{name}0 AS (SELECT query_id, doc_id, sum(s) AS s, min({{'o': o, 'r': rank}}) AS place FROM (SELECT query_id, doc_id, rank, 0 AS o, {s} AS s FROM {a} UNION ALL SELECT query_id, doc_id, rank, 1, {s} FROM {b}) GROUP BY ALL),
{name}1 AS (SELECT query_id, doc_id, place, s + 15e-2 * {overlap(tokens('query_text'), tokens('title'))} AS score FROM {name}0 JOIN q USING (query_id) JOIN d USING (doc_id)),
{name} AS (SELECT query_id, doc_id, score, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, place, doc_id) AS rank FROM {name}1 QUALIFY rank <= {k})"""
