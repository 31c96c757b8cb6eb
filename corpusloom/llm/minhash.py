"""MinHash near-dedup by one-permutation hashing with optimal densification.

One hash of each shingle puts it into a bin and orders it there; the least of each bin make the sketch, and an empty bin takes
the value of one drawn evenly from those that are not. Bands of the sketch are buckets; each text of a bucket is joined with the bucket's
first alone, so buckets give stars and not all their pairs. Stars propose links; links are confirmed on full sets,
and what sketches and stars have missed is found exactly by `setjoin`.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType, _parse_datatype_string

from corpusloom.llm import setjoin
from corpusloom.llm.common import forget, released, small_batches, table, written
from corpusloom.llm.words import words_of

#: Bands of so many bins: two sets of similarity 0.85 agree in none of them in about one case of 10,000, sets of 0.3 in one in one case of 200.
BANDS, ROWS = 24, 7
#: Components of texts are broadcast up to so many rows; beyond that they are joined by a shuffle.
BROADCAST_ROWS = 1_000_000


def _probes(bins: int) -> np.ndarray:
    """For each bin an order of all bins, drawn at random: the first that is not empty is drawn evenly from those."""
    return np.argsort(np.random.default_rng(11).random((bins, bins)), axis=1)


def sketch(hashes: np.ndarray, probes: np.ndarray) -> np.ndarray:
    """The sketch of different hashes that are sorted as unsigned numbers; there must be one at least."""
    x, bins = hashes.view(np.uint64), len(probes)
    own, first = np.unique((x >> np.uint64(32)) * np.uint64(bins) >> np.uint64(32), return_index=True)
    filled, out = np.zeros(bins, bool), np.zeros(bins, np.uint64)
    filled[own], out[own] = True, x[first]
    if len(own) < bins:
        empty = np.flatnonzero(~filled)
        out[empty] = out[probes[empty, filled[probes[empty]].argmax(1)]]
    return out


def _sketched(rule: setjoin.Rule, common: np.ndarray, bands: int, rows: int):
    """Over rows (doc_id, key, t): doc_id, key, number of shingles, the bands' hashes and the prefix; both are empty without a word."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        probes = _probes(bands * rows)
        for whole in batches:
            for at in range(0, whole.num_rows, setjoin.AT_ONCE):
                batch = whole.slice(at, setjoin.AT_ONCE)
                words = [words_of(t.as_py()) for t in batch.column(2)]
                found = [setjoin.shingle_hashes(w, rule.size) if w else np.zeros(0, np.int64) for w in words]
                of = [sketch(x, probes).reshape(bands, rows) if len(x) else () for x in found]
                hashed = [np.array([xxhash.xxh64_intdigest(b.tobytes(), k) for k, b in enumerate(s)], np.uint64).view(np.int64) for s in of]
                firsts = [setjoin.prefix(x, common, rule.similarity) if len(x) else x for x in found]
                lists = [pa.array(x, pa.list_(pa.int64())) for x in (hashed, firsts)]
                yield pa.record_batch([batch.column(0), batch.column(1), pa.array([len(x) for x in found], pa.int64()), *lists], ["doc_id", "key", "n_shingles", "bands", "prefix"])

    return run


def stars(nodes: DataFrame) -> DataFrame:
    """Links (a, b) of each node (node, bands) with the first of each of its buckets; a bucket of n makes n - 1 of them."""
    rows = nodes.select(F.explode("bands").alias("bucket"), "node")
    hubs = rows.groupBy("bucket").agg(F.min("node").alias("a"), F.count("*").alias("n")).where("n > 1").select("bucket", "a")
    return rows.join(hubs, "bucket").where("node != a").select("a", F.col("node").alias("b")).distinct()


def near_duplicates(docs: DataFrame, similarity: float = 0.8, size: int = 5, bands: int = BANDS, rows: int = ROWS, doc_id: str = "doc_id", text: str = "text", large: int = 4096, block: int = 128) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) for every row of docs.

    Texts are linked whose sets of `size`-word shingles (of fewer words: the whole text as one) have a Jaccard index of
    at least `similarity` (above 0); component_id is the least doc_id that links lead to, itself included, and the row with it is
    kept. Null and wordless texts have the empty set and are linked with nothing; texts of any length count as a whole. Repeated rows come out as
    often as they went in, and are kept or not alike; a null doc_id is never the least unless a component has no other. Other columns play no
    part. No rows, no rows. large and block decide how work is dealt and not the result.
    """
    rule = setjoin.Rule(size, similarity, large, block)
    key = F.md5(F.coalesce(F.col(text), F.lit("")))
    texts = docs.select(F.col(doc_id).alias("doc_id"), key.alias("key"), F.col(text).alias("t"))
    schema = StructType([StructField("doc_id", docs.schema[doc_id].dataType), *_parse_datatype_string("key string, n_shingles long, bands array<long>, prefix array<long>").fields])
    with small_batches(docs.sparkSession):
        told = written(texts.mapInArrow(released(_sketched(rule, setjoin.common_shingles(texts, size), bands, rows)), schema), "sketches")
        nodes = told.where("n_shingles > 0").groupBy("key").agg(F.min("doc_id").alias("least"), F.count("*").alias("n"), *[F.first(c).alias(c) for c in ("n_shingles", "bands", "prefix")])
        # The number is given once, when the table is written.
        nodes = written(nodes.withColumn("node", F.monotonically_increasing_id()), "nodes")
        proposed = written(stars(nodes), "stars")
        roots = setjoin.joined(proposed, nodes, texts, rule)
    group = written(nodes.join(roots, "node", "left").select("key", "n", "least", F.coalesce("root", "node").alias("root"), F.col("root").isNotNull().alias("linked")), "groups")
    least = group.where("linked").groupBy("root").agg(F.min("least").alias("component_id"))
    # Only texts with several rows or links are looked up; the others are alone.
    of = group.where("linked or n > 1").join(least, "root", "left").select("key", F.when(F.col("linked"), F.col("component_id")).otherwise(F.col("least")).alias("component_id"))
    of = written(of, "components")
    found = F.broadcast(of) if of.count() <= BROADCAST_ROWS else of
    out = told.select("doc_id", "key", "n_shingles").join(found, "key", "left").withColumn("component_id", F.when(F.col("n_shingles") > 0, F.coalesce("component_id", "doc_id")).otherwise(F.col("doc_id")))
    forget(proposed, group)
    return out.select("doc_id", "n_shingles", "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))


def op11_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents, linked where their sets of 3-word shingles have a Jaccard index of at least 0.85."""
    return near_duplicates(table(spark, sf_dir, "documents"), similarity=0.85, size=3)


ORACLE = r"""
WITH RECURSIVE docs AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
sets AS (
  SELECT doc_id, list_distinct(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
    ELSE list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]) END) AS s FROM docs),
alike AS (SELECT row_number() OVER () AS k, min(doc_id) AS least, list(doc_id) AS ids, len(s) AS n, s FROM (SELECT doc_id, list_sort(s) AS s FROM sets WHERE len(s) > 0) GROUP BY s),
rows AS (SELECT k, n, unnest(s) AS x FROM alike),
links AS (
  SELECT a.k AS a, b.k AS b FROM rows a JOIN rows b ON a.x = b.x AND a.k < b.k AND 100 * least(a.n, b.n) >= 85 * greatest(a.n, b.n)
  GROUP BY a.k, b.k, a.n, b.n HAVING 100 * count(*) >= 85 * (a.n + b.n - count(*))),
pairs AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach AS (SELECT k AS a, k AS b FROM alike UNION SELECT r.a, l.b FROM reach r JOIN pairs l ON r.b = l.a),
roots AS (SELECT r.a AS k, min(l.least) AS component_id FROM reach r JOIN alike l ON r.b = l.k GROUP BY r.a),
found AS (SELECT unnest(ids) AS doc_id, component_id FROM alike JOIN roots USING (k))
SELECT s.doc_id, len(s.s)::BIGINT AS n_shingles, coalesce(component_id, s.doc_id) AS component_id, s.doc_id = coalesce(component_id, s.doc_id) AS kept
FROM sets s LEFT JOIN found USING (doc_id)
"""
