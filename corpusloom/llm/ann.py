"""Nearest neighbours by a block matrix join with int8 products.

Queries and candidates are dealt into blocks of int8 codes; a tile is a block of queries against a block of
candidates, and only codes, scales and error norms are copied for it. In a tile, products of codes bound each
cosine from both sides; pairs whose upper bound stays below the k-th best lower bound are dropped, first within
the tile, then over all tiles of a query. For the surviving pairs the original vectors are joined by number, the
cosine is computed in double precision, and heaps keep the best of each query.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window
from pyspark.sql import functions as F

from corpusloom.llm.common import partitions, table, written

#: Vectors of a block at most; blocks are smaller while there are fewer tiles than partitions, but not below LEAST.
BLOCK, LEAST = 65_536, 2048
#: Products of so many components of int8 are exact in float32; longer vectors are multiplied slab by slab.
SLAB = 1024
_ROWS = 64


def usable(vectors: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding", is_query: Column | None = None) -> DataFrame:
    """(vec_id, v array<double>, query, dim) of the vectors that are not null, zero or empty and have finite components only; null ids go too."""
    v = F.col(embedding).cast("array<double>")
    # Whether a row is a query is told by its own columns, whatever they are called.
    query = F.lit(False) if is_query is None else F.coalesce(is_query, F.lit(False))
    own = vectors.select(F.col(vec_id).cast("long").alias("vec_id"), v.alias("v"), query.alias("query"))
    v = F.col("v")
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = own.where(F.col("vec_id").isNotNull() & F.col("v").isNotNull())
    return rows.where(finite & F.exists("v", lambda x: x != 0)).withColumn("dim", F.size("v"))


def _quantised(x: np.ndarray) -> tuple[np.ndarray, ...]:
    """int8 codes of unit vectors, their scale, and the norms of the coded vector and of what coding leaves."""
    u = x / np.abs(x).max(1, keepdims=True)
    u /= np.sqrt((u * u).sum(1, keepdims=True))
    scale = np.abs(u).max(1, keepdims=True) / 127
    codes = np.rint(u / scale).astype(np.int8)
    coded = codes * scale
    return codes, scale[:, 0], np.sqrt((coded * coded).sum(1)), np.sqrt(((u - coded) ** 2).sum(1))


def _scaled(x: np.ndarray) -> np.ndarray:
    """Rows divided by a power of two near their largest component, which changes no cosine but keeps squares from over- and underflow."""
    return np.ldexp(x, -np.frexp(np.abs(x).max(1, keepdims=True))[1])


def cosines(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Row by row, in double precision, summed from the first component to the last."""
    a, b = np.ascontiguousarray(_scaled(a).T), np.ascontiguousarray(_scaled(b).T)
    return np.clip((a * b).sum(0) / np.sqrt((a * a).sum(0) * (b * b).sum(0)), -1.0, 1.0)


def _coded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Over rows (n, vec_id, dim, query, v) of which every v has dim components: the int8 codes in v's place, with scale and norms."""
    for batch in batches:
        dims = batch.column(2).to_numpy()
        for dim in np.unique(dims).tolist():
            rows = batch.filter(pa.array(dims == dim))
            for at in range(0, rows.num_rows, 2048):
                part = rows.slice(at, 2048)
                x = part.column(4).flatten().to_numpy().reshape(-1, dim)
                codes, scale, norm, error = _quantised(x)
                data = codes.tobytes()
                yield pa.record_batch([*part.columns[:4], pa.array([data[i : i + dim] for i in range(0, len(data), dim)], pa.binary()), *map(pa.array, (scale, norm, error))], ["n", "vec_id", "dim", "query", "code", "scale", "norm", "error"])


def tile(q: tuple[np.ndarray, ...], c: tuple[np.ndarray, ...], k: int, known: np.ndarray) -> Iterator[tuple[np.ndarray, ...]]:
    """(query's row, candidate's row, lower, upper) of the pairs that may be among a query's k nearest in the tile.

    q and c are (vec_id, codes, scale, norm of the coded vector, norm of what coding leaves); known has what k others reach at least, for each query.
    """
    qid, q8, qs, qn, qe = q
    cid, c8, cs, cn, ce = c
    c8 = c8.astype(np.float32).T
    for at in range(0, len(qid), _ROWS):
        rows = slice(at, at + _ROWS)
        near = np.zeros((len(qid[rows]), len(cid)))
        for s in range(0, c8.shape[0], SLAB):
            near += q8[rows, s : s + SLAB].astype(np.float32) @ c8[s : s + SLAB]
        near *= qs[rows, None] * cs[None, :]
        error = qe[rows, None] * cn[None, :] + (qn[rows, None] + qe[rows, None]) * ce[None, :] + 1e-6
        near[cid[None, :] == qid[rows, None]] = -np.inf
        n = min(k, len(cid))
        floor = np.maximum(-np.partition(error - near, n - 1, axis=1)[:, n - 1], known[rows])
        i, j = np.nonzero((near + error >= floor[:, None]) & (near > -np.inf))
        yield at + i, j, near[i, j] - error[i, j], near[i, j] + error[i, j]


def _tiles(k: int):
    """Over the coded rows of one tile: its surviving pairs (q, query_id, c, lower, upper) by row numbers."""

    def run(t: pa.Table) -> pa.Table:
        is_q = t["query"].to_numpy()
        code = np.frombuffer(b"".join(t["code"].to_pylist()), np.int8).reshape(len(is_q), -1)
        columns = [t["vec_id"].to_numpy(), code, *(t[x].to_numpy() for x in ("scale", "norm", "error"))]
        number, found = t["n"].to_numpy(), []
        q, c = tuple(x[is_q] for x in columns), tuple(x[~is_q] for x in columns)
        if len(q[0]) and len(c[0]):
            known = t["floor"].to_numpy()[is_q]
            found = [(number[is_q][i], q[0][i], number[~is_q][j], low, high) for i, j, low, high in tile(q, c, k, known)]
        out = [np.concatenate(x) for x in zip(*found)] if found else [np.zeros(0, d) for d in (np.int64, np.int64, np.int64, float, float)]
        return pa.table(dict(zip(("q", "query_id", "c", "lower", "upper"), map(pa.array, out))))

    return run


def _heaped(k: int):
    """Over rows (query_id, vec_id, score) in the order of query_id: each query's k best with their ranks, ties to the smaller vec_id."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, heap, done = None, [], []

        def close() -> None:
            done.extend((now, rank, -v, s) for rank, (s, v) in enumerate(sorted(heap, reverse=True), 1))

        def out() -> pa.RecordBatch:
            rows = pa.record_batch([pa.array(x, t) for x, t in zip(zip(*done) if done else [()] * 4, (pa.int64(), pa.int32(), pa.int64(), pa.float64()))], ["query_id", "rank", "vec_id", "score"])
            done.clear()
            return rows

        for batch in batches:
            for query, vec, score in zip(*(c.to_pylist() for c in batch.columns)):
                if query != now:
                    if heap:
                        close()
                    now, heap = query, []
                (heapq.heappush if len(heap) < k else heapq.heappushpop)(heap, (score, -vec))
            if len(done) >= 10_000:
                yield out()
        if heap:
            close()
        yield out()

    return run


def nearest(vectors: DataFrame, is_query: Column, k: int = 5, vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): each query's k nearest by cosine, all other rows being candidates.

    Exact: the int8 bounds only drop pairs that cannot be among the k. Vectors are compared with those of
    their own dimension, however long. Rows that repeat an id are candidates of their own but never of a query with
    that id; a query that repeats is answered once. Fewer candidates than k: all; ties to the smaller id. No usable
    vectors: no rows. Columns other than the two named count for is_query alone.
    """
    spark = vectors.sparkSession
    v = written(usable(vectors, vec_id, embedding, is_query).withColumn("n", F.monotonically_increasing_id()), "vectors")
    coded = v.select("n", "vec_id", "dim", "query", "v")
    coded = written(coded.mapInArrow(_coded, "n long, vec_id long, dim int, query boolean, code binary, scale double, norm double, error double"), "codes")
    queries = coded.where("query").dropDuplicates(["vec_id"])
    # Of equal vectors only the first in the order of ids can be among a query's k: k rows of an id, and 2 k in all, so that k are left without the query's own.
    alike = v.select("n", "vec_id", F.xxhash64("v").alias("h"), F.xxhash64(F.lit(1), "v").alias("g"))
    alike = alike.withColumn("i", F.row_number().over(Window.partitionBy("h", "g", "vec_id").orderBy("n"))).where(F.col("i") <= k)
    alike = alike.withColumn("j", F.row_number().over(Window.partitionBy("h", "g").orderBy("vec_id", "n"))).where(F.col("j") <= 2 * k)
    others = written(coded.join(alike.select("n"), "n", "left_semi"), "candidates")
    n_query, n_all = queries.count(), coded.count()
    most = lambda n, blocks: max(1, math.ceil(n / BLOCK), min(blocks, n // LEAST))
    nc = most(n_all, partitions(spark))
    nq = most(n_query, partitions(spark) // nc)
    block = lambda n: F.pmod(F.xxhash64("n", F.lit(7)), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    held = [F.col(c) for c in ("n", "vec_id", "code", "scale", "norm", "error")]
    lowest = F.lit(float("-inf"))

    def survivors(asked: DataFrame, first: int, stop: int) -> DataFrame:
        """The pairs that survive in the tiles with blocks of candidates from first to stop."""
        q = asked.select("dim", block(nq).alias("qb"), F.explode(F.sequence(F.lit(first), F.lit(stop - 1))).alias("cb"), F.lit(True).alias("query"), "floor", *held)
        c = others.select("dim", every(nq).alias("qb"), block(nc).alias("cb"), F.lit(False).alias("query"), lowest.alias("floor"), *held).where(F.col("cb").between(first, stop - 1))
        return written(q.unionByName(c).groupBy("dim", "qb", "cb").applyInArrow(_tiles(k), "q long, query_id long, c long, lower double, upper double"), "survivors")

    # What k pairs of a query reach at least; below it no other pair counts. The first block of candidates tells enough to keep the others' survivors few.
    def reached(found: DataFrame) -> DataFrame:
        return found.withColumn("place", F.row_number().over(Window.partitionBy("q").orderBy(F.desc("lower")))).where(F.col("place") == k).select("q", F.col("lower").alias("floor"))

    found = survivors(queries.withColumn("floor", lowest), 0, 1)
    if nc > 1:
        asked = queries.join(reached(found).withColumnRenamed("q", "n"), "n", "left").withColumn("floor", F.coalesce("floor", lowest))
        found = found.unionByName(survivors(asked, 1, nc))
    kth = reached(found)
    left = found.join(kth, "q", "left").where("floor is null or upper >= floor").select("q", "query_id", "c")

    @F.pandas_udf("double")
    def score(a: pd.Series, b: pd.Series) -> pd.Series:
        out, dims = np.zeros(len(a)), a.map(len).to_numpy()
        for dim in np.unique(dims):
            at = np.flatnonzero(dims == dim)
            for i in range(0, len(at), 1024):
                part = at[i : i + 1024]
                out[part] = cosines(np.stack(a.iloc[part].to_list()), np.stack(b.iloc[part].to_list()))
        return pd.Series(out)

    own = lambda number, name: v.select(F.col("n").alias(number), F.col("v").alias(name))
    both = left.join(own("q", "x"), "q").join(v.select(F.col("n").alias("c"), "vec_id", F.col("v").alias("y")), "c")
    scored = both.select("query_id", "vec_id", score("x", "y").alias("score"))
    return scored.repartition(partitions(spark), "query_id").sortWithinPartitions("query_id").mapInArrow(_heaped(k), "query_id long, rank int, vec_id long, score double")


def op8_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 5 nearest of every vector whose id is divisible by 50."""
    return nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


ORACLE = """
WITH e AS (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, list_cosine_similarity(q.v, c.v) AS score FROM e q JOIN e c ON q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INT AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""
