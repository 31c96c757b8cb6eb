"""Target-distribution importance resampling over bucket-partitioned inverted postings.

Features (runs of words) are hashed into buckets. Postings (bucket, document, count) are shuffled to the range of
buckets that they belong to, where they meet the totals of both corpora: there the gain of each bucket is worked out and
postings become contributions, which are added up by document. Documents are numbered within chunks, so that a chunk's
postings of one range are one row of packed numbers; ranges are dealt in slices, so a bucket that all documents share
is spread over many tasks.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.llm.common import forget, fresh, partitions, positioned, released, small_reads, table, written
from corpusloom.llm.words import BEYOND_ASCII, DIGITS, LETTERS, blanks, runs

#: Features are hashed into so many buckets.
BUCKETS = 10_000
#: Buckets are shuffled in so many ranges (or more, where a range would hold over 65,536).
RANGES = 32
#: A chunk of documents ends with so many of them, or so many bytes.
CHUNK_ROWS, CHUNK_BYTES = 1024, 4 << 20
#: A row of postings has 150 KB or so: that many are read at once, and a row group ends with so many bytes.
POSTING_ROWS, POSTING_GROUP = 64, 16 << 20
#: Words are runs of letters, digits and all that is not ASCII.
_TABLE = blanks(LETTERS + DIGITS + BEYOND_ASCII)


def buckets_of(text: bytes | None, longest: int = 2, buckets: int = BUCKETS) -> tuple[int, np.ndarray]:
    """The number of words, and how often each bucket is hit by runs of 1 to `longest` consecutive words joined by one space."""
    n_words, counts, before, crc = 0, np.zeros(buckets, np.int64), [], zlib.crc32
    for words in runs(text, _TABLE):
        found = []
        for w in words:
            ends = [crc(w), *[crc(w, e) for e in before]]
            found += ends
            before = [crc(b" ", e) for e in ends[: longest - 1]]
        n_words += len(words)
        counts += np.bincount(np.fromiter(found, np.uint32, len(found)) % buckets, minlength=buckets)
    return n_words, counts


def _ranges(buckets: int) -> tuple[int, int]:
    """(number of ranges, buckets in each)."""
    n = max(min(RANGES, buckets), -(-buckets // 65_536))
    return n, -(-buckets // n)


_POSTINGS = "chunk long, part int, n_docs int, bucket binary, doc binary, hits binary"


def _postings(longest: int, buckets: int, width: int, ids: pa.DataType):
    """Over rows (id, text): for each chunk a row with its documents (part -1) and one for each range of buckets with its packed postings."""
    names = ["chunk", "part", "n_docs", "bucket", "doc", "hits", "ids", "n_words", "n_features"]
    types = [pa.int64(), pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.binary(), pa.list_(ids), pa.list_(pa.int64()), pa.list_(pa.int64())]

    def chunk(number: int, of: list, n_words: list[int], found: list[tuple[np.ndarray, np.ndarray]]) -> pa.RecordBatch:
        bucket, hits = (np.concatenate(x) for x in zip(*found))
        doc = np.repeat(np.arange(len(found)), [len(h) for h, _ in found])
        order = np.argsort(bucket, kind="stable")
        bucket, doc, hits = bucket[order], doc[order], hits[order]
        cut = np.searchsorted(bucket, np.arange(0, buckets + width, width))
        rows = [(number, -1, len(of), None, None, None, of, n_words, [int(c.sum()) for _, c in found])]
        for part, (a, b) in enumerate(zip(cut, cut[1:])):
            if a < b:
                packed = (bucket[a:b] - part * width).astype(np.uint16), doc[a:b].astype(np.uint16), hits[a:b].astype(np.uint32)
                rows.append((number, part, len(of), *(x.tobytes() for x in packed), None, None, None))
        return pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows), types)], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, of, n_words, found, size = TaskContext.get().partitionId() << 32, [], [], [], 0
        for batch in batches:
            texts = batch.column(1).cast(pa.binary())
            for i, key in enumerate(batch.column(0).to_pylist()):
                text = texts[i].as_py()
                words, counts = buckets_of(text, longest, buckets)
                hit = np.flatnonzero(counts)
                found.append((hit, counts[hit]))
                of.append(key)
                n_words.append(words)
                size += len(text or b"")
                if len(of) == CHUNK_ROWS or size >= CHUNK_BYTES:
                    yield chunk(number, of, n_words, found)
                    number, of, n_words, found, size = number + 1, [], [], [], 0
        if of:
            yield chunk(number, of, n_words, found)

    return run


def _totals(buckets: int, width: int):
    """Over rows (part, bucket, hits): how often each bucket is hit in all of them, as rows (bucket, n)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            for part, bucket, hits in zip(*(c.to_pylist() for c in batch.columns)):
                np.add.at(total, np.frombuffer(bucket, np.uint16).astype(np.int64) + part * width, np.frombuffer(hits, np.uint32))
        hit = np.flatnonzero(total)
        yield pa.record_batch([pa.array(hit, pa.int32()), pa.array(total[hit])], ["bucket", "n"])

    return run


def gains(s: np.ndarray, t: np.ndarray, all_s: int, all_t: int, buckets: int) -> np.ndarray:
    """1000 times the log ratio of each bucket's smoothed shares in target and source, rounded down."""
    up, down = float(all_s + buckets), float(all_t + buckets)
    return np.array([math.floor(1000 * math.log((b + 1) * up / ((a + 1) * down))) for a, b in zip(s.tolist(), t.tolist())], np.int64)


def _contributions(all_s: int, all_t: int, buckets: int, width: int):
    """Over rows sorted by range and slice, totals (s, t) first: the gain of each bucket, then for each chunk what its documents get from this range."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, s, t, gain = None, None, None, None
        for batch in batches:
            out = []
            for part, piece, bucket_no, n_s, n_t, chunk, n_docs, bucket, doc, hits in zip(*(c.to_pylist() for c in batch.columns)):
                if (part, piece) != at:
                    at, s, t, gain = (part, piece), np.zeros(width, np.int64), np.zeros(width, np.int64), None
                if chunk is None:
                    s[bucket_no - part * width], t[bucket_no - part * width] = n_s, n_t
                    continue
                if gain is None:
                    gain = gains(s, t, all_s, all_t, buckets)
                got = np.zeros(n_docs, np.int64)
                np.add.at(got, np.frombuffer(doc, np.uint16), gain[np.frombuffer(bucket, np.uint16)] * np.frombuffer(hits, np.uint32).astype(np.int64))
                out.append((chunk, got.tobytes()))
            if out:
                yield pa.record_batch([pa.array(c, k) for c, k in zip(zip(*out), (pa.int64(), pa.binary()))], ["chunk", "got"])

    return run


def _weights(ids: pa.DataType):
    """Over rows (chunk, got, ids, n_words, n_features) sorted by chunk, that with the documents first: a row for each document with its weight."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list | None = None

        def done() -> pa.RecordBatch:
            of, n_words, n, total = held
            n = np.array(n, np.int64)
            weight = np.where(n > 0, total // np.maximum(n, 1), 0)
            return pa.record_batch([pa.array(of, ids), pa.array(n_words, pa.int64()), pa.array(n), pa.array(weight)], ["id", "n_words", "n_features", "weight"])

        for batch in batches:
            for chunk, got, of, n_words, n in zip(*(c.to_pylist() for c in batch.columns)):
                if got is None:
                    if held is not None:
                        yield done()
                    held = [of, n_words, n, np.zeros(len(of), np.int64)]
                else:
                    held[3] += np.frombuffer(got, np.int64)
        if held is not None:
            yield done()

    return run


def weighed(docs: DataFrame, target: DataFrame, doc_id: str = "doc_id", text: str = "text", target_text: str = "text", longest: int = 2, buckets: int = BUCKETS) -> DataFrame:
    """(id, n_words, n_features, weight) for every row of docs: the mean gain of its features, rounded down; without features 0.

    A null text is empty, texts of any length count as a whole, rows that repeat each count and come out each, and other
    columns play no part. An empty target or empty docs have no counts; no rows, no rows.
    """
    from pyspark.sql.pandas.types import to_arrow_type

    spark = docs.sparkSession
    kind = docs.schema[doc_id].dataType
    n_ranges, width = _ranges(buckets)
    schema = lambda k: f"{_POSTINGS}, ids array<{k}>, n_words array<long>, n_features array<long>"
    with small_reads(spark, 256):
        held = written(docs.select(doc_id, text).mapInArrow(released(_postings(longest, buckets, width, to_arrow_type(kind))), schema(kind.simpleString())), "postings", POSTING_GROUP)
        other = written(target.select(F.lit(0).alias("id"), target_text).mapInArrow(released(_postings(longest, buckets, width, pa.int32())), schema("int")), "target", POSTING_GROUP)
    one = lambda df, name: df.where("part >= 0").select("part", "bucket", "hits").mapInArrow(released(_totals(buckets, width)), "bucket int, n long").select("bucket", *[(F.col("n") if c == name else F.lit(0).cast("long")).alias(c) for c in "st"])
    with small_reads(spark, POSTING_ROWS):
        totals = written(one(held, "s").unionByName(one(other, "t")).groupBy("bucket").agg(F.sum("s").alias("s"), F.sum("t").alias("t")), "totals")
    all_s, all_t = totals.agg(F.coalesce(F.sum("s"), F.lit(0)), F.coalesce(F.sum("t"), F.lit(0))).first()
    # A range meets its totals in every one of its slices; a range has at most `width` of them.
    n = partitions(spark)
    slices = totals.select(F.floor(F.col("bucket") / width).cast("int").alias("part"), F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("piece"), F.col("bucket").alias("bucket_no"), "s", "t", *[F.lit(None).cast(t).alias(c) for c, t in (("chunk", "long"), ("n_docs", "int"), ("bucket", "binary"), ("doc", "binary"), ("hits", "binary"))])
    rows = held.where("part >= 0").select("part", F.pmod(F.xxhash64("chunk"), F.lit(n)).cast("int").alias("piece"), *[F.lit(None).cast(t).alias(c) for c, t in (("bucket_no", "int"), ("s", "long"), ("t", "long"))], "chunk", "n_docs", "bucket", "doc", "hits")
    met = slices.unionByName(rows).repartition(n, "part", "piece").sortWithinPartitions("part", "piece", F.col("chunk").asc_nulls_first())
    got = met.mapInArrow(released(_contributions(all_s, all_t, buckets, width)), "chunk long, got binary")
    info = held.where("part < 0").select("chunk", F.lit(None).cast("binary").alias("got"), "ids", "n_words", "n_features")
    both = info.unionByName(got.select("chunk", "got", *[F.lit(None).cast(held.schema[c].dataType).alias(c) for c in ("ids", "n_words", "n_features")]))
    both = both.repartition(n, "chunk").sortWithinPartitions("chunk", F.col("got").isNotNull())
    with small_reads(spark, POSTING_ROWS):
        out = written(both.mapInArrow(released(_weights(to_arrow_type(kind))), f"id {kind.simpleString()}, n_words long, n_features long, weight long"), "weights")
    forget(held, other, totals)
    return out


def gumbel(ident: Column, seed: int) -> Column:
    """1000 times a Gumbel number, rounded down, that the id and the seed decide; a null id counts as `null`."""
    key = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(ident.cast("string"), F.lit("null"))), 256)
    share = (F.conv(F.substring(key, 1, 8), 16, 10).cast("double") + 0.5) / 4294967296
    return F.floor(-1000 * F.log(-F.log(share)))


def resampled(docs: DataFrame, target: DataFrame, percent: int = 25, least_words: int = 20, seed: int = 7, longest: int = 2, buckets: int = BUCKETS, doc_id: str = "doc_id", text: str = "text", target_text: str = "text") -> DataFrame:
    """(doc_id, n_features, weight, score, rank) for every row of docs; rank, from 1, is null where the row is not drawn.

    Of the N rows with at least `least_words` words floor(percent * N / 100) are drawn, without replacement, those with the
    highest weight plus Gumbel number; ties go to the smaller id, null ids last. Rows that repeat are rows of their own, and get
    ranks that follow one another. Other rules are those of `weighed`.
    """
    w = weighed(docs, target, doc_id, text, target_text, longest, buckets)
    scored = w.select(F.col("id").alias("doc_id"), "n_words", "n_features", "weight", (F.col("weight") + gumbel(F.col("id"), seed)).cast("long").alias("score"))
    able = F.col("n_words") >= least_words
    draw = scored.where(able).count() * percent // 100
    placed = positioned(scored.where(able), [F.desc("score"), F.asc_nulls_last("doc_id")], "place")
    rank = F.when(F.col("place") < draw, F.col("place") + 1).cast("long")
    columns = ["doc_id", "n_features", "weight", "score"]
    return placed.select(*columns, rank.alias("rank")).unionByName(scored.where(~able).select(*columns, F.lit(None).cast("long").alias("rank")))


def op12_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents against all benchmark texts, a quarter drawn."""
    return resampled(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


#: CRC-32 (polynomial 0xEDB88320) byte by byte, its table of 256 numbers made by the rule.
ORACLE = r"""
WITH RECURSIVE steps AS (
  SELECT i AS b, i::BIGINT AS v, 0 AS k FROM range(256) r(i)
  UNION ALL SELECT b, CASE WHEN v & 1 = 1 THEN xor(v >> 1, 3988292384) ELSE v >> 1 END, k + 1 FROM steps WHERE k < 8),
crc AS (SELECT list(v ORDER BY b) AS tab FROM steps WHERE k = 8),
texts AS (
  SELECT 's' AS corpus, doc_id, coalesce(text, '') AS text FROM documents
  UNION ALL SELECT 't', item_id, coalesce(text, '') FROM benchmark),
worded AS (
  SELECT corpus, doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM texts),
features AS (
  SELECT corpus, doc_id, unnest(w) AS f FROM worded
  UNION ALL SELECT corpus, doc_id, unnest(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) FROM worded),
counted AS (SELECT corpus, doc_id, f, count(*) AS n FROM features GROUP BY ALL),
hashed AS (
  SELECT f, xor(list_reduce(list_transform(range(0, len(h) // 2), lambda i: ('0x' || h[2 * i + 1:2 * i + 2])::BIGINT), lambda a, x: xor(a >> 8, tab[xor(a & 255, x) + 1]), 4294967295::BIGINT), 4294967295::BIGINT) % 10000 AS bucket
  FROM (SELECT f, hex(encode(f)) AS h FROM counted GROUP BY f), crc),
postings AS (SELECT corpus, doc_id, bucket, sum(n) AS n FROM counted JOIN hashed USING (f) GROUP BY ALL),
sums AS (SELECT bucket, coalesce(sum(n) FILTER (corpus = 's'), 0)::DOUBLE AS s, coalesce(sum(n) FILTER (corpus = 't'), 0)::DOUBLE AS t FROM postings GROUP BY bucket),
whole AS (SELECT sum(s) AS a, sum(t) AS b FROM sums),
gain AS (SELECT bucket, floor(1000 * ln((t + 1) * (a + 10000) / ((s + 1) * (b + 10000))))::BIGINT AS g FROM sums, whole),
weights AS (SELECT doc_id, sum(n)::BIGINT AS n_features, floor(sum(n * g) / sum(n))::BIGINT AS weight FROM postings JOIN gain USING (bucket) WHERE corpus = 's' GROUP BY doc_id),
scored AS (
  SELECT w.doc_id, len(w.w) AS n_words, coalesce(n_features, 0) AS n_features, coalesce(weight, 0) AS weight,
    coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || substr(sha256('7:' || w.doc_id), 1, 8))::BIGINT + 0.5) / 4294967296)))::BIGINT AS score
  FROM worded w LEFT JOIN weights USING (doc_id) WHERE w.corpus = 's'),
ranked AS (SELECT *, row_number() OVER (PARTITION BY n_words >= 20 ORDER BY score DESC, doc_id) AS r, count(*) OVER (PARTITION BY n_words >= 20) AS n FROM scored)
SELECT doc_id, n_features, weight, score, CASE WHEN n_words >= 20 AND r <= 25 * n // 100 THEN r END AS rank FROM ranked
"""
