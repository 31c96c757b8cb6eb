"""SimHash near-dedup by covering locality-sensitive hashing.

Fingerprints of 64 bits are linked when they differ in few bits. Structured bit masks (one for every
nonzero vector of r+1 bits) make sure that any two fingerprints within r bits agree on all compared
bits of at least one mask, so no link is lost; every collision is verified on the full fingerprints.
"""

from __future__ import annotations

import random
from collections import deque
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType, _parse_datatype_string

from corpusloom.llm import setjoin
from corpusloom.llm.common import fresh, partitions, released, small_batches, table, written
from corpusloom.llm.graph import connected_components
from corpusloom.llm.words import shingles, words_of

BITS = 64
#: A bucket of up to so many different fingerprints is searched in one task; larger ones go the way of midpoints.
BUCKET_ROWS = 32_768
#: Of buckets with up to so many fingerprints all links are returned, of larger ones a spanning forest.
ALL_LINKS = 8
#: Parts of each table, for a first count; times the number of masks they bound what is broadcast of them.
COARSE = 4096
#: Keys of large buckets are broadcast up to so many; beyond that they are joined by a shuffle.
BROADCAST_KEYS = 50_000
#: Rows that go are broadcast up to so many; beyond that they are joined by a shuffle.
BROADCAST_ROWS = 1_000_000
#: Near duplicates share 0.8 of their shingles of so many words.
SHINGLE = 5
#: Texts whose fingerprints over different words are within so many bits are compared first; most near duplicates are.
WORD_RADIUS = 4
#: Buckets of one prefix shingle with more texts than this are compared in parts of so many, each two in a task of their own.
LARGE = 4096
#: Texts whose shingle sets are compared come in blocks of so many.
BLOCK = 128
#: Texts that are fingerprinted at once.
AT_ONCE = 256


def _majority(features: Iterator[list[bytes]], seed: int) -> int:
    """Bit i is set if it is set in over half the features' XXH64; no features: 0."""
    counts, total = np.zeros(BITS, np.int64), 0
    for part in features:
        h = np.fromiter((xxhash.xxh64_intdigest(s, seed) for s in part), np.uint64, len(part))
        counts += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
        total += len(part)
    return int(np.packbits(counts * 2 > total, bitorder="little").view(np.uint64)[0])


def simhash(text: str | None, size: int = 4, seed: int = 42) -> int:
    """Of all shingles, repeats included, 8192 at a time, so that a very long text needs little memory for them."""
    words = words_of(text)
    last = max(len(words) - size + 1, 1)
    return _majority((shingles(words[at : min(at + 8192, last) + size - 1], size) for at in range(0, last, 8192)), seed)


def simhash_of_words(text: str | None, seed: int = 42) -> int:
    """Of the different words. It moves far less under small edits than that of shingles."""
    words = list(set(words_of(text)))
    return _majority((words[at : at + 8192] for at in range(0, len(words), 8192)), seed)


def with_fingerprint(docs: DataFrame, text: str = "text", out: str = "fp", size: int | None = 4) -> DataFrame:
    """docs and the SimHash of each whole text as a signed long, of shingles or (no size) of words; null and wordless texts have 0."""

    @F.arrow_udf("long")
    def fingerprint(texts: pa.Array) -> pa.Array:
        return pa.array(np.array([simhash(t.as_py(), size) if size else simhash_of_words(t.as_py()) for t in texts], np.uint64).view(np.int64))

    return docs.withColumn(out, fingerprint(F.col(text)))


def covering_masks(radius: int) -> list[int]:
    """2^(radius+1)-1 masks over the bits of a fingerprint.

    Bit i has a nonzero vector m(i) of radius+1 bits; mask v compares the bits where v and m(i) have an odd
    product. radius vectors never span all radius+1 dimensions, so for any radius bits some v leaves all out.
    Which vectors the bits have does not matter for that; they are chosen so that no mask compares few bits.
    """
    n = 2 ** (radius + 1) - 1

    def masks(vectors: list[int]) -> list[int]:
        return [sum(1 << i for i, m in enumerate(vectors) if (v & m).bit_count() % 2) for v in range(1, n + 1)]

    if n <= BITS:
        return masks([1 + i % n for i in range(BITS)])
    return max((masks(random.Random(seed).sample(range(1, n + 1), BITS)) for seed in range(40)), key=lambda found: min(m.bit_count() for m in found))


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _bucket_links(fps: np.ndarray, radius: int) -> list[tuple[int, int]]:
    """Links within one bucket: all of them in a small one, else the edges of a breadth-first forest."""
    x = fps.view(np.uint64)
    if len(x) <= ALL_LINKS:
        i, j = np.nonzero(np.triu(np.bitwise_count(x[:, None] ^ x[None, :]) <= radius, 1))
        return list(zip(fps[i].tolist(), fps[j].tolist()))
    # The search begins nearest to the bucket's majority, so that the tables give a dense group much the same edges.
    counts = sum(np.unpackbits(x[at : at + 8192].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64) for at in range(0, len(x), 8192))
    middle = np.packbits(counts * 2 > len(x), bitorder="little").view(np.uint64)[0]
    out, rest = [], np.lexsort((x, np.bitwise_count(x ^ middle)))
    while len(rest):
        queue, rest = deque([rest[0]]), rest[1:]
        while queue and len(rest):
            at = queue.popleft()
            near = np.bitwise_count(x[rest] ^ x[at]) <= radius
            if near.any():
                found, rest = rest[near], rest[~near]
                out += [(int(fps[at]), f) for f in fps[found].tolist()]
                queue.extend(found.tolist())
    return out


def _scan(radius: int, masks: list[int]):
    """Over rows (t, f) sorted by table and key, which is f under the table's mask: the links of each run of equal table and key."""
    compared = np.array([_signed(m) for m in masks], np.int64)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: tuple[np.ndarray, ...] | None = None
        seen: set[tuple[int, int]] = set()

        def ready(t: np.ndarray, k: np.ndarray, f: np.ndarray) -> None:
            cut = np.flatnonzero(np.r_[True, (t[1:] != t[:-1]) | (k[1:] != k[:-1])])
            size = np.diff(np.r_[cut, len(t)])
            two = cut[size == 2]
            near = np.bitwise_count(f[two].view(np.uint64) ^ f[two + 1].view(np.uint64)) <= radius
            seen.update(zip(f[two[near]].tolist(), f[two[near] + 1].tolist()))
            for at, n in zip(cut[size > 2].tolist(), size[size > 2].tolist()):
                seen.update(_bucket_links(f[at : at + n], radius))

        def out() -> pa.RecordBatch:
            a, b = zip(*seen) if seen else ((), ())
            seen.clear()
            return pa.record_batch([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

        for batch in batches:
            if not batch.num_rows:
                continue
            t, f = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            now = (t, f & compared[t], f)
            t, k, f = now if held is None else tuple(np.concatenate(x) for x in zip(held, now))
            last = len(t) - 1 - int(np.argmax(np.r_[((t != t[-1]) | (k != k[-1]))[::-1], True]))
            if last + 1:
                ready(t[: last + 1], k[: last + 1], f[: last + 1])
            held = tuple(x[last + 1 :] for x in (t, k, f))
            if len(seen) >= 100_000:
                yield out()
        if held is not None:
            ready(*held)
        yield out()

    return scan


def _midpoint_links(hot: DataFrame, masks: list[int], radius: int) -> DataFrame:
    """Links within large buckets without comparing pairs.

    Two fingerprints within radius bits meet at a midpoint that is at most ceil(radius/2) flips from one and
    floor(radius/2) from the other. A midpoint has at most as many fingerprints as there are such flips, so
    groups are bounded whatever the size of the bucket.
    """
    spark, most, least = hot.sparkSession, (radius + 1) // 2, radius // 2
    flips = [(t, n, _signed(sum(1 << i for i in c))) for t, m in enumerate(masks) for n in range(most + 1) for c in combinations([i for i in range(BITS) if not m >> i & 1], n)]
    flips = spark.createDataFrame(pa.table(dict(zip(("t", "n", "flip"), map(pa.array, zip(*flips))))), "t short, n short, flip long")
    met = hot.join(F.broadcast(flips), "t").groupBy("t", F.col("f").bitwiseXOR(F.col("flip")).alias("mid"))
    met = met.agg(F.sort_array(F.collect_set(F.struct("n", "f"))).alias("m")).where(F.size("m") > 1)
    link = met.where(F.col("m")[0]["n"] <= least).select(F.col("m")[0]["f"].alias("a"), F.explode(F.slice("m", 2, 1 << 30)).alias("x"))
    return link.select(F.least("a", "x.f").alias("a"), F.greatest("a", "x.f").alias("b")).distinct()


def links_within(fps: DataFrame, radius: int, fp: str = "fp") -> DataFrame:
    """Links (a, b) between different fingerprints that join all those within radius bits.

    Pairs are verified over all bits. Duplicate and null fingerprints do not matter; no fingerprints, no links.
    """
    spark, masks = fps.sparkSession, covering_masks(radius)
    f = fps.select(F.col(fp).alias("f")).where("f is not null").distinct()
    key = F.col("f").bitwiseAND(F.element_at(F.array(*[F.lit(_signed(m)) for m in masks]), F.col("t") + 1))
    rows = f.select(F.explode(F.array(*[F.lit(t).cast("short") for t in range(len(masks))])).alias("t"), "f")
    # Large buckets are looked for in COARSE parts of each table first: few rows, and mostly none is crowded.
    part = F.pmod(F.xxhash64(key), F.lit(COARSE)).cast("short").alias("h")
    crowded = written(rows.groupBy("t", part).count().where(F.col("count") > BUCKET_ROWS).select("t", "h"), "crowded")
    extra = None
    if not crowded.isEmpty():
        keyed = rows.select("t", "f", key.alias("key"))
        within = keyed.select("t", "key", F.pmod(F.xxhash64("key"), F.lit(COARSE)).cast("short").alias("h")).join(F.broadcast(crowded), ["t", "h"], "left_semi")
        large = written(within.groupBy("t", "key").count().where(F.col("count") > BUCKET_ROWS).select("t", "key"), "buckets")
        known = large.count()
        if known:
            keys = F.broadcast(large) if known <= BROADCAST_KEYS else large
            extra = _midpoint_links(keyed.join(keys, ["t", "key"], "left_semi"), masks, radius)
            rows = keyed.join(keys, ["t", "key"], "left_anti").select("t", "f")
    # The key is not shuffled: both sides work it out from f.
    rows = rows.repartition(partitions(spark), "t", key).sortWithinPartitions("t", key)
    found = rows.mapInArrow(released(_scan(radius, masks)), "a long, b long").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    return found if extra is None else found.unionByName(extra)


def near_duplicates(docs: DataFrame, radius: int = 4, size: int = 4, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, fingerprint, component_id) for every row of docs.

    component_id is the least doc_id that links of at most radius bits lead to, itself included. Null and
    wordless texts have fingerprint zero and are linked like any other; repeated rows come out as often as
    they went in; a null doc_id is never the least unless a component has no other. Extra columns are ignored.
    """
    fp = written(with_fingerprint(docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("t")), "t", "fp", size).select("doc_id", "fp"), "fingerprints")
    distinct = written(fp.groupBy("fp").agg(F.min("doc_id").alias("least")), "distinct")
    roots = connected_components(links_within(distinct, radius)).withColumnRenamed("node", "fp")
    of = distinct.join(roots, "fp", "left").select("fp", F.coalesce("root", "fp").alias("root"), "least")
    of = written(of, "roots")
    ids = of.groupBy("root").agg(F.min("least").alias("component_id"))
    of = written(of.join(ids, "root").select("fp", "component_id"), "components")
    return fp.join(of, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def _fingerprints(similarity: float, common: np.ndarray):
    """Over rows (doc_id, key, t): doc_id, key, SimHash of the different words, number of shingles and prefix."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, AT_ONCE):
                batch = whole.slice(at, AT_ONCE)
                texts = batch.column(2).to_pylist()
                found = [setjoin.shingle_hashes(words_of(t), SHINGLE) for t in texts]
                fp = pa.array(np.array([simhash_of_words(t) for t in texts], np.uint64).view(np.int64))
                sizes, prefixes = pa.array([len(x) for x in found], pa.int32()), pa.array([setjoin.prefix(x, common, similarity) for x in found], pa.list_(pa.int64()))
                yield pa.record_batch([batch.column(0), batch.column(1), fp, sizes, prefixes], ["doc_id", "key", "fp", "n_shingles", "prefix"])

    return run


def _superfluous(docs: DataFrame, radius: int, similarity: float, doc_id: str, held: Column) -> tuple[DataFrame, DataFrame]:
    """(id, key) of the rows that go, and of those that repeat in both; id is doc_id as text and key the MD5 of the text."""
    texts = docs.select(F.col(doc_id).alias("doc_id"), F.md5(held).alias("key"), held.alias("t"))
    rows = texts.select("doc_id", "key")
    schema = StructType([StructField("doc_id", docs.schema[doc_id].dataType), *_parse_datatype_string("key string, fp long, n_shingles int, prefix array<long>").fields])
    told = texts.mapInArrow(released(_fingerprints(similarity, setjoin.common_shingles(texts, SHINGLE))), schema)
    nodes = told.groupBy("key").agg(F.min("doc_id").alias("least"), F.count("*").alias("n"), *[F.first(c).alias(c) for c in ("fp", "n_shingles", "prefix")])
    # The number is given once, when the table is written.
    nodes = written(nodes.withColumn("node", F.monotonically_increasing_id()), "nodes")
    # Of each fingerprint one text stands for it; links between fingerprints are links between those, and the others are linked with theirs.
    values = written(nodes.groupBy("fp").agg(F.min("node").alias("first")), "values")
    value = lambda c: values.select(F.col("fp").alias(f"fp_{c}"), F.col("first").alias(c))
    near = links_within(values, radius).select(F.col("a").alias("fp_a"), F.col("b").alias("fp_b")).join(value("a"), "fp_a").join(value("b"), "fp_b").select("a", "b")
    same = nodes.select("node", "fp").join(values, "fp").where("node != first").select(F.col("first").alias("a"), F.col("node").alias("b"))
    roots = setjoin.joined(written(near.unionByName(same).distinct(), "near"), nodes, texts, setjoin.Rule(SHINGLE, similarity, LARGE, BLOCK))
    group = written(nodes.join(roots, "node", "left").select("key", "node", "least", "n", F.coalesce("root", "node").alias("root")), "groups")
    order = F.struct(F.col("least").isNull(), "least", "node")
    best = written(group.groupBy("root").agg(F.min(order).alias("best")).select("root", F.col("best.node").alias("stays")), "best")
    kept = written(group.join(best, "root").select("key", "least", "n", (F.col("node") == F.col("stays")).alias("kept")), "kept")
    # Only what goes is listed: rows of texts that go, and of texts that stay the copies with other ids.
    gone = rows.select("doc_id", "key").join(kept.where("not kept or n > 1"), "key").where(~F.col("kept") | ~F.col("doc_id").eqNullSafe(F.col("least")))
    gone = written(gone.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("null")).alias("id"), "key").distinct(), "gone")
    repeats = written(rows.groupBy("doc_id", "key").count().where("count > 1").select(F.coalesce(F.col("doc_id").cast("string"), F.lit("null")).alias("id"), "key"), "repeats")
    return gone, repeats


def deduplicate(docs: DataFrame, radius: int = WORD_RADIUS, similarity: float = 0.8, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """docs without near duplicates: of each group the row with the least doc_id stays, with all its columns.

    Links are equal texts, and texts whose 5-word shingles have a Jaccard index of at least `similarity` (above 0). All
    such links count. First texts are compared whose SimHash over different words is within `radius` bits, by covering
    masks: that joins most groups. Then all other pairs that can be similar are compared: those from different groups
    that share a shingle of their prefixes. So radius decides the work and not the result. Groups are what links join.

    A null text is empty, and two texts without words are equal; a very long text counts as a whole. A null doc_id never
    comes before one that is not null; of rows that repeat in doc_id and text one stays. No rows, no rows.
    """
    key, ident = fresh(docs, "_key", "_id")
    held = F.coalesce(F.col(text), F.lit(""))
    with small_batches(docs.sparkSession):
        gone, repeats = _superfluous(docs, radius, similarity, doc_id, held)
    listed = lambda t: F.broadcast(t) if t.count() <= BROADCAST_ROWS else t
    marked = docs.withColumns({ident: F.coalesce(F.col(doc_id).cast("string"), F.lit("null")), key: F.md5(held)})
    named = lambda t: t.select(F.col("id").alias(ident), F.col("key").alias(key))
    out = marked.join(listed(named(gone)), [ident, key], "left_anti")
    if not repeats.isEmpty():
        twice = listed(named(repeats))
        out = out.join(twice, [ident, key], "left_anti").unionByName(out.join(twice, [ident, key], "left_semi").dropDuplicates([ident, key]))
    return out.select(*docs.columns)


def op9_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of all documents over 4-word shingles, linked at 4 or fewer differing bits."""
    return near_duplicates(table(spark, sf_dir, "documents"), radius=4, size=4)
