"""Exact similarity joins of texts' shingle sets, without a row for every candidate pair.

A cheap method (fingerprints, sketches) proposes links first; texts that they hold together stand together in blocks, and
blocks that a proposed link joins are compared exactly. What it has missed is found by prefixes: similar sets share
shingles among their first ones in a common order. Two texts of one group that may be similar only mark their two blocks, so
the rows that a dense group makes grow with its blocks and not with its pairs; texts of different groups are counted pair by pair.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.llm.common import forget, partitions, positioned, released, written
from corpusloom.llm.graph import connected_components
from corpusloom.llm.words import shingles, words_of

#: Texts that are wanted again are broadcast (by key) up to so many; beyond that they are joined by a shuffle.
BROADCAST_ROWS = 1_000_000
#: Shingles that COMMON_TEXTS texts of one in COMMON_SAMPLE have come last in prefixes, COMMON of them at most. This decides the work alone.
COMMON, COMMON_SAMPLE, COMMON_TEXTS = 200_000, 16, 3
#: Texts whose sets are worked out at once.
AT_ONCE = 256
#: Blocks hold fewer texts where sets are larger than this.
SET = 512


@dataclass(frozen=True)
class Rule:
    """Texts are similar if their sets of `size`-word shingles have a Jaccard index of at least `similarity`.

    Buckets of one prefix shingle with more texts than `large` are compared in parts; a block has `block` texts.
    """

    size: int
    similarity: float
    large: int = 4096
    block: int = 128


def shingle_hashes(words: list[bytes], size: int) -> np.ndarray:
    """The different shingles' XXH64 as signed longs, sorted as unsigned ones."""
    found = []
    for at in range(0, max(len(words) - size + 1, 1), 8192):
        part = shingles(words[at : at + 8192 + size - 1], size) if len(words) > size else shingles(words, size)
        found.append(np.unique(np.fromiter((xxhash.xxh64_intdigest(s, 42) for s in part), np.uint64, len(part))))
    return np.unique(np.concatenate(found)).view(np.int64)


def shingled(size: int):
    """Over rows whose last column is a text: the rows with its shingles' hashes in its place, AT_ONCE at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, AT_ONCE):
                batch = whole.slice(at, AT_ONCE)
                found = [shingle_hashes(words_of(t.as_py()), size) for t in batch.column(batch.num_columns - 1)]
                yield pa.record_batch([*batch.columns[:-1], pa.array(found, pa.list_(pa.int64()))], [*batch.schema.names[:-1], "shingles"])

    return run


def prefix(found: np.ndarray, common: np.ndarray, similarity: float) -> np.ndarray:
    """The first shingles in an order that all texts share: two sets of that similarity have one of these in common.

    common holds frequent shingles in unsigned order; they come last, which decides the work and not the result.
    No shingle at all has the prefix [0].
    """
    if not len(found):
        return np.zeros(1, np.int64)
    x, c = found.view(np.uint64), common.view(np.uint64)
    often = c[np.minimum(np.searchsorted(c, x), len(c) - 1)] == x if len(c) else np.zeros(len(x), bool)
    return found[np.argsort(often, kind="stable")][: len(x) - int(np.ceil(similarity * len(x) - 1e-6)) + 1]


def common_shingles(texts: DataFrame, size: int) -> np.ndarray:
    """Of texts (key, t): shingles that several texts of a sample by hash have, the most frequent COMMON of them at most."""
    some = texts.where(F.pmod(F.xxhash64("key"), F.lit(COMMON_SAMPLE)) == 0).dropDuplicates(["key"])
    each = some.select("t").mapInArrow(released(shingled(size)), "shingles array<long>").select(F.explode("shingles").alias("s")).groupBy("s").count().where(F.col("count") >= COMMON_TEXTS)
    rows = each.orderBy(F.desc("count"), "s").limit(COMMON).select("s").toPandas()["s"].to_numpy(np.int64)
    return np.unique(rows.view(np.uint64)).view(np.int64)


def _least(similarity: float, n: np.ndarray, m: np.ndarray) -> np.ndarray:
    """What similar sets of n and m shingles share at least."""
    return similarity / (1 + similarity) * (n + m) - 1e-6


def _may(similarity: float, n: np.ndarray, m: np.ndarray, p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Whether sets of n and m shingles may be similar that share one at the places p and q in their common order.

    Both must be large enough, and what can come before the shared shingle and after it must be enough.
    """
    enough = np.minimum(p, q) + np.minimum(n - p, m - q) >= _least(similarity, n, m)
    return (np.minimum(n, m) >= similarity * np.maximum(n, m) - 1e-6) & (enough | ((n == 0) & (m == 0)))


#: Columns of a prefix shingle's row: the shingle, its text and how many it has, its place, what the text is known to be linked with, its group and block.
_ROW = ("s", "node", "n", "pos", "label", "group", "block")
_FOUND = "kind int, " + ", ".join(f"x{k} long" for k in range(len(_ROW)))
_PAIR, _BLOCKS, _LARGE = range(3)


def _out(kind: int, *columns: np.ndarray) -> pa.RecordBatch:
    n = len(columns[0])
    held = [pa.array(c, pa.int64()) for c in columns] + [pa.nulls(n, pa.int64())] * (len(_ROW) - len(columns))
    return pa.record_batch([pa.array(np.full(n, kind), pa.int32()), *held], ["kind", *(f"x{k}" for k in range(len(_ROW)))])


class _Found:
    """Pairs of rows that may be similar: within a group the two blocks, else the pair, how often it met and how many prefix shingles it must share."""

    def __init__(self, similarity: float) -> None:
        self.similarity, self.pairs, self.blocks, self.n = similarity, [], [], 0

    def add(self, x: list[np.ndarray], y: list[np.ndarray], i: np.ndarray, j: np.ndarray) -> None:
        """Rows i of x and j of y (node, n, pos, label, group, block)."""
        own = x[4][i] == y[4][j]
        if own.any():
            a, b = x[5][i[own]], y[5][j[own]]
            self.blocks.append(np.unique(np.stack([np.minimum(a, b), np.maximum(a, b)], 1), axis=0))
        i, j = i[~own], j[~own]
        self.pairs.append((x[0][i], y[0][j], x[1][i], y[1][j]))
        self.n += len(i) + len(self.blocks[-1] if own.any() else ())

    def all(self) -> list[pa.RecordBatch]:
        """What was found, each once; a text may lack of its p prefix shingles those that the two do not share, n less what they share at least."""
        a, b, n, m = (np.concatenate(x) if self.pairs else np.zeros(0, np.int64) for x in (zip(*self.pairs) if self.pairs else [()] * 4))
        pairs, first, times = np.unique(np.stack([np.minimum(a, b), np.maximum(a, b)], 1), axis=0, return_index=True, return_counts=True)
        n, m = n[first], m[first]
        size = lambda k: k - np.ceil(self.similarity * k - 1e-6) + 1
        needed = np.ceil(np.minimum(size(n) - n, size(m) - m) + _least(self.similarity, n, m) - 1e-6)
        blocks = np.unique(np.concatenate(self.blocks), axis=0) if self.blocks else np.zeros((0, 2), np.int64)
        self.pairs, self.blocks, self.n = [], [], 0
        return [_out(_PAIR, pairs[:, 0], pairs[:, 1], times.astype(np.int64), np.maximum(needed, 1).astype(np.int64)), _out(_BLOCKS, blocks[:, 0], blocks[:, 1])]


def _across(similarity: float, x: list[np.ndarray], y: list[np.ndarray], later: bool) -> tuple[np.ndarray, np.ndarray]:
    """Rows (i, j) of x and y with different labels that may be similar; each two once if y goes on from x."""
    may = _may(similarity, x[1][:, None], y[1][None, :], x[2][:, None], y[2][None, :]) & (x[3][:, None] != y[3][None, :])
    if later:
        may &= np.arange(len(x[0]))[:, None] < np.arange(len(y[0]))[None, :]
    return np.nonzero(may)


def _with_end(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch | None]:
    """The batches, and None after the last."""
    yield from batches
    yield None


def _scan(rule: Rule):
    """Over rows (_ROW) sorted by s: what may be similar within each bucket of one s; large buckets' rows as they are."""

    def within(x: list[np.ndarray], cut: np.ndarray, size: np.ndarray, found: _Found) -> None:
        """The pairs of buckets of size rows from cut on: of small ones by size, of the others one by one."""
        n, pos, label = x[1:4]
        for m in np.unique(size[size <= 8]).tolist():
            i, j = np.triu_indices(m, 1)
            of = cut[size == m]
            for at in range(0, len(of), 4096):
                part = of[at : at + 4096, None]
                a, b = (part + i).ravel(), (part + j).ravel()
                may = _may(rule.similarity, n[a], n[b], pos[a], pos[b]) & (label[a] != label[b])
                found.add(x, x, a[may], b[may])
        for at, m in zip(cut[size > 8].tolist(), size[size > 8].tolist()):
            own = [c[at : at + m] for c in x]
            for k in range(0, m, 64):
                one, two = [c[k : k + 64] for c in own], [c[k:] for c in own]
                found.add(one, two, *_across(rule.similarity, one, two, True))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, large, found = None, None, _Found(rule.similarity)
        for batch in _with_end(batches):
            if batch is not None and batch.num_rows:
                now = [batch.column(c).to_numpy() for c in range(len(_ROW))]
                held = now if held is None else [np.concatenate(x) for x in zip(held, now)]
            if held is None or (batch is not None and len(held[0]) < 65_536):
                continue
            s, label = held[0], held[4]
            cut = np.flatnonzero(np.r_[True, s[1:] != s[:-1]])
            size = np.diff(np.r_[cut, len(s)])
            # The last bucket may go on in the next batch. Once a bucket is large its rows go out as they come.
            whole = len(cut) - (batch is not None)
            big = size > rule.large
            big[0] |= large is not None and bool(s[0] == large)
            for k in np.flatnonzero(big).tolist():
                yield _out(_LARGE, *(c[cut[k] : cut[k] + size[k]] for c in held))
            mixed = ~big & (np.minimum.reduceat(label, cut) != np.maximum.reduceat(label, cut))
            mixed[whole:] = False
            for k in range(0, len(cut), 4096):
                part = mixed[k : k + 4096]
                within(held[1:], cut[k : k + 4096][part], size[k : k + 4096][part], found)
                if found.n >= 200_000:
                    yield from found.all()
            large = s[-1] if batch is not None and big[-1] else None
            held = None if whole == len(cut) or big[-1] else [c[cut[-1] :] for c in held]
        yield from found.all()

    return scan


def _parts(rule: Rule):
    """Of a large bucket's two parts (side, _ROW): what may be similar."""

    def run(t: pa.Table) -> pa.Table:
        first = t.column("side").to_numpy() == t.column("i").to_numpy()
        x = [t.column(c).to_numpy() for c in _ROW[1:]]
        one, two = [c[first] for c in x], [c[~first] for c in x]
        alike, found = not len(two[0]), _Found(rule.similarity)
        for at in range(0, len(one[0]), 64):
            a, b = [c[at : at + 64] for c in one], [c[at:] for c in one] if alike else two
            found.add(a, b, *_across(rule.similarity, a, b, alike))
        return pa.Table.from_batches(found.all())

    return run


def candidates(nodes: DataFrame, rule: Rule) -> tuple[DataFrame, DataFrame]:
    """Of nodes (node, n_shingles, prefix, label, group, block) with different labels that share a prefix shingle and may be similar: pairs (a, b) from different groups, and blocks (i, j) of one group.

    Similar sets share shingles of their prefixes, as many as their sizes demand, so no similar pair is left out. Large
    buckets are dealt in parts by number of shingles; parts too far apart for the similarity do not meet.
    """
    long = lambda c: F.col(c).cast("long")
    rows = nodes.select("node", long("n_shingles").alias("n"), "label", "group", F.coalesce("block", F.lit(-1)).cast("long").alias("block"), F.posexplode("prefix").alias("pos", "s")).select("s", "node", "n", long("pos").alias("pos"), "label", "group", "block")
    rows = rows.repartition(partitions(nodes.sparkSession), "s").sortWithinPartitions("s")
    met = written(rows.mapInArrow(released(_scan(rule)), _FOUND), "met")
    large, found = met.where(F.col("kind") == _LARGE), met.where(F.col("kind") != _LARGE)
    if not large.isEmpty():
        own = large.select(*[F.col(f"x{k}").alias(c) for k, c in enumerate(_ROW)])
        placed = written(positioned(own, [F.col("s"), F.col("n"), F.col("node")], "at").withColumn("part", F.floor(F.col("at") / rule.large)), "large")
        spans = placed.groupBy("s", "part").agg(F.min("n").alias("lo"), F.max("n").alias("hi"))
        i, j = spans.select("s", F.col("part").alias("i"), F.col("hi").alias("most")), spans.select("s", F.col("part").alias("j"), F.col("lo").alias("least"))
        two = i.join(j, "s").where((F.col("i") <= F.col("j")) & (F.col("most") >= F.lit(rule.similarity) * F.col("least") - 1e-6))
        sides = two.select("s", "i", "j", F.explode(F.array_distinct(F.array("i", "j"))).alias("part"))
        each = sides.join(placed, ["s", "part"]).withColumnRenamed("part", "side")
        found = found.unionByName(each.groupBy("s", "i", "j").applyInArrow(_parts(rule), _FOUND))
        found = written(found, "met")
        forget(met, placed)
    pairs = found.where(F.col("kind") == _PAIR).groupBy(F.col("x0").alias("a"), F.col("x1").alias("b")).agg(F.sum("x2").alias("times"), F.max("x3").alias("needed")).where("times >= needed").select("a", "b")
    blocks = found.where(F.col("kind") == _BLOCKS).select(F.col("x0").alias("i"), F.col("x1").alias("j")).distinct()
    out = written(pairs, "pairs"), written(blocks, "block-pairs")
    forget(found)
    return out


def _block_links(similarity: float):
    """Of the texts of two blocks (i, j, block, node, shingles) a forest of all links between them, each compared exactly."""

    def run(t: pa.Table) -> pa.Table:
        node = t.column("node").to_numpy()
        lists = t.column("shingles").combine_chunks()
        n, values = np.diff(lists.offsets.to_numpy()).astype(np.int64), lists.flatten().to_numpy()
        _, column, times = np.unique(values, return_inverse=True, return_counts=True)
        row, shared = np.repeat(np.arange(len(n)), n), np.zeros((len(n), len(n)), np.float32)
        # A shingle of one text adds to no pair; the others are counted so many columns at a time.
        number = np.where(times > 1, np.cumsum(times > 1) - 1, -1)[column]
        order = np.argsort(number, kind="stable")
        number, row = number[order], row[order]
        for at in range(0, int(number.max(initial=-1)) + 1, 4096):
            lo, hi = np.searchsorted(number, [at, at + 4096])
            part = np.zeros((len(n), 4096), np.float32)
            part[row[lo:hi], number[lo:hi] - at] = 1
            shared += part @ part.T
        union = n[:, None] + n[None, :] - shared
        near = (union == 0) | (shared >= similarity * union - 1e-9)
        links, rest = [], np.ones(len(n), bool)
        for first in range(len(n)):
            queue = deque([first] if rest[first] else [])
            rest[first] = False
            while queue:
                x = queue.popleft()
                found = np.flatnonzero(near[x] & rest)
                rest[found] = False
                links += [(node[x], node[y]) for y in found]
                queue.extend(found.tolist())
        a, b = zip(*links) if links else ((), ())
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    return run


def placed(links: DataFrame, nodes: DataFrame, rule: Rule) -> DataFrame:
    """(node, key, least, group, block) of the nodes that links (a, b) hold together: groups stand together in blocks, by number of shingles."""
    groups = connected_components(links)
    held = groups.withColumnRenamed("root", "group").join(nodes.select("node", "key", "least", "n_shingles"), "node")
    held = positioned(held, [F.col("group"), F.col("n_shingles"), F.col("node")], "pos")
    size = F.greatest(F.ceil(F.log2(F.greatest(F.col("n_shingles"), F.lit(SET)) / SET)), F.lit(0))
    rows = F.greatest(F.floor(F.lit(rule.block) / F.pow(F.lit(2.0), size)), F.lit(1))
    out = written(held.select("node", "key", "least", "group", (size * F.lit(1 << 48) + F.floor(F.col("pos") / rows)).cast("long").alias("block")), "blocks")
    forget(groups)
    return out


def sets_of(held: DataFrame, texts: DataFrame, rule: Rule) -> DataFrame:
    """(block, node, shingles) of the placed nodes, from one of the rows (doc_id, key, t) with their text; a text's shingles are made once."""
    wanted = held.select("node", "block", F.col("key").alias("own"), "least")
    wanted = F.broadcast(wanted) if held.count() <= BROADCAST_ROWS else wanted
    own = texts.join(wanted, (F.col("key") == F.col("own")) & F.col("doc_id").eqNullSafe(F.col("least")))
    return written(own.select("block", "node", "t").mapInArrow(released(shingled(rule.size)), "block long, node long, shingles array<long>"), "shingles")


def between(links: DataFrame, held: DataFrame) -> DataFrame:
    """The blocks (i, j) that links (a, b) join."""
    at = lambda c: held.select(F.col("node").alias(c), F.col("block").alias(f"block_{c}"))
    both = links.join(at("a"), "a").join(at("b"), "b")
    return written(both.select(F.least("block_a", "block_b").alias("i"), F.greatest("block_a", "block_b").alias("j")).distinct(), "sides")


def compared(met: DataFrame, sets: DataFrame, rule: Rule) -> DataFrame:
    """Links (a, b) that join all similar texts of the blocks (i, j) that meet; every link is of similar texts."""
    sides = met.select("i", "j", F.explode(F.array_distinct(F.array("i", "j"))).alias("block"))
    return written(sides.join(sets, "block").groupBy("i", "j").applyInArrow(_block_links(rule.similarity), "a long, b long"), "links")


def joined(proposed: DataFrame, nodes: DataFrame, texts: DataFrame, rule: Rule) -> DataFrame:
    """(node, root) of all nodes that have a similar one: the components of all similar pairs of sets.

    proposed are links (a, b) between nodes that some method holds for likely; nodes are (node, key, least, n_shingles, prefix),
    one for each different text, and texts (doc_id, key, t) its rows, of which that with the least doc_id is read. Which links are
    proposed decides the work and not the result.
    """
    held = placed(proposed, nodes, rule)
    sets, met = sets_of(held, texts, rule), between(proposed, held)
    links = compared(met, sets, rule)
    labels = connected_components(links)
    told = nodes.select("node", "n_shingles", "prefix").join(labels, "node", "left").join(held.select("node", "group", "block"), "node", "left")
    told = told.select("node", "n_shingles", "prefix", F.coalesce("root", "node").alias("label"), F.coalesce("group", "node").alias("group"), "block")
    pairs, blocks = candidates(told, rule)
    blocks = blocks.join(met, ["i", "j"], "left_anti")
    links = links.unionByName(compared(blocks, sets, rule))
    if not pairs.isEmpty():
        rest = placed(pairs, nodes, rule)
        links = links.unionByName(compared(between(pairs, rest), sets_of(rest, texts, rule), rule))
    return connected_components(links)
