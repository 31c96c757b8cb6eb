"""Connected components by repeated contraction, as joins; of a few links within one task."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.llm.common import forget, written

#: Up to so many links one task holds them (two numbers each) and contracts them alone; more are contracted by joins.
ONE_TASK = 300_000


def _contracted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Over all links (a, b): (node, root) of their nodes, root being the least node of the component."""
    held = [(x.column(0).to_numpy(), x.column(1).to_numpy()) for x in batches if x.num_rows]
    if not held:
        return
    ends = np.concatenate([np.concatenate(x) for x in zip(*held)])
    nodes, at = np.unique(ends, return_inverse=True)
    a, b = at[: len(at) // 2], at[len(at) // 2 :]
    root = np.arange(len(nodes))
    while len(a):
        # Every root points at the least root that a link joins it to, and pointers are followed to their ends.
        np.minimum.at(root, np.maximum(a, b), np.minimum(a, b))
        while (root[root] != root).any():
            root = root[root]
        a, b = root[a], root[b]
        a, b = a[a != b], b[a != b]
    for i in range(0, len(nodes), 10_000):
        yield pa.record_batch([pa.array(nodes[i : i + 10_000]), pa.array(nodes[root[i : i + 10_000]])], ["node", "root"])


def connected_components(links: DataFrame, a: str = "a", b: str = "b", native: bool = False) -> DataFrame:
    """(node, root) for every node of links; root is one node for each component.

    In each round every node points at its least neighbour or itself, and the links are contracted
    along these pointers, so at least half of the nodes that still have links go. The hub of a star
    is only ever aggregated (min, combined on the map side) or joined, where adaptive execution can
    split it. Few links of whole numbers are contracted in one task, unless all is to be native. Nulls and
    self-links are ignored; an empty table of links gives an empty result.
    """
    edges = written(links.where(F.col(a) != F.col(b)).select(F.least(a, b).alias("a"), F.greatest(a, b).alias("b")).distinct(), "links")
    if not native and dict(edges.dtypes)["a"] == "bigint" and edges.count() <= ONE_TASK:
        out = written(edges.coalesce(1).mapInArrow(_contracted, "node long, root long"), "labels")
        forget(edges)
        return out
    label = None
    while not edges.isEmpty():
        both = edges.select(F.explode(F.array(F.struct(F.col("a").alias("u"), F.col("b").alias("v")), F.struct(F.col("b").alias("u"), F.col("a").alias("v")))).alias("e"))
        least = both.groupBy(F.col("e.u").alias("u")).agg(F.min("e.v").alias("v")).select("u", F.least("u", "v").alias("p"))
        least = written(least, "parents")
        jump = least.select(F.col("u").alias("p"), F.col("p").alias("pp"))
        parent = written(least.join(jump, "p", "left").select("u", F.coalesce("pp", "p").alias("p")), "parents")
        if label is None:
            kept, label = None, written(parent.select(F.col("u").alias("node"), F.col("p").alias("root")), "labels")
        else:
            step = parent.select(F.col("u").alias("root"), F.col("p").alias("next"))
            kept, label = label, written(label.join(step, "root", "left").select("node", F.coalesce("next", "root").alias("root")), "labels")
        pa, pb = parent.select(F.col("u").alias("a"), F.col("p").alias("pa")), parent.select(F.col("u").alias("b"), F.col("p").alias("pb"))
        moved = edges.join(pa, "a").join(pb, "b").where("pa != pb")
        old, edges = edges, written(moved.select(F.least("pa", "pb").alias("a"), F.greatest("pa", "pb").alias("b")).distinct(), "links")
        forget(least, parent, old, *([kept] if kept is not None else []))
    return label if label is not None else edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
