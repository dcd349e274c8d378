"""Connected components of an edge list, by alternating large-star and small-star rounds."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from waymark.llm.common import dropped, staged


def labels(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Nodes of the edges (u, v), and the smallest node that each reaches."""
    nodes, at = np.unique(np.concatenate([u, v]), return_inverse=True)
    a, b = at[: len(u)], at[len(u) :]
    root = np.arange(len(nodes))
    while len(a):
        np.minimum.at(root, np.maximum(a, b), np.minimum(a, b))
        while (root[root] != root).any():
            root = root[root]
        a, b = root[a], root[b]
        a, b = a[a != b], b[a != b]
    return nodes, nodes[root]


def _labelled(batches):
    """node, component of the edges (u, v) of a task."""
    read = [batch.select(["u", "v"]) for batch in batches if batch.num_rows]
    if read:
        t = pa.Table.from_batches(read)
        node, component = labels(*(np.asarray(t.column(c).combine_chunks()) for c in ("u", "v")))
        yield pa.RecordBatch.from_arrays([pa.array(node), pa.array(component)], ["node", "component"])


def components(edges: DataFrame, a: str, b: str, most: int = 40, at_once: int = 0) -> DataFrame:
    """node, component (the smallest node reachable) of every node with an edge; a long, b long. Self-loops and null ends count for nothing.

    Each round points every node at its least neighbour and its larger neighbours there too; the number of rounds is
    about the logarithm of the longest chain. State is written to the shared folder each round, so lost executors cost a round at most.
    Up to at_once edges are instead read by one task, which finds the same in memory.
    """
    e = edges.select(F.least(a, b).alias("u"), F.greatest(a, b).alias("v")).where("u < v").distinct()
    e = staged(e, "edges")
    if at_once and e.count() <= at_once:
        return staged(e.coalesce(1).mapInArrow(_labelled, "node long, component long"), "components")
    before = None
    for _ in range(most):
        both = e.select("u", "v").union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        # Large star: larger neighbours of u, and u itself, go to the least of its neighbourhood.
        large = both.join(least, "u").where("v > u").select(F.col("m").alias("a"), F.col("v").alias("b"))
        large = large.union(least.select(F.col("m").alias("a"), F.col("u").alias("b"))).where("a < b").distinct()
        # Small star: smaller neighbours of each node go to the least of them.
        low = large.groupBy("b").agg(F.min("a").alias("m"))
        small = large.join(low, "b").select(F.least("a", "m").alias("u"), F.greatest("a", "m").alias("v")).union(low.select(F.col("m").alias("u"), F.col("b").alias("v")))
        old, e = e, staged(small.where("u < v").distinct(), "edges")
        dropped(old)
        now = e.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v") % 1000003).alias("s")).first()
        if now == before:
            break
        before = now
    else:
        raise RuntimeError("components did not settle")
    roots = e.select(F.col("u").alias("node"), F.col("u").alias("component")).distinct()
    return e.select(F.col("v").alias("node"), F.col("u").alias("component")).union(roots)
