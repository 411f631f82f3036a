"""Connected components by alternating large and small stars.

Edges are first dealt by range into parts of a bounded size, and each part
hangs its nodes below the smallest node that its own edges reach.  Then every
round hangs each node below the smallest node it can see; the rounds end when
the edge set no longer changes, so chains of any length are finished.  A node's
neighbours never have to meet in one task: minima are partial aggregates, and
the joins can be split by AQE."""
from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparktab.session import written


#: Edges of one part, on average.
PART_EDGES = 500_000


def _contracted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """(node, smallest node reached) over the edges of one part."""
    parts = list(batches)
    if not parts:
        return
    u, v = (np.concatenate([p[c].to_numpy(np.int64) for p in parts]) for c in ("u", "v"))
    nodes, at = np.unique(np.concatenate([u, v]), return_inverse=True)
    a, b = at[:len(u)], at[len(u):]
    root = np.arange(len(nodes))
    while (root[a] != root[b]).any():
        least = np.minimum(root[a], root[b])
        for end in (a, b):
            np.minimum.at(root, root[end], least)
        while (root[root] != root).any():
            root = root[root]
    below = root != np.arange(len(nodes))
    yield pd.DataFrame({"u": nodes[below], "v": nodes[root[below]]})


def _digest(edges: DataFrame) -> tuple:
    # xor is safe from overflow, and the edges are distinct
    return tuple(edges.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v")), F.bit_xor(F.hash("v", "u"))).first())


def connected_components(edges: DataFrame, left: str, right: str) -> DataFrame:
    """(node, component) for every node of ``edges``; component is its smallest node.

    Nodes are whole numbers of 64 bits.
    Loops and repeated edges are allowed, rows with a null end are ignored; a
    node that only has a loop is its own component; no edges, no rows."""
    ends = edges.select(F.col(left).cast("long").alias("a"), F.col(right).cast("long").alias("b")).where("a is not null and b is not null")
    ends = written(ends.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges")
    parts = -(-ends.count() // PART_EDGES) or 1
    dealt = ends.where("u <> v").repartitionByRange(parts, "v", "u")
    now, before = written(dealt.mapInPandas(_contracted, "u long, v long").distinct(), "contracted"), None
    while (digest := _digest(now)) != before:
        before = digest
        both = now.union(now.select("v", "u"))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        large = written(large, "large-star")
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        now = written(small.union(least).distinct(), "small-star")
    nodes = ends.select(F.col("u").alias("node")).union(ends.select("v")).distinct()
    return nodes.join(now.select(F.col("u").alias("node"), F.col("v").alias("c")), "node", "left") \
        .select("node", F.coalesce("c", "node").alias("component"))
