"""Connected components of a graph given as edges: few edges by one task, more by rounds of minimum labels and shortcuts."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, forget

#: Edges up to which one task finds the components (some 100 MB there); beyond, rounds over all tasks do.
LOCAL_EDGES = 1 << 20


def roots(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct ends of edges, and for each the least end in its component."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    a, b = at[: len(a)], at[len(a) :]
    parent = np.arange(len(nodes))
    while True:
        x, y = parent[a], parent[b]
        if not np.any(x != y):
            return nodes, nodes[parent]
        np.minimum.at(parent, np.maximum(x, y), np.minimum(x, y))
        while np.any(parent[parent] != parent):
            parent = parent[parent]


def _roots(batches):
    forget()
    held = [(np.asarray(x.column(0)), np.asarray(x.column(1))) for x in batches if x.num_rows]
    if held:
        node, root = roots(*(np.concatenate(part) for part in zip(*held)))
        yield pa.RecordBatch.from_arrays([pa.array(node), pa.array(root)], ["node", "root"])


def smallest_reachable(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(node, label): the smallest starting label in each node's component, for nodes that have an edge.

    nodes: (node, label), each node once; labels are distinct, or null (of no account). edges: (a, b), whole numbers, either
    way round, repeats allowed. Up to LOCAL_EDGES distinct edges, a checked number, go to one task; beyond, see _rounds().
    Both give the same.
    """
    once = cut(edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    if once.count() > LOCAL_EDGES:
        return _rounds(nodes, once)
    found = cut(once.repartition(1).mapInArrow(_roots, "node long, root long"))
    labels = found.join(nodes, "node").groupBy("root").agg(F.min("label").alias("label"))
    return found.join(F.broadcast(labels), "root").select("node", "label")  # a row a component, of LOCAL_EDGES at most


def _rounds(nodes: DataFrame, once: DataFrame) -> DataFrame:
    """Each round takes the least label among a node's neighbours, pre-aggregated before its shuffle, and then the label
    of the node from which that label came, so that long chains close in few rounds. Every round is cut in the
    checkpoint folder; nothing but a count comes to the driver."""
    both = cut(once.unionAll(once.select(F.col("b").alias("a"), F.col("a").alias("b"))))
    linked = both.select(F.col("a").alias("node")).distinct()
    now = cut(linked.join(nodes, "node").select("node", F.col("label").alias("own"), "label"))
    while True:
        near = both.join(now.select(F.col("node").alias("b"), F.col("label").alias("near")), "b").groupBy("a").agg(F.min("near").alias("near"))
        step = now.join(near, now.node == near.a, "left").select("node", "own", F.col("label").alias("old"), F.least("label", "near").alias("label"))
        step = cut(step)
        hop = step.where("own is not null and label < own").select(F.col("own").alias("_from"), F.col("label").alias("_to"))
        after = step.join(hop, step.label == hop["_from"], "left").select("node", "own", "old", F.least("label", "_to").alias("label"))
        after = cut(after)
        changed = after.where("not (label <=> old)").limit(1).count()
        now = after.select("node", "own", "label")
        if not changed:
            return now.select("node", "label")
