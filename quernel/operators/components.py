"""Connected components by contraction.

Each round gives every node the smallest node next to it, follows that choice twice, and replaces the ends of every
edge by what they were given; edges that became loops go. A path shrinks to a quarter in a round, a star to nothing.
Once what is left fits a task, its size being checked, one task finishes it. Frames between rounds are written to the shared
folder, so a lost executor costs no more than a round.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quernel.plans.lineage import stored

#: Edges that one task takes: some 100 MB with all that it makes of them.
IN_TASK = 1 << 20


def _finished(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(node, root) of all nodes of these edges: root is the smallest node that the node reaches."""
    parts = [np.stack([b.column("a").to_numpy(), b.column("b").to_numpy()]) for b in batches if b.num_rows]
    if not parts:
        return
    names, place = np.unique(np.concatenate(parts, axis=1), return_inverse=True)
    a, b = place.reshape(2, -1)
    root = np.arange(len(names))
    while True:
        low = np.minimum(root[a], root[b])
        new = root.copy()
        # the roots of both ends take the smaller root, and every node follows its root to the end
        np.minimum.at(new, root[a], low)
        np.minimum.at(new, root[b], low)
        while (new != new[new]).any():
            new = new[new]
        if (new == root).all():
            break
        root = new
    for at in range(0, len(names), 1 << 16):
        yield pa.RecordBatch.from_arrays([pa.array(names[at : at + (1 << 16)]), pa.array(names[root[at : at + (1 << 16)]])], names=["node", "root"])


def components(edges: DataFrame) -> DataFrame:
    """From edges (a, b), longs, to (node, label): label is the smallest node that the node reaches. Nodes without
    edges aren't listed; loops, nulls and repeated edges are allowed; no edges give no rows."""
    edges = stored(edges.select("a", "b").where("a != b").distinct(), "edges")
    labels = None
    while (left := edges.count()) > IN_TASK:
        if labels is None:
            nodes = edges.select(F.col("a").alias("node")).union(edges.select("b")).distinct()
            labels = nodes.withColumn("label", F.col("node"))
        both = edges.union(edges.select("b", "a"))
        near = stored(both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("p")), "near")
        far = near.alias("x").join(near.alias("y"), F.col("x.p") == F.col("y.a")).select(F.col("x.a").alias("a"), F.col("y.p").alias("p"))
        far = stored(far, "far")
        labels = stored(labels.join(far, labels["label"] == far["a"], "left").select("node", F.coalesce("p", "label").alias("label")), "labels")
        ends = far.select(F.col("a").alias("u"), F.col("p").alias("v"))
        moved = edges.join(ends, edges["a"] == ends["u"]).select(F.col("v").alias("a"), "b")
        moved = moved.join(ends, moved["b"] == ends["u"]).select("a", F.col("v").alias("b"))
        edges = stored(moved.where("a != b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "edges")
    rest = edges.coalesce(1).mapInArrow(_finished, "node long, root long") if left else None
    if labels is None:
        return stored(rest.toDF("node", "label"), "labels") if left else edges.toDF("node", "label")
    if rest is None:
        return labels
    rest = stored(rest.withColumnRenamed("node", "_node"), "rest")
    return stored(labels.join(rest, labels["label"] == rest["_node"], "left").select("node", F.coalesce("root", "label").alias("label")), "labels")
