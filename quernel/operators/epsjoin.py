"""Joins of points within a distance, by a grid, and distances to the nearest point, by a tree of boxes.

The distance join: cells are as wide as the radius on up to three axes, those with the widest range. A probe point goes to its
own cell and the cells around it, where an equi-join meets the other points; the distance is checked on what meets. The number
of pairs is the answer's own size; a cell with very many points is split among tasks by the join's skew handling. Whoever needs
counts of pairs only sums them where the join makes them.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quernel.functions.distance import grid, metric
from quernel.plans.lineage import stored

GRID = 3
#: Places of a leaf, leaves of a tree at most, and sampled places for each leaf, which decide where the tree splits.
LEAF, LEAVES, SAMPLED = 1024, 4096, 64
#: Distances that a task computes at once.
AT_ONCE = 1 << 22


def _axes(points: DataFrame, features: list[str]) -> list[str]:
    row = points.agg(*[(F.max(f) - F.min(f)).alias(f) for f in features]).first()
    return sorted(features, key=lambda f: (-(row[f] or 0.0), features.index(f)))[:GRID]


def eps_join(probes: DataFrame, points: DataFrame, features: list[str], eps: float, key: str = "id", distance: str = "euclidean") -> DataFrame:
    """(a, b, dist): every probe a and point b within eps of each other, a point and itself included if both sides hold it."""
    cell, reach = grid(distance, eps)
    axes = _axes(points, features)
    left = probes.select(F.col(key).alias("a"), *[F.col(f).alias(f"a_{f}") for f in features], *[cell(F.col(f)).alias(f"_{i}") for i, f in enumerate(axes)]).dropna()
    around = F.array(*[F.struct(*[F.lit(x).alias(f"o{i}") for i, x in enumerate(o)]) for o in product(range(-reach, reach + 1), repeat=len(axes))])
    left = left.withColumn("_o", F.explode(around)).select("a", *[f"a_{f}" for f in features], *[(F.col(f"_{i}") + F.col(f"_o.o{i}")).alias(f"c{i}") for i in range(len(axes))])
    right = points.select(F.col(key).alias("b"), *[F.col(f).alias(f"b_{f}") for f in features], *[cell(F.col(f)).alias(f"c{i}") for i, f in enumerate(axes)]).dropna()
    met = left.join(right, [f"c{i}" for i in range(len(axes))])
    away = metric(distance)([F.col(f"a_{f}") for f in features], [F.col(f"b_{f}") for f in features])
    return met.select("a", "b", away.alias("dist")).where(F.col("dist") <= eps)


def eps_pairs(points: DataFrame, features: list[str], eps: float, key: str = "id", distance: str = "euclidean") -> DataFrame:
    """(a, b, dist) with a < b, each pair once."""
    return eps_join(points, points, features, eps, key, distance).where("a < b")


def neighbour_counts(points: DataFrame, features: list[str], eps: float, key: str = "id", distance: str = "euclidean") -> DataFrame:
    """(id, n): points within eps, itself included. A task sums the pairs it finds; none is kept."""
    return eps_join(points, points, features, eps, key, distance).groupBy(F.col("a").alias(key)).agg(F.count("*").alias("n"))


def _apart(name: str, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Distances, a row for each of x and a column for each of y."""
    total = np.zeros((len(x), len(y)))
    for i in range(x.shape[1]):
        gap = np.abs(x[:, i, None] - y[None, :, i])
        if name == "canberra":
            size = np.abs(x[:, i, None]) + np.abs(y[None, :, i])
            gap = np.divide(gap, size, out=np.zeros_like(gap), where=size > 0)
        total = np.maximum(total, gap) if name == "chebyshev" else total + (gap * gap if name == "euclidean" else gap)
    return np.sqrt(total) if name == "euclidean" else total


class _Tree:
    """Splits at medians of a sample: node i splits `axis[i]` at `cut[i]` into 2i + 1 (below) and 2i + 2; leaves are the last level."""

    def __init__(self, sample: np.ndarray, depth: int):
        self.depth = depth
        self.axis, self.cut = np.zeros(2**depth - 1, int), np.zeros(2**depth - 1)
        parts = {0: sample}
        for i in range(2**depth - 1):
            part = parts.pop(i)
            if len(part):
                self.axis[i] = np.argmax(part.max(axis=0) - part.min(axis=0))
                self.cut[i] = np.median(part[:, self.axis[i]])
            above = part[:, self.axis[i]] >= self.cut[i]
            parts[2 * i + 1], parts[2 * i + 2] = part[~above], part[above]

    def leaf(self, x: np.ndarray) -> np.ndarray:
        node = np.zeros(len(x), int)
        for _ in range(self.depth):
            node = 2 * node + 1 + (x[np.arange(len(x)), self.axis[node]] >= self.cut[node])
        return node - (2**self.depth - 1)


def _matrix(batch: pa.RecordBatch | pa.Table, features: list[str]) -> np.ndarray:
    return np.column_stack([batch.column(f).to_numpy(zero_copy_only=False) if isinstance(batch, pa.RecordBatch) else batch.column(f).to_numpy() for f in features]).astype(float)


def _least(name: str, x: np.ndarray, y: np.ndarray, same: bool) -> np.ndarray:
    """For each of x the distance to the nearest of y; with `same`, y is x and a point doesn't meet itself."""
    out, step = np.full(len(x), np.inf), max(1, AT_ONCE // max(len(y), 1))
    for at in range(0, len(x), step):
        if len(y) > same:
            far = _apart(name, x[at : at + step], y)
            if same:
                far[np.arange(len(far)), np.arange(at, at + len(far))] = np.inf
            out[at : at + step] = far.min(axis=1)
    return out


def nearest_distance(points: DataFrame, features: list[str], key: str = "id", distance: str = "euclidean") -> DataFrame:
    """(id, dist) to the nearest other point, exactly. Points that share their place are at 0 and count as one place from then on.

    Places are dealt over the leaves of a tree whose splits are medians of a sample, so that dense and empty regions and far
    outliers alike give leaves of about equal size. The nearest place of the own leaf bounds the distance; a place then visits only
    the leaves whose box lies within its bound. The sample decides the leaves' sizes, never the answer. The driver holds the boxes of
    LEAVES leaves at most. A point without any other has no row."""
    metric(distance)
    points = stored(points.select(F.col(key).cast("long").alias("_id"), *[F.col(f).cast("double").alias(f) for f in features]).dropna(), "nearest-points")
    places = stored(points.groupBy(*features).agg(F.min("_id").alias("_id"), F.count("*").alias("_n")), "nearest-places")
    shared = points.join(places.where("_n > 1").select(*features), features, "left_semi").select(F.col("_id").alias(key), F.lit(0.0).alias("dist"))
    n = places.count()
    if n < 2:
        return shared
    depth = min(max(0, (n // LEAF).bit_length()), LEAVES.bit_length() - 1)
    dealt = F.xxhash64(*features)
    share = n // (SAMPLED << depth)
    sample = places.where(F.pmod(dealt, F.lit(share)) == 0) if share > 1 else places
    rows = sample.select(*features).limit(4 * SAMPLED << depth).collect()
    tree = _Tree(np.array([tuple(r) for r in rows], float).reshape(-1, len(features)), depth)
    own = "_id long, _n long, " + ", ".join(f"`{f}` double" for f in features)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in ("_id", "_n", *features)), pa.array(tree.leaf(_matrix(b, features)), pa.int32())], names=["_id", "_n", *features, "leaf"])

    def local(table: pa.Table) -> pa.Table:
        x = _matrix(table, features)
        return table.append_column("r", pa.array(_least(distance, x, x, True), pa.float64()))

    found = places.mapInArrow(deal, own + ", leaf int").groupBy("leaf").applyInArrow(local, own + ", leaf int, r double")
    found = stored(found, "nearest-local")
    boxes = found.groupBy("leaf").agg(F.array(*[F.min(f) for f in features]).alias("low"), F.array(*[F.max(f) for f in features]).alias("high")).collect()
    leaves = np.array([b["leaf"] for b in boxes])
    low, high = np.array([b["low"] for b in boxes]), np.array([b["high"] for b in boxes])

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            step = max(1, AT_ONCE // len(leaves))
            for at in range(0, whole.num_rows, step):
                b = whole.slice(at, step)
                x, home, r = _matrix(b, features), b.column("leaf").to_numpy(), b.column("r").to_numpy().copy()
                near, far = _box_distances(distance, x, low, high)
                other = home[:, None] != leaves[None, :]
                r = np.minimum(r, np.where(other, far, np.inf).min(axis=1))
                who, where = np.nonzero(other & (near <= r[:, None]))
                yield pa.RecordBatch.from_arrays([pa.array(leaves[where], pa.int32()), b.column("_id").take(pa.array(who)), *(b.column(f).take(pa.array(who)) for f in features)], names=["leaf", "_id", *features])

    def visit(asked: pa.Table, held: pa.Table) -> pa.Table:
        r = _least(distance, _matrix(asked, features), _matrix(held, features), False) if asked.num_rows else np.zeros(0)
        return pa.table({"_id": asked.column("_id"), "r": pa.array(r, pa.float64())})

    asked = found.where("_n = 1").mapInArrow(ask, "leaf int, _id long, " + ", ".join(f"`{f}` double" for f in features))
    visited = asked.groupBy("leaf").cogroup(found.select("leaf", *features).groupBy("leaf")).applyInArrow(visit, "_id long, r double")
    least = found.where("_n = 1").select("_id", "r").unionByName(visited).groupBy("_id").agg(F.min("r").alias("dist"))
    return shared.unionByName(least.select(F.col("_id").alias(key), "dist"))


def _box_distances(name: str, x: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The least and largest distance that a point of each box can have to each of x, by the nearest and farthest ends of the
    box on each axis; a hair less and more, so that rounding drops nothing."""
    near, far = np.zeros((len(x), len(low))), np.zeros((len(x), len(low)))
    for i in range(x.shape[1]):
        v, lo, hi = x[:, i, None], low[None, :, i], high[None, :, i]
        ends = np.clip(v, lo, hi)
        terms = []
        for y in (ends, lo, hi):
            gap = np.abs(v - y)
            if name == "canberra":
                size = np.abs(v) + np.abs(y)
                gap = np.divide(gap, size, out=np.zeros(gap.shape), where=size > 0)
            terms.append(gap * gap if name == "euclidean" else gap)
        most = np.maximum(terms[1], terms[2])
        near, far = (np.maximum(near, terms[0]), np.maximum(far, most)) if name == "chebyshev" else (near + terms[0], far + most)
    if name == "euclidean":
        near, far = np.sqrt(near), np.sqrt(far)
    return near * (1 - 1e-12), far * (1 + 1e-12)
