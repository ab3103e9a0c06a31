"""Exact top-k search by integer inner product, with KD-trees per shard.

Vectors are dealt over shards by a hash of their id, so that each shard is a bounded block. A shard is one row: a
KD-tree by median splits, with a tight bounding box and the smallest id of every node, packed in bytes. Query vectors
travel in blocks. Each block first searches one shard; the k-th scores found there bound the search of all other
shards, where a task hands on the k-th scores from one shard to the next. Inside a shard the traversal is
best-first: nodes are opened in the order of the highest score that any point of their box can have with the query, and
the search ends when no box left can beat the k-th score (or, at an equal score, the k-th id).

A shard's tree travels once for each lane of LANE blocks, ahead of the lane's blocks, and is unpacked once for them. Numbers travel in
the smallest type that holds them. Scores are computed in double precision where the dimension and the largest components of
tree and queries keep every sum below 2**53, else in unbounded integers.

Edge cases. Vectors that are null, hold nulls, NaN or infinities, or whose scaled components don't fit a long, take no part; nor
do rows with a null id. A score among the best that doesn't fit a long is an error. Rows that repeat an id count as one vector, the
smallest of those given. Vectors meet only vectors of their own dimension; empty ones have the score 0. Ties go to the smaller
id. Fewer than k candidates give fewer rows; empty tables give no rows. Extra columns are ignored, whatever their names.
"""

from __future__ import annotations

import heapq
from collections import OrderedDict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import stored

#: Least and most vectors of a shard, the shards that a search would like to have, vectors of a leaf and of a block of queries.
LEAST_SHARD, MOST_SHARD, SHARDS, LEAF, QUERIES = 8192, 65536, 64, 512, 512
#: Blocks that a tree serves each time it travels.
LANE = 256
K, SCALE = 20, 64
#: Query blocks whose k-th scores a task remembers for its next shard.
REMEMBERED = 4096


def smallest(x: np.ndarray) -> str:
    """The smallest type that holds these integers."""
    most = max(-int(x.min()) - 1, int(x.max())) if x.size else 0
    return next(t for t, limit in (("<i1", 1 << 7), ("<i2", 1 << 15), ("<i4", 1 << 31), ("<i8", 1 << 63)) if most < limit)


class KdTree:
    """Ids and integer vectors, ordered so that each node is a range of rows. Nodes are in arrays, children of i at left[i] and left[i] + 1."""

    def __init__(self, ids: np.ndarray, x: np.ndarray):
        order = np.argsort(ids, kind="stable")
        ids, x = ids[order], x[order]
        place = np.arange(len(ids))
        self.start, self.end, self.left = [0], [len(ids)], [-1]
        self.low, self.high, self.least = [], [], []
        node = 0
        while node < len(self.start):
            a, b = self.start[node], self.end[node]
            part = x[place[a:b]]
            low, high = part.min(axis=0), part.max(axis=0)
            self.low.append(low)
            self.high.append(high)
            self.least.append(ids[place[a:b]].min())
            if b - a > LEAF and (high > low).any():
                axis = int(np.argmax(high.astype(float) - low))
                mid = (b - a) // 2
                split = np.argpartition(part[:, axis], mid)
                place[a:b] = place[a:b][split]
                self.left[node] = len(self.start)
                self.start += [a, a + mid]
                self.end += [a + mid, b]
                self.left += [-1, -1]
            node += 1
        for a, b in ((a, b) for a, b, c in zip(self.start, self.end, self.left, strict=True) if c < 0):
            place[a:b].sort()
        self.ids, self.x = ids[place], x[place]
        self.low, self.high, self.least = np.array(self.low), np.array(self.high), np.array(self.least)

    def pack(self) -> bytes:
        nodes = np.array([self.start, self.end, self.left], "<i8")
        head = np.array([*self.x.shape, nodes.shape[1]], "<i8")
        small = smallest(self.x)
        return b"".join([head.tobytes(), bytes(small[1:], "ascii"), nodes.tobytes(), self.least.astype("<i8").tobytes(), self.ids.astype("<i8").tobytes(), *(v.astype(small).tobytes() for v in (self.low, self.high, self.x))])

    @classmethod
    def unpack(cls, data: bytes) -> KdTree:
        tree = cls.__new__(cls)
        n, d, m = (int(v) for v in np.frombuffer(data, "<i8", 3))
        kind, at = np.dtype("<" + data[24:26].decode()), 26

        def take(count: int, of: np.dtype) -> np.ndarray:
            nonlocal at
            got = np.frombuffer(data, of, count, at)
            at += count * of.itemsize
            return got

        long = np.dtype("<i8")
        tree.start, tree.end, tree.left = take(3 * m, long).reshape(3, m).tolist()
        tree.least, tree.ids = take(m, long), take(n, long)
        parts = [take(k * d, kind).reshape(k, d) for k in (m, m, n)]
        # scores are exact in double precision while they stay below 2**53
        peak = max([1.0, *(float(np.abs(p.astype(float)).max()) for p in parts if p.size)])
        tree.low, tree.high, tree.x = (p.astype(float if peak < 2**20 else object) for p in parts)
        return tree

    def search(self, query_ids: np.ndarray, q: np.ndarray, k: int, kth: np.ndarray, kth_id: np.ndarray) -> Iterator[tuple[int, list[tuple[int, int]]]]:
        """For each query the (score, id) that may be among its k best, given that k candidates as good as kth, kth_id are known."""
        if self.x.dtype == float and q.size and self.x.size:
            peak = max(float(np.abs(self.low[0]).max()), float(np.abs(self.high[0]).max()))
            if peak * float(np.abs(q.astype(float)).max()) * q.shape[1] >= 2**53:  # large queries of a tree of small numbers
                self.low, self.high, self.x = (p.astype(np.int64).astype(object) for p in (self.low, self.high, self.x))
        q = q.astype(self.x.dtype)
        # the highest score that a point of each node's box can have
        up, down = np.maximum(q, 0), np.minimum(q, 0)
        bound = up @ self.high.T + down @ self.low.T
        blocks: dict[int, np.ndarray] = {}
        for row, own in enumerate(query_ids.tolist()):
            bounds = bound[row]
            # where no k-th score is known, scores too low for a long aren't passed over either
            worst, worst_id = int(kth[row]) if kth[row] > np.iinfo(np.int64).min else -np.inf, int(kth_id[row])
            best: list[tuple[int, int]] = []  # a heap of (score, -id)
            heap = [(-bounds[0], 0)] if self.start else []
            while heap:
                b, node = heapq.heappop(heap)
                if -b < worst:
                    break
                if -b == worst and self.least[node] > worst_id:
                    continue
                if (child := self.left[node]) >= 0:
                    for c in (child, child + 1):
                        if bounds[c] >= worst:
                            heapq.heappush(heap, (-bounds[c], c))
                    continue
                lo, hi = self.start[node], self.end[node]
                if node not in blocks:  # one product serves all queries of the block that open this leaf
                    blocks[node] = self.x[lo:hi] @ q.T
                scores, ids = blocks[node][:, row], self.ids[lo:hi]
                for i in np.flatnonzero(scores >= worst):
                    s, v = int(scores[i]), int(ids[i])
                    if v == own or s < worst or (s == worst and v > worst_id):
                        continue
                    if len(best) < k:
                        heapq.heappush(best, (s, -v))
                    elif (s, -v) > best[0]:
                        heapq.heapreplace(best, (s, -v))
                    if len(best) == k and (best[0][0] > worst or (best[0][0] == worst and -best[0][1] < worst_id)):
                        worst, worst_id = best[0][0], -best[0][1]
            yield row, [(s, -v) for s, v in best]


def scaled(vector: Column, scale: int = SCALE) -> Column:
    """Components as floor(scale * x), x as double; null where a vector takes no part."""
    x = vector.cast("array<double>")
    limit = 2.0**63
    fine = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v * scale) < limit))
    return F.when(vector.isNotNull() & fine, F.transform(x, lambda v: F.floor(v * scale)))


def _search(asked: DataFrame, trees: DataFrame, lanes: Column, k: int) -> DataFrame:
    """Rows of (block, d, shard, ids, vectors, kth) to rows of (query_id, vec_id, score). Each tree goes ahead of the blocks of its lane."""
    blocks = asked.select("d", "shard", F.floor(F.col("block") / LANE).alias("lane"), "block", "ids", "vectors", "kth", F.lit(None).cast("binary").alias("tree"))
    none = F.lit(None).cast("binary")
    ahead = trees.withColumn("lane", F.explode(F.sequence(F.lit(0).cast("long"), lanes - 1))).select("d", "shard", "lane", F.lit(-1).cast("long").alias("block"), none.alias("ids"), none.alias("vectors"), none.alias("kth"), "tree")
    met = blocks.unionByName(ahead).repartition("d", "shard", "lane").sortWithinPartitions("d", "lane", "shard", "block")
    low, high = np.iinfo(np.int64).min, np.iinfo(np.int64).max

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: OrderedDict = OrderedDict()
        tree = None
        for batch in batches:
            for r in range(batch.num_rows):
                d, block = batch.column("d")[r].as_py(), batch.column("block")[r].as_py()
                if block < 0:
                    tree = KdTree.unpack(batch.column("tree")[r].as_py())
                    continue
                ids = np.frombuffer(batch.column("ids")[r].as_py(), "<i8")
                vectors = batch.column("vectors")[r].as_py()
                q = np.frombuffer(vectors, "<" + vectors[:2].decode(), offset=2).reshape(len(ids), -1)
                kth, kth_id = known.pop((d, block), (None, None))
                if kth is None:
                    seed = np.frombuffer(batch.column("kth")[r].as_py() or b"", "<i8").reshape(-1, 2)
                    kth, kth_id = (seed[:, 0].copy(), seed[:, 1].copy()) if len(seed) else (np.full(len(ids), low), np.full(len(ids), high))
                out: list[list[int]] = [[], [], []]
                for row, best in tree.search(ids, q.astype(np.int64), k, kth, kth_id):
                    for s, v in best:
                        out[0].append(int(ids[row]))
                        out[1].append(v)
                        out[2].append(s)
                    if len(best) == k:
                        s, v = min(best, key=lambda x: (x[0], -x[1]))
                        if s > kth[row] or (s == kth[row] and v < kth_id[row]):
                            kth[row], kth_id[row] = s, v
                known[d, block] = kth, kth_id
                if len(known) > REMEMBERED:
                    known.popitem(last=False)
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in out], names=["query_id", "vec_id", "score"])

    return met.select("d", "block", "ids", "vectors", "kth", "tree").mapInArrow(run, "query_id long, vec_id long, score long")


def _best(found: DataFrame, k: int) -> DataFrame:
    """The k best candidates of each query, with their rank; each task cuts its own to k first."""
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def top_k(vectors: DataFrame, queries: Column, vec_id: str = "vec_id", vector: str = "embedding", k: int = K, scale: int = SCALE, shard: int | None = None, block: int = QUERIES) -> DataFrame:
    """The k highest scores of each row that `queries` (a condition on vec_id) marks, against every other row:
    query_id, rank (from 1), vec_id, score. `shard` is the vectors of a shard, by default as their number asks for."""
    # an id that many rows share shrinks to one row before anything is gathered
    one = vectors.select(F.col(vec_id).cast("long").alias("vec_id"), scaled(F.col(vector), scale).alias("x")).where("vec_id is not null and x is not null").groupBy("vec_id").agg(F.min("x").alias("x"))
    # an empty vector is a 0 for the trees, and keeps its dimension
    one = one.select("vec_id", F.size("x").alias("d"), F.when(F.size("x") == 0, F.array(F.lit(0).cast("long"))).otherwise(F.col("x")).alias("x"))
    one = stored(one, "topk-vectors")

    def by_dimension(counts: dict[int, int]) -> Column:
        out = F.lit(1).cast("long")
        for d, n in counts.items():
            out = F.when(F.col("d") == d, F.lit(n).cast("long")).otherwise(out)
        return out

    asked = one.where(queries)
    sizes = {r["d"]: r["n"] for r in one.groupBy("d").agg(F.count("*").alias("n")).collect()}
    shards = {d: -(-n // (shard or min(MOST_SHARD, max(LEAST_SHARD, n // SHARDS)))) for d, n in sizes.items()}
    blocks = {r["d"]: -(-r["n"] // block) for r in asked.groupBy("d").agg(F.count("*").alias("n")).collect()}
    lanes = by_dimension({d: -(-n // LANE) for d, n in blocks.items()})
    n_shards, n_blocks = by_dimension(shards), by_dimension(blocks)

    def build(key, table):
        x = np.concatenate([np.asarray(c.flatten()) for c in table.column("x").chunks]).reshape(table.num_rows, -1)
        packed = KdTree(table.column("vec_id").to_numpy(), x).pack()
        return pa.table({"d": pa.array([key[0].as_py()], pa.int32()), "shard": pa.array([key[1].as_py()], pa.int64()), "tree": pa.array([packed], pa.binary())})

    trees = one.withColumn("shard", F.pmod(F.xxhash64("vec_id"), n_shards)).groupBy("d", "shard").applyInArrow(build, "d int, shard long, tree binary")
    trees = stored(trees, "topk-trees")

    def gather(key, table):
        x = np.concatenate([np.asarray(c.flatten()) for c in table.column("x").chunks])
        small = smallest(x)
        row = {"d": pa.array([key[0].as_py()], pa.int32()), "block": pa.array([key[1].as_py()], pa.int64())}
        return pa.table(row | {"ids": pa.array([table.column("vec_id").to_numpy().astype("<i8").tobytes()], pa.binary()), "vectors": pa.array([small[1:].encode() + x.astype(small).tobytes()], pa.binary())})

    dealt = F.pmod(F.xxhash64(F.lit(7), "vec_id"), n_blocks)
    asked = stored(asked.withColumn("block", dealt).groupBy("d", "block").applyInArrow(gather, "d int, block long, ids binary, vectors binary"), "topk-queries")
    home = F.pmod("block", n_shards)
    first = _search(asked.withColumn("shard", home).withColumn("kth", F.lit(None).cast("binary")), trees, lanes, k)
    first = stored(_best(first, k), "topk-home")

    def seeds(key, table):
        at = dict(zip(table.column("query_id").to_pylist(), zip(table.column("score").to_pylist(), table.column("vec_id").to_pylist(), strict=True), strict=True))
        none = np.iinfo(np.int64)
        kth = [at[i] if at.get(i, (None,))[0] is not None else (none.min, none.max) for i in np.frombuffer(table.column("ids")[0].as_py(), "<i8").tolist()]
        return pa.table({"d": pa.array([key[0].as_py()], pa.int32()), "block": pa.array([key[1].as_py()], pa.int64()), "kth": pa.array([np.array(kth, "<i8").tobytes()], pa.binary())})

    # k-th scores of a block's queries, packed like its ids
    last = first.where(F.col("rank") == k).select("query_id", "score", "vec_id")
    ids_of = one.where(queries).select("d", dealt.alias("block"), F.col("vec_id").alias("query_id"))
    kth = ids_of.join(last, "query_id", "left").join(asked.select("d", "block", "ids"), ["d", "block"]).groupBy("d", "block").applyInArrow(seeds, "d int, block long, kth binary")
    rest = asked.join(stored(kth, "topk-kth"), ["d", "block"]).withColumn("shard", F.explode(F.sequence(F.lit(0).cast("long"), n_shards - 1))).where(F.col("shard") != home)
    others = _search(rest, trees, lanes, k)
    final = _best(first.select("query_id", "vec_id", "score").unionByName(others), k)
    return final.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
