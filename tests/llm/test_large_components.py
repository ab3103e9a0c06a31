import math
import random

import pytest
from pyspark.sql import functions as F

from quernel.llm import topk


def test_components_past_32_bits_take_part(spark):
    schema = "vec_id long, embedding array<double>"
    rows = [(0, [2.0**36, 3.0]), (20, [1.0, 2.0]), (3, [-8.0, 1.0]), (4, [5.0, 1.0])]
    got = topk.top_k(spark.createDataFrame(rows, schema), F.col("vec_id") % 20 == 0).collect()
    q = {i: [int(64 * x) for x in v] for i, v in rows}
    expected = set()
    for i in (0, 20):
        order = sorted((-sum(a * b for a, b in zip(q[i], q[j], strict=True)), j) for j in q if j != i)
        expected |= {(i, k + 1, j, -s) for k, (s, j) in enumerate(order)}
    assert {tuple(r) for r in got} == expected


def test_scores_past_a_long_are_an_error(spark):
    rows = spark.createDataFrame([(0, [2.0**40]), (1, [2.0**33]), (2, [-(2.0**33)])], "vec_id long, embedding array<double>")
    for other in (1, 2):
        with pytest.raises(Exception, match="Overflow|too large|out of"):
            topk.top_k(rows.where(F.col("vec_id").isin(0, other)), F.col("vec_id") == 0).collect()


@pytest.mark.parametrize("dims", [1, 3, 40])
def test_mixed_magnitudes_are_brute_force(spark, dims, monkeypatch):
    """Small and large components in one shard and in one query block, against unbounded integers."""
    monkeypatch.setattr(topk, "LANE", 2)
    r = random.Random(dims)
    size = lambda: r.choice([0.1, 1, 30, 1e4, 1e6, 2.0**24])
    rows = [(i, [r.uniform(-s, s) for s in [size()] for _ in range(dims)]) for i in range(300)]
    got = topk.top_k(spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumns({c: F.lit("x") for c in ("d", "x", "block", "shard", "rank")}), F.col("vec_id") % 4 == 0, k=7, shard=60, block=10).collect()
    q = {i: [math.floor(64 * x) for x in v] for i, v in rows}
    expected = set()
    for i in range(0, 300, 4):
        order = sorted((-sum(a * b for a, b in zip(q[i], q[j], strict=True)), j) for j in q if j != i)[:7]
        expected |= {(i, n + 1, j, -s) for n, (s, j) in enumerate(order)}
    assert {tuple(g) for g in got} == expected


def test_empty_vectors_have_score_0(spark):
    rows = spark.createDataFrame([(0, []), (1, []), (20, []), (3, [1.0]), (4, None)], "vec_id long, embedding array<float>")
    got = topk.top_k(rows, F.col("vec_id") % 20 == 0).collect()
    assert sorted(tuple(g) for g in got) == [(0, 1, 1, 0), (0, 2, 20, 0), (20, 1, 0, 0), (20, 2, 1, 0)]
