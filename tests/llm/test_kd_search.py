import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from sitefold.llm import kd_search as kd

SCHEMA = "vec_id long, embedding array<float>, dims int, block long"


def brute(rows, k):
    good = [
        (i, [math.floor(64 * float(np.float32(x))) for x in v])
        for i, v in rows
        if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)
    ]
    out = set()
    for q, a in good:
        if q % 20 == 0:
            scores = {(-sum(x * y for x, y in zip(a, b)), i) for i, b in good if i != q and len(a) == len(b)}
            for rank, (score, i) in enumerate(sorted(scores)[:k], 1):
                out.add((q, rank, i, -score))
    return out


def run(spark, rows, k):
    frame = spark.createDataFrame([(i, v, 1, 2) for i, v in rows], SCHEMA)
    return {tuple(r) for r in kd.top_products(frame, F.col("vec_id") % 20 == 0, k=k).collect()}


@pytest.mark.parametrize("spread", [1.0, 0.02])
def test_many_shards_blocks_and_ties(spark, monkeypatch, spread):
    monkeypatch.setattr(kd, "SHARD_ROWS", 150)
    monkeypatch.setattr(kd, "QUERY_ROWS", 10)
    monkeypatch.setattr(kd, "LEAF_ROWS", 16)
    draw = np.random.default_rng(1)
    rows = [(i, [float(x) for x in draw.normal(0, spread, 6).astype(np.float32)]) for i in range(700)]
    rows += [(700 + i, rows[3][1]) for i in range(60)]
    assert run(spark, rows, 20) == brute(rows, 20)


def test_rough_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [
        (0, [1.0, 2.0]), (20, [1.0, 2.0]), (20, [3.0, 4.0]), (1, [1.0, None]), (2, [nan, 1.0]), (3, [inf, 1.0]),
        (4, None), (40, []), (5, []), (60, [1.0]), (None, [1.0, 1.0]), (6, [-1.0, 0.5]), (7, [1.0, 2.0]), (7, [1.0, 2.0]),
        (8, [3e9, 3e9]), (80, [1e9, -2e9]),
    ]
    got = run(spark, [r for r in rows if r != (20, [3.0, 4.0])], 3)
    assert got == brute([r for r in rows if r != (20, [3.0, 4.0])], 3)
    assert all(q != v for q, _, v, _ in run(spark, rows, 3))
    assert run(spark, [], 3) == set()


def test_groups_of_blocks_and_one_id_on_many_rows(spark, monkeypatch):
    monkeypatch.setattr(kd, "SHARD_ROWS", 40)
    monkeypatch.setattr(kd, "QUERY_ROWS", 3)
    monkeypatch.setattr(kd, "GROUP_BLOCKS", 2)
    draw = np.random.default_rng(2)
    # A third of the rows repeat one id that asks nothing, with one of two vectors.
    rows = [(i, [float(x) for x in draw.normal(0, 1, 4).astype(np.float32)]) for i in range(400)]
    rows += [(1001, rows[i % 2][1]) for i in range(200)]
    assert run(spark, rows, 5) == brute(rows, 5)
    vectors = kd.whole_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<float>"), 64)
    blocks = kd.numbered(vectors.distinct(), 40, 1 << 20, "shard", kd.Workspace(spark, "test"))
    assert blocks.groupBy("dims", "block").count().agg(F.max("count")).first()[0] < 80


def test_huge_components_end_at_the_limits(spark):
    rows = [(0, [1e30, 1.0]), (1, [1e30, 0.0]), (2, [-1e30, 0.0]), (3, [1e29, 5.0]), (4, [0.5, 0.25])]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = [tuple(r) for r in kd.top_products(frame, F.col("vec_id") == 0, k=4).orderBy("rank").collect()]
    top, low = 2**63 - 1, -(2**63)
    assert got == [(0, 1, 1, top), (0, 2, 3, top), (0, 3, 4, top), (0, 4, 2, low)]


def test_leaves_are_skipped():
    draw = np.random.default_rng(3)
    centres = draw.normal(0, 60, (16, 8))
    points = np.floor(np.concatenate([c + draw.normal(0, 3, (256, 8)) for c in centres]))
    tree = kd.Tree(points, 64)
    leaves = sum(c is None for c in tree.children)
    ids = np.arange(len(points))
    block = kd.Block(8, ids[::40], points[::40], np.full(len(ids[::40]), -np.inf))
    visits = kd.search(tree, ids, block, 10, None)
    assert visits < 0.3 * leaves * len(block.ids)
    # A floor over the root's bound passes over the shard.
    high = kd.Block(8, ids[:3], points[:3], np.full(3, 1e12))
    assert kd.search(tree, ids, high, 10, None) == 0
