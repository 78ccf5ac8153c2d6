"""Exact top-k inner products by KD-trees over shards.

Method: vectors are spread over shards of bounded size; each shard builds a KD-tree by median
splits of its widest dimension, and each node has the tight box of its points. No point of a
box scores more than sum_d max(q_d * low_d, q_d * high_d) against a query. A query visits the
leaves of a shard best box first, skips nodes whose bound does not reach the k-th score it already
has, and passes over a shard whose root box does not. The k-th score is propagated twice: from
shard to shard within a task, and over all tasks, where a first pass visits one leaf of each
shard for each query and the k best found give the query a floor for the full traversal.

Shards are packed once, written once and never copied. Queries are packed into blocks and taken
``GROUP_BLOCKS`` blocks at a time: such a group, of at most some 8 MB, goes to every task, which
streams its shards past it and returns k rows for each query. So what is written grows with the
rows and the results, not with their product; memory is bounded by a shard and a group, and no
pair of vectors is ever a row. A window limited before its shuffle takes the k best of all tasks.

Scores are exact integers: components are floor(scale * x). Products are formed in float64
while their sums stay below 2**53, else in Python integers, and end at the limits of 64 bits.

Defined results
- Vectors that are null or hold null or non-finite components take no part; empty vectors score 0.
- Vectors of different lengths do not meet. Equal scores go to the smaller id.
- Components beyond 2**53 are whole already and stay as they are; one that leaves the range of
  doubles when scaled counts as non-finite. Scores end at the limits of 64 bits, and tie there.
- Ids must not be null (such rows take no part). Rows that repeat an id are candidates each,
  but never of a query with their own id; equal (query, candidate) pairs count once. Equal rows
  are joined before packing, and blocks are chosen by id and vector, so no id fills a block.
- An empty table gives no rows; further columns are passed over.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sitefold.llm.frames import maybe_broadcast, positions
from sitefold.session import Workspace

SHARD_ROWS, QUERY_ROWS, LEAF_ROWS = 8192, 2048, 512
SHARD_BYTES, QUERY_BYTES = 4 << 20, 1 << 20  # of vectors, where they are longer than 64
GROUP_BLOCKS = 8  # query blocks that go to the tasks at a time
EXACT = 2.0**53
LOWEST, HIGHEST = -(2**63), 2**63 - 1
PACKED = "dims int, block long, ids binary, vectors binary"
FOUND = "query_id long, vec_id long, score long"


def whole_vectors(df: DataFrame, scale: int) -> DataFrame:
    """(vec_id, v): vectors of floor(scale * x), only those that take part."""
    x = F.transform(F.col("embedding").cast("array<double>"), lambda c: c * scale)
    finite = F.forall(
        x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf")))
    )
    whole = lambda c: F.when(F.abs(c) < EXACT, F.floor(c).cast("double")).otherwise(c)
    return df.select(F.col("vec_id").cast("long").alias("vec_id"), x.alias("x")).where(
        "vec_id is not null and x is not null"
    ).where(finite.alias("f")).select("vec_id", F.transform("x", whole).alias("v"))


def numbered(
    rows: DataFrame, most_rows: int, most_bytes: int, seed: str, work: Workspace
) -> DataFrame:
    """dims, block, vec_id, v: about so many vectors of one length share a block number."""
    counts = rows.groupBy(F.size("v").alias("dims")).agg(F.count(F.lit(1)).alias("n"))
    counts = maybe_broadcast(work.settle(counts, f"{seed}_counts"), 16)
    fit = F.greatest(F.lit(1), F.floor(most_bytes / (8 * F.greatest("dims", F.lit(1)))))
    blocks = F.ceil(F.col("n") / F.least(F.lit(most_rows), fit))
    block = F.pmod(F.xxhash64(F.lit(seed), "vec_id", "v"), blocks)
    sized = rows.withColumn("dims", F.size("v")).join(counts, "dims")
    return sized.select("dims", block.alias("block"), "vec_id", "v")


def pack(rows: DataFrame) -> DataFrame:
    """One row for each block: its ids and its matrix as bytes."""

    def bundle(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("vec_id", kind="stable")
        matrix = np.array(part.v.tolist(), np.float64).reshape(len(part), key[0])
        packed = {"ids": [part.vec_id.to_numpy(np.int64).tobytes()], "vectors": [matrix.tobytes()]}
        return pd.DataFrame({"dims": [key[0]], "block": [key[1]], **packed})

    return rows.groupBy("dims", "block").applyInPandas(bundle, PACKED)


class Tree:
    """KD-tree of one shard: leaves are ranges of a permuted matrix."""

    def __init__(self, points: np.ndarray, leaf_rows: int = LEAF_ROWS):
        self.leaf_rows = leaf_rows
        self.order = np.arange(len(points))
        self.low: list[np.ndarray] = []
        self.high: list[np.ndarray] = []
        self.children: list[tuple[int, int] | None] = []
        self.span: list[tuple[int, int]] = []
        self._grow(points, 0, len(points))
        self.points = points[self.order]
        self.low_m, self.high_m = np.array(self.low), np.array(self.high)

    def _grow(self, points: np.ndarray, a: int, b: int) -> int:
        own = points[self.order[a:b]]
        node = len(self.span)
        self.low.append(own.min(axis=0))
        self.high.append(own.max(axis=0))
        self.span.append((a, b))
        self.children.append(None)
        wide = self.high[node] - self.low[node]
        if b - a > self.leaf_rows and wide.size and wide.max() > 0:
            middle = (b - a) // 2
            cut = np.argpartition(own[:, int(wide.argmax())], middle)
            self.order[a:b] = self.order[a:b][cut]
            left = self._grow(points, a, a + middle)
            self.children[node] = (left, self._grow(points, a + middle, b))
        return node

    def bounds(self, queries: np.ndarray) -> np.ndarray:
        """Upper bound of the score of each query in each node's box."""
        plus, minus = np.maximum(queries, 0), np.minimum(queries, 0)
        return plus @ self.high_m.T + minus @ self.low_m.T


def _scores(points: np.ndarray, query: np.ndarray, safe: bool) -> np.ndarray:
    if safe:
        return points @ query
    sums = (sum(int(a) * int(b) for a, b in zip(p, query)) for p in points)
    return np.array([min(max(s, LOWEST), HIGHEST) for s in sums], object)


@dataclass
class Block:
    """Queries of one length, their floors, and the k best found for each as heaps."""

    dims: int
    ids: np.ndarray
    vectors: np.ndarray
    floors: np.ndarray

    def __post_init__(self) -> None:
        self.best: list[list[tuple[int, int]]] = [[] for _ in self.ids]  # (score, -id)


def search(tree: Tree, ids: np.ndarray, block: Block, k: int, leaves: int | None) -> int:
    """Bring the shard's points into the heaps and floors of ``block``; returns leaves visited.

    ``leaves``: visit only so many leaves for each query (first pass); None: all that may matter.
    """
    points, queries = tree.points, block.vectors
    most = np.abs(points).max(initial=0) * np.abs(queries).max(initial=0) * max(1, block.dims)
    safe = bool(most < EXACT)
    bounds = tree.bounds(queries)
    if not safe:  # neither rounding nor the limits of 64 bits may hide a point
        bounds = np.maximum(bounds * (1 + np.sign(bounds) * 1e-9) + 1, float(LOWEST))
    ids = ids[tree.order]
    visits = 0
    for q in np.flatnonzero(~(bounds[:, 0] < block.floors)):
        best, floor = block.best[q], block.floors[q]
        waiting = [(-bounds[q, 0], 0)]
        visited = 0
        while waiting:
            bound, node = heapq.heappop(waiting)
            if -bound < floor:
                break
            pair = tree.children[node]
            if pair:
                for child in pair:
                    if not bounds[q, child] < floor:
                        heapq.heappush(waiting, (-bounds[q, child], child))
                continue
            a, b = tree.span[node]
            score, of = _scores(points[a:b], queries[q], safe), ids[a:b]
            for i in np.flatnonzero((score >= floor) & (of != block.ids[q])):
                entry = (int(score[i]), -int(of[i]))
                if entry in best:
                    continue
                if len(best) < k:
                    heapq.heappush(best, entry)
                elif entry > best[0]:
                    heapq.heapreplace(best, entry)
            if len(best) == k:
                floor = max(floor, lowered(best[0][0]))
            visited += 1
            if leaves is not None and visited >= leaves:
                break
        block.floors[q] = floor
        visits += visited
    return visits


def lowered(score: int) -> float:
    """A double that is not above ``score``, and equal to it where doubles are exact."""
    return float(score) if abs(score) < EXACT else float(score) - abs(float(score)) * 2.0**-51


def _visit(group: list, floors: dict[int, float], k: int, leaves: int | None, leaf_rows: int):
    """Streams shards past a group of packed query blocks; k rows for each query and task."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        blocks = []
        for dims, packed_ids, packed in group:
            ids = np.frombuffer(packed_ids, np.int64)
            vectors = np.frombuffer(packed, np.float64).reshape(len(ids), dims)
            start = np.array([floors.get(int(i), -np.inf) for i in ids], np.float64)
            blocks.append(Block(dims, ids, vectors, start))
        for batch in batches:
            for row in batch.itertuples():
                met = [block for block in blocks if block.dims == row.dims]
                if not met:
                    continue
                ids = np.frombuffer(row.ids, np.int64)
                points = np.frombuffer(row.vectors, np.float64).reshape(len(ids), row.dims)
                tree = Tree(points, leaf_rows)
                for block in met:
                    search(tree, ids, block, k, leaves)
        for block in blocks:
            found = [
                (int(of), -neg, score)
                for of, best in zip(block.ids, block.best)
                for score, neg in best
            ]
            yield pd.DataFrame(found, columns=["query_id", "vec_id", "score"], dtype="int64")

    return run


def _best(found: DataFrame, k: int) -> DataFrame:
    """The k best different (candidate, score) of each query, limited before the one shuffle."""
    order = W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    ranked = found.withColumn("rank", F.dense_rank().over(order)).where(F.col("rank") <= k)
    return ranked.dropDuplicates(["query_id", "rank"])


def top_products(
    candidates: DataFrame, is_query: Column, k: int = 20, scale: int = 64
) -> DataFrame:
    """query_id, rank, vec_id, score: the k best candidates of each row with ``is_query``."""
    spark = candidates.sparkSession
    work = Workspace(spark, "kd_search")
    rows = whole_vectors(candidates, scale).distinct()
    shards = work.settle(pack(numbered(rows, SHARD_ROWS, SHARD_BYTES, "shard", work)), "shards")
    asked = numbered(rows.where(is_query), QUERY_ROWS, QUERY_BYTES, "query", work)
    placed = positions(work, pack(asked), [], ["dims", "block"], "queries", "at")
    queries = work.settle(
        placed.select("dims", "ids", "vectors", F.expr(f"at div {GROUP_BLOCKS}").alias("part")),
        "groups",
    )
    parts = queries.agg(F.max("part").alias("last")).first()["last"]
    tops = []
    for part in range(0 if parts is None else parts + 1):
        # GROUP_BLOCKS blocks of at most about QUERY_ROWS queries and QUERY_BYTES bytes each.
        held = queries.where(F.col("part") == part).select("dims", "ids", "vectors").collect()
        group = [(r.dims, bytes(r.ids), bytes(r.vectors)) for r in held]
        first = shards.mapInPandas(_visit(group, {}, k, 1, LEAF_ROWS), FOUND)
        kth = _best(first, k).where(F.col("rank") == k).select("query_id", "score").collect()
        floors = {r.query_id: lowered(r.score) for r in kth}
        second = shards.mapInPandas(_visit(group, floors, k, None, LEAF_ROWS), FOUND)
        best = _best(second, k).select(
            "query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score"
        )
        tops.append(work.settle(best, f"top_{part}"))
    work.close(keep=tuple(f"top_{part}" for part in range(len(tops))))
    if not tops:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    return reduce(DataFrame.unionByName, tops)
