"""Connected components of an edge table by alternating star contractions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sitefold.session import Workspace


def _to_smallest(edges: DataFrame, both_ways: bool) -> DataFrame:
    """Link neighbours of each node u to the smallest of them (and of u).

    both_ways: all neighbours count and those above u are moved; else only those below u
    count, and all of them and u itself are moved.
    """
    if both_ways:
        near = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    else:
        near = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    smallest = near.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
    linked = near.join(smallest, "u")
    if both_ways:
        moved = linked.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        moved = linked.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(
            smallest.select("u", F.col("m").alias("v"))
        )
    return moved.where("u <> v").distinct()


def components(edges: DataFrame, work: Workspace, name: str) -> DataFrame:
    """(node, comp) of all nodes with an edge; comp is the smallest node of the component.

    ``edges`` has long columns u and v. Each step is settled, minima are partial aggregates, so
    a node with very many edges is no task's burden. An empty edge table gives no rows.
    """
    current = work.settle(edges.where("u <> v").select("u", "v").distinct(), f"{name}_0")
    at, state = 0, None
    while True:
        step = _to_smallest(_to_smallest(current, True), False)
        at += 1
        current = work.settle(step, f"{name}_{at}")
        work.drop(f"{name}_{at - 1}")
        now = current.agg(
            F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))
        ).first()
        if now == state:
            break
        state = now
    roots = current.select(F.col("v").alias("node")).distinct()
    labels = current.select(F.col("u").alias("node"), F.col("v").alias("comp")).unionByName(
        roots.select("node", F.col("node").alias("comp"))
    )
    settled = work.settle(labels, name)
    work.drop(f"{name}_{at}")
    return settled
