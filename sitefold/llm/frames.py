"""Small DataFrame helpers shared by the operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sitefold.session import Workspace, is_small

# A settled side is broadcast only when it measures less than this; beyond it both sides shuffle.
SMALL_SIDE_BYTES = 24 * 1024 * 1024


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def keyed(docs: DataFrame, *more: str | Column) -> DataFrame:
    """(k_id, k_hash, text, *more): rows with equal doc_id and text share a key.

    The key is a function of the row, so a task that runs again yields the same keys, and
    repeated rows get equal decisions, which is what every operator here wants.
    """
    text = F.col("text").cast("string")
    return docs.select(
        F.col("doc_id").cast("long").alias("k_id"),
        F.xxhash64(text).alias("k_hash"),
        text.alias("text"),
        *more,
    )


def on_key(left: DataFrame, right: DataFrame) -> Column:
    return left["k_id"].eqNullSafe(right["k_id"]) & (left["k_hash"] == right["k_hash"])


def maybe_broadcast(side: DataFrame, row_bytes: Column | int) -> DataFrame:
    """Hint a broadcast of a settled side after measuring it."""
    size = F.lit(row_bytes) if isinstance(row_bytes, int) else row_bytes
    return F.broadcast(side) if is_small(side, size, SMALL_SIDE_BYTES) else side


def join_key(
    docs: DataFrame, side: DataFrame, how: str, row_bytes: Column | int | None = None
) -> DataFrame:
    """Join keyed documents with a settled side on the document key, keeping one pair of keys.

    ``row_bytes``: the side is usually small and may be broadcast if it measures small. Without,
    it grows with the documents and both sides shuffle at every size.
    """
    if row_bytes is not None:
        side = maybe_broadcast(side, row_bytes)
    joined = docs.join(side, on_key(docs, side), how)
    if how in ("left_anti", "left_semi"):
        return joined
    return joined.drop(side["k_id"]).drop(side["k_hash"])


# A key with more than one in so many rows is split; there are at most so many such keys.
HOT_SHARE = 1000


def join_counted(left: DataFrame, right: DataFrame, keys: list[str], total: int) -> DataFrame:
    """Join on keys of which ``right`` (settled) says how many rows ``n`` they have in ``left``.

    ``total`` is the number of rows of ``left``. A key with more than a thousandth of them is
    dealt by salts, so that no task gets more than about that share for it. Which keys those are
    is broadcast: at most a thousand.
    """
    salts = F.ceil(F.col("n") * HOT_SHARE / F.lit(max(total, 1))).cast("int")
    hot = right.where(salts > 1).select(*keys, salts.alias("_salts"))
    spot = F.pmod(F.xxhash64(*left.columns), F.col("_salts")).cast("int")
    dealt = left.join(F.broadcast(hot), keys, "left").select(
        *left.columns, F.coalesce(spot, F.lit(0)).alias("_salt")
    )
    every = F.sequence(F.lit(0), F.greatest(salts, F.lit(1)) - 1)
    copies = right.withColumn("_salt", F.explode(every))
    return dealt.join(copies, [*keys, "_salt"]).drop("_salt")


def id_fold(doc_id: Column, folds: int) -> Column:
    """crc32 of the id as text, modulo folds; null ids are in fold 0."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % folds, F.lit(0))


def positions(
    work: Workspace, df: DataFrame, group: list[str], order: list[str], name: str, out: str
) -> DataFrame:
    """Add ``out``, the 0-based position of a row in its group, and ``out``_n, the group's size.

    A range-partitioned sort by (group, order) splits a group of any size over tasks. Only one
    count for each (task, group) meets in the running sums, at most tasks + groups rows.
    """
    spread = [*group, *order]
    ranged = work.settle(
        df.repartitionByRange(*spread)
        .sortWithinPartitions(*spread)
        .withColumn("_at", F.monotonically_increasing_id())
        .withColumn("_task", F.shiftright(F.col("_at"), 33)),
        name,
    )
    parts = ranged.groupBy("_task", *group).agg(
        F.min("_at").alias("_first"), F.count(F.lit(1)).alias("_rows")
    )
    before = W.partitionBy(*group).orderBy("_task").rowsBetween(W.unboundedPreceding, -1)
    whole = W.partitionBy(*group)
    parts = parts.select(
        "_task",
        *group,
        (F.coalesce(F.sum("_rows").over(before), F.lit(0)) - F.col("_first")).alias("_shift"),
        F.sum("_rows").over(whole).alias(f"{out}_n"),
    )
    parts = maybe_broadcast(work.settle(parts, f"{name}_parts"), 96)
    match = ranged["_task"] == parts["_task"]
    for g in group:
        match &= ranged[g].eqNullSafe(parts[g])
    joined = ranged.join(parts, match)
    return joined.select(
        *[ranged[c] for c in df.columns],
        (ranged["_at"] + parts["_shift"]).alias(out),
        parts[f"{out}_n"],
    )
