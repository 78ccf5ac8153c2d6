"""Proportional stratified interleaving of documents into shards.

Method: rows are shuffled by a seeded hash (48 bits of md5, which other engines can repeat) of
their id inside each source and ranked, ids that meet and repeated ids by id and text; row r of a source
with n rows has the fractional rank (2r + 1) / 2n. All rows sorted by fractional rank mix the
sources evenly at every point, and equal cuts of that order give shards whose counts differ by
at most one and which all hold the sources in the mixture's proportions.

Both ranks come from range-partitioned sorts with running counts, so a source with a third of
all rows is ranked by many tasks. Only keys and sizes are sorted, never text.

Defined results
- Each input row, repeated rows included, takes exactly one (shard, slot); slots of a shard run
  from 0 without gaps. Rows with equal doc_id and text may swap places.
- A null text has 0 bytes and crc32 0; a null source is a source of its own; null ids come
  first among equal hashes. An empty table gives no rows.
- With fewer rows than shards some shards stay empty.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sitefold.llm.frames import keyed, on_key, positions
from sitefold.session import Workspace

ROW_OVERHEAD = 16


def hashed(seed: str, doc_id: Column) -> Column:
    """A seeded number below 2**48 for each id."""
    text = F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("null")))
    return F.conv(F.substring(F.md5(text), 1, 12), 16, 10).cast("long")


def shard_manifest(
    docs: DataFrame, n_shards: int = 40, seed: str = "shards", strata: str = "source"
) -> DataFrame:
    """k_id, k_hash, size, text_crc32, shard, slot: one row for each row of ``docs``."""
    work = Workspace(docs.sparkSession, "sharding")
    rows = keyed(docs, F.col(strata).cast("string").alias("stratum")).select(
        "k_id",
        "k_hash",
        "stratum",
        (F.coalesce(F.octet_length("text"), F.lit(0)) + ROW_OVERHEAD).cast("long").alias("size"),
        F.coalesce(F.crc32("text"), F.lit(0)).cast("long").alias("text_crc32"),
        hashed(seed, F.col("k_id")).alias("mixed"),
    )
    ranked = positions(work, rows, ["stratum"], ["mixed", "k_id", "k_hash"], "by_source", "rank")
    placed = ranked.withColumn("at", (2 * F.col("rank") + 1) / (2 * F.col("rank_n"))).drop(
        "rank", "rank_n"
    )
    order = ["at", "stratum", "mixed", "k_id", "k_hash"]
    cut = positions(work, placed, [], order, "interleaved", "pos")
    shard = F.expr(f"pos * {n_shards} div pos_n")
    first = F.expr(f"(shard * pos_n + {n_shards - 1}) div {n_shards}")
    manifest = work.settle(
        cut.withColumn("shard", shard)
        .withColumn("slot", F.col("pos") - first)
        .select("k_id", "k_hash", "size", "text_crc32", F.col("shard").cast("int"), "slot"),
        "manifest",
    )
    work.close(keep=("manifest",))
    return manifest


def shard_documents(
    docs: DataFrame, n_shards: int = 40, seed: str = "shards", strata: str = "source"
) -> DataFrame:
    """``docs`` with columns shard and slot (replacing columns of these names)."""
    manifest = shard_manifest(docs, n_shards, seed, strata).select(
        "k_id", "k_hash", "shard", "slot"
    )
    doc = F.struct(*[F.col(c) for c in docs.columns]).alias("doc")
    rows = keyed(docs, doc).drop("text")
    # Repeated rows share a key; numbering both sides matches each copy with one place.
    copy = W.partitionBy("k_id", "k_hash")
    rows = rows.withColumn("copy", F.row_number().over(copy.orderBy(F.lit(0))))
    places = manifest.withColumn("copy", F.row_number().over(copy.orderBy("shard", "slot")))
    match = on_key(rows, places) & (rows["copy"] == places["copy"])
    names = [c for c in docs.columns if c not in ("shard", "slot")]
    return rows.join(places, match).select(
        *[F.col(f"doc.{c}").alias(c) for c in names], places["shard"], places["slot"]
    )
