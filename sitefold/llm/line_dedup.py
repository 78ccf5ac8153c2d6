"""Line de-duplication over a corpus, with built-in functions only.

Method: line hashes are range-partitioned (salted by document, so that the occurrences of one
very common line lie in many partitions) and sorted by hash, document and position. One pass
over that order streams the first occurrence of a line in each document; these are counted
with partial aggregation. What comes back is a sparse keep bitmap for each document, not text:
one 32-bit word for each 32 lines that lose at least one line; all other lines stay.

Defined results
- text null or empty: one empty line, which stays.
- A line key is the line without leading and trailing ASCII white space, A-Z lower-cased.
- Documents are counted by doc_id; a null doc_id is one document, smaller than all others.
- Rows that repeat doc_id and text get equal bitmaps; rows sharing the largest doc_id all keep.
- An empty table gives no rows. Further columns of the input are passed over.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sitefold.llm.frames import join_counted, join_key, keyed
from sitefold.session import Workspace

BLANK = " \t\n\x0b\x0c\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
# Documents that share a salt; one line of them all is sorted by one task.
SALT_DOCS = 50_000
WORD = 32

WORDS_TYPE = "array<struct<word:bigint,kept:bigint>>"


def split_lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def line_key(line: Column) -> Column:
    return F.translate(F.btrim(line, F.lit(BLANK)), UPPER, LOWER)


def keep_bitmaps(
    docs: DataFrame, work: Workspace, min_length: int = 20, min_docs: int = 3
) -> DataFrame:
    """Documents that lose lines: k_id, k_hash, n_dropped, words (settled, one row per key).

    A key of at least ``min_length`` code points found in at least ``min_docs`` documents
    loses its lines everywhere but in the largest doc_id that holds it.
    """
    salts = max(64, docs.count() // SALT_DOCS)
    lines = keyed(docs).select("k_id", "k_hash", F.posexplode(split_lines(F.col("text"))))
    key = line_key(F.col("col"))
    hashed = lines.where(F.length(key) >= min_length).select(
        "k_id",
        "k_hash",
        F.col("pos").alias("line"),
        # Two hashes with different seeds: 128 bits, so that unequal lines do not meet.
        F.xxhash64(key).alias("h1"),
        F.xxhash64(F.lit("line"), key).alias("h2"),
        F.pmod(F.xxhash64("k_id"), F.lit(salts)).cast("int").alias("salt"),
    )
    order = ["h1", "h2", "salt"]
    stream = W.partitionBy(*order).orderBy(F.col("k_id").desc_nulls_last(), "k_hash", "line")
    ranged = work.settle(
        hashed.repartitionByRange(*order).select(
            "*",
            (
                (F.row_number().over(stream) == 1)
                | ~F.col("k_id").eqNullSafe(F.lag("k_id").over(stream))
            ).alias("first"),
        ),
        "lines",
    )
    repeated = work.settle(
        ranged.groupBy("h1", "h2")
        .agg(
            F.count(F.lit(1)).alias("n"),
            F.count_if("first").alias("n_docs"),
            F.max("k_id").alias("keeper"),
        )
        .where(F.col("n_docs") >= min_docs)
        .drop("n_docs"),
        "repeated",
    )
    dropped = join_counted(ranged, repeated, ["h1", "h2"], ranged.count()).where(
        ~F.col("k_id").eqNullSafe(F.col("keeper"))
    )
    one = F.lit(1).cast("bigint")
    bits = dropped.groupBy(
        "k_id", "k_hash", F.floor(F.col("line") / WORD).alias("word")
    ).agg(F.bit_or(F.call_function("shiftleft", one, F.col("line") % WORD)).alias("lost"))
    words = bits.groupBy("k_id", "k_hash").agg(
        F.sum(F.bit_count("lost")).cast("long").alias("n_dropped"),
        F.sort_array(
            F.collect_list(
                F.struct("word", F.bitwise_not(F.col("lost")).bitwiseAND(2**WORD - 1).alias("kept"))
            )
        ).alias("words"),
    )
    settled = work.settle(words, "bitmaps")
    work.drop("lines", "repeated")
    return settled


def kept_lines(lines: Column, words: Column) -> Column:
    """Lines that a keep bitmap leaves, in order; linear in their number."""
    lost = F.flatten(
        F.transform(
            words,
            lambda w: F.transform(
                F.filter(
                    F.sequence(F.lit(0), F.lit(WORD - 1)),
                    lambda b: F.call_function("shiftright", w["kept"], b).bitwiseAND(1) == 0,
                ),
                lambda b: (w["word"] * WORD + b).cast("int"),
            ),
        )
    )
    every = F.sequence(F.lit(0), F.size(lines) - 1)
    kept = F.transform(F.array_except(every, lost), lambda p: F.get(lines, p))
    return F.when(words.isNull(), lines).otherwise(kept)


def dedup_lines(docs: DataFrame, min_length: int = 20, min_docs: int = 3) -> DataFrame:
    """doc_id, n_lines, n_dropped, words (null: all lines stay), kept_text."""
    work = Workspace(docs.sparkSession, "line_dedup")
    bitmaps = keep_bitmaps(docs, work, min_length, min_docs)
    joined = join_key(keyed(docs), bitmaps, "left")
    # A one-item explode: without it the text would be split anew for every line that is kept.
    joined = joined.select("*", F.explode(F.array(split_lines(F.col("text")))).alias("lines"))
    lines = F.col("lines")
    return joined.select(
        F.col("k_id").alias("doc_id"),
        F.size(lines).cast("long").alias("n_lines"),
        F.coalesce("n_dropped", F.lit(0).cast("long")).alias("n_dropped"),
        "words",
        F.when(F.col("words").isNull(), F.coalesce("text", F.lit("")))
        .otherwise(F.array_join(kept_lines(lines, F.col("words")), "\n"))
        .alias("kept_text"),
    )
