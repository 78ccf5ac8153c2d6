"""A bit array of wanted keys, of bounded size, that filters rows before costly work.

The array is a table of 64-bit words built by partial aggregates, so it merges over any number
of tasks and holds at most ``WORDS`` rows whatever the number of keys; that bound is what allows
its broadcast. A row whose bit is set may be wanted, one whose bit is not set is not: the filter
only saves work, an exact join must follow. With more keys more rows pass.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sitefold.session import is_small, settle, text_bytes

# 2**20 words are 64 million bits, some 40 MB as a broadcast table.
WORDS = 1 << 20


def _place(key: Column, words: int) -> tuple[Column, Column]:
    """Word of a key, and its bit there."""
    at = F.pmod(F.xxhash64(F.lit("bit"), key), F.lit(words * 64))
    bit = F.call_function("shiftleft", F.lit(1).cast("bigint"), (at % 64).cast("int"))
    return F.floor(at / 64), bit


def key_bits(keys: DataFrame, key: Column, words: int = WORDS) -> DataFrame:
    """_word, _bits of the keys; settle it before use. Null keys have a bit of their own."""
    word, bit = _place(key, words)
    return keys.groupBy(word.alias("_word")).agg(F.bit_or(bit).alias("_bits"))


def _hit(key: Column, bits: DataFrame, words: int) -> Column:
    word, bit = _place(key, words)
    return (word == bits["_word"]) & (bits["_bits"].bitwiseAND(bit) != 0)


def may_hold(df: DataFrame, key: Column, bits: DataFrame, words: int = WORDS) -> DataFrame:
    """Rows of ``df`` whose key may be one of those in ``bits``."""
    return df.join(F.broadcast(bits), _hit(key, bits, words), "left_semi")


def surely_without(df: DataFrame, key: Column, bits: DataFrame, words: int = WORDS) -> DataFrame:
    """The other rows of ``df``."""
    return df.join(F.broadcast(bits), _hit(key, bits, words), "left_anti")


def only_wanted(rows: DataFrame, key: Column, wanted: DataFrame, wanted_key: str) -> DataFrame:
    """Rows whose text key is wanted, before anything is parsed; no row of ``rows`` shuffles.

    ``wanted`` is read twice and should be settled. A list that measures small is broadcast and
    decides exactly; of a longer one the bit array is, and some more rows may pass.
    """
    keys = wanted.select(F.col(wanted_key).alias("_wanted"))
    if is_small(keys, text_bytes(F.col("_wanted"))):
        return rows.join(F.broadcast(keys), key == F.col("_wanted"), "left_semi")
    bits = settle(key_bits(keys, F.col("_wanted")), "wanted-bits")
    return may_hold(rows, key, bits)
