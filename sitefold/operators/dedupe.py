"""First-wins de-duplication, incremental anti-joins and limits.

A first-wins filter is ``row_number() = 1``: Spark then keeps only the first row
per key on each task before the shuffle (window group limit), so a key that holds
a large share of the rows reaches the reducer as one row per task.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sitefold.functions.text import (
    CROSS_PAGE_KEY_CHARS,
    IN_PAGE_KEY_CHARS,
    in_page_review_key,
    review_key,
)
from sitefold.functions.urls import canonical_product_id, canonicalize_url
from sitefold.session import ordered_ids, settle

# Most rows that one task may collect for a limit.
TOP_LIMIT = 1_000
# monotonically_increasing_id: partition number above, row number in the low bits.
_ROW_BITS = 33


def _columns(names: str | Column | Sequence) -> list[Column]:
    names = [names] if isinstance(names, (str, Column)) else list(names)
    return [F.col(n) if isinstance(n, str) else n for n in names]


def first_per_key(df: DataFrame, key: str | Sequence, order: str | Sequence) -> DataFrame:
    """Keep the first row of each key."""
    window = Window.partitionBy(*_columns(key)).orderBy(*_columns(order))
    return df.withColumn("_rn", F.row_number().over(window)).filter("_rn = 1").drop("_rn")


def dedupe_in_page(
    reviews: DataFrame,
    page: str | Sequence,
    order: str | Sequence,
    chars: int | None = IN_PAGE_KEY_CHARS,
) -> DataFrame:
    """First review of equal reviewer, date, title and leading (None: whole) text within a page."""
    names = ("reviewer", "review_date", "title", "review_text")
    keyed = reviews.withColumn("_key", in_page_review_key(*[F.col(n) for n in names], chars=chars))
    return first_per_key(keyed, [*_columns(page), F.col("_key")], order).drop("_key")


def with_review_key(reviews: DataFrame, chars: int | None = CROSS_PAGE_KEY_CHARS) -> DataFrame:
    """Adds ``review_id_hash`` over ``chars`` of the text, or the whole text for None."""
    names = ("product_id", "reviewer", "review_date", "title", "review_text")
    key = review_key(*[F.col(n) for n in names], chars=chars)
    return reviews.withColumn("review_id_hash", key)


def dedupe_reviews(
    reviews: DataFrame,
    order: str | Sequence = ("review_page", "pos"),
    chars: int | None = CROSS_PAGE_KEY_CHARS,
) -> DataFrame:
    """First review of equal key over all pages; adds ``review_id_hash``."""
    return first_per_key(with_review_key(reviews, chars), "review_id_hash", order)


def dedupe_urls(urls: DataFrame, url: str = "url", order: str = "ordinal") -> DataFrame:
    """Canonical URLs with the lowest ordinal each: (ordinal, product_url)."""
    canonical = urls.select(F.col(order), canonicalize_url(F.col(url)).alias("product_url"))
    return canonical.groupBy("product_url").agg(F.min(order).alias("ordinal"))


def candidate_key(url: Column) -> Column:
    """Product id of a canonical URL, or the URL; tagged so that the two never meet."""
    product_id = canonical_product_id(url)
    return F.when(product_id != "", F.concat(F.lit("i:"), product_id)).otherwise(
        F.concat(F.lit("u:"), url)
    )


def dedupe_candidates(
    candidates: DataFrame, url: str = "product_url", order: str | Sequence = "ordinal"
) -> DataFrame:
    """First candidate per URL and per product id.

    The id is a function of the URL, so one first-wins pass on the tagged key does both.
    """
    keyed = candidates.withColumn("_key", candidate_key(F.col(url)))
    return first_per_key(keyed, "_key", order).drop("_key")


def dedupe_catalog(
    products: DataFrame,
    order: str | Sequence = "ordinal",
    include_accessories: bool = False,
) -> DataFrame:
    """First kept product per id; a rejected row never hides a later one."""
    kept = products if include_accessories else products.filter("is_mobile")
    return first_per_key(kept, "product_id", order)


def only_new(df: DataFrame, seen: DataFrame, key: str) -> DataFrame:
    """Rows whose key is not among the seen keys."""
    return df.join(seen.select(key), key, "left_anti")


def first_in_order(
    df: DataFrame, n: int | None, *order: str | Column, name: str = "ordinal", top_limit: int = TOP_LIMIT
) -> DataFrame:
    """The first ``n`` rows (None: all) in the given order, numbered by a rising ``name``.

    Up to ``top_limit`` rows, every task sends its first ``n`` rows to one task. Beyond
    that the rows are sorted across all tasks, and the cut follows from the row counts
    of the sorted partitions, so no task sees more than its share.
    """
    if n is None:
        return ordered_ids(df, *order, name=name)
    if n <= top_limit:
        top = df.orderBy(*order).limit(n)
        return top.withColumn(name, F.monotonically_increasing_id())
    placed = settle(ordered_ids(df, *order, name=name), "ordered-rows")
    part = F.shiftright(name, _ROW_BITS)
    left = n
    for row in placed.groupBy(part.alias("part")).count().orderBy("part").collect():
        if left < row["count"]:
            return placed.filter(F.col(name) < (row["part"] << _ROW_BITS) + left)
        left -= row["count"]
    return placed


def first_rows(df: DataFrame, n: int, *order: str | Column, **options) -> DataFrame:
    """The first ``n`` rows in the given order."""
    return first_in_order(df, n, *order, name="_place", **options).drop("_place")


def limit_shards(shards: DataFrame, max_shards: int | None) -> DataFrame:
    """First shards over all indexes in reading order; 0 or None means all."""
    return first_rows(shards, max_shards, "index_ord", "shard_ord") if max_shards else shards
