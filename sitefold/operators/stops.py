"""Stop rules: where paging through a product or a search ends."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

# Pages of one product that a single window may see; longer ones go block by block.
PAGE_BLOCK = 4096


def _runs_in_window(states: DataFrame, product: str, page: str) -> DataFrame:
    """Lengths of the running empty and stale stretch at each page.

    Counting empty pages up to here, and that count at the last non-empty page,
    gives the stretch as their difference; the same with stale pages and the last
    page with something new. Empty pages do not break a stale stretch.
    """
    block = Window.partitionBy(product, "_block").orderBy(page).rowsBetween(
        Window.unboundedPreceding, Window.currentRow
    )
    df = states.withColumn("_empties", F.sum(F.col("empty").cast("long")).over(block))
    df = df.withColumn("_stales", F.sum(F.col("stale").cast("long")).over(block))
    df = df.withColumn("_e_mark", F.max(F.when(~F.col("empty"), F.col("_empties"))).over(block))
    return df.withColumn(
        "_s_mark",
        F.max(F.when(~F.col("empty") & ~F.col("stale"), F.col("_stales"))).over(block),
    )


def _carry_over_blocks(df: DataFrame, product: str) -> DataFrame:
    """What each block inherits: counts and marks of the blocks before it."""
    sums = df.groupBy(product, "_block").agg(
        F.max("_empties").alias("_e"),
        F.max("_stales").alias("_s"),
        F.max("_e_mark").alias("_em"),
        F.max("_s_mark").alias("_sm"),
    )
    before = Window.partitionBy(product).orderBy("_block").rowsBetween(
        Window.unboundedPreceding, -1
    )
    sums = sums.withColumn("_e0", F.coalesce(F.sum("_e").over(before), F.lit(0)))
    sums = sums.withColumn("_s0", F.coalesce(F.sum("_s").over(before), F.lit(0)))
    sums = sums.withColumn(
        "_em0", F.coalesce(F.max(F.col("_e0") + F.col("_em")).over(before), F.lit(0))
    )
    sums = sums.withColumn(
        "_sm0", F.coalesce(F.max(F.col("_s0") + F.col("_sm")).over(before), F.lit(0))
    )
    return sums.select(product, "_block", "_e0", "_s0", "_em0", "_sm0")


def page_cuts(
    pages: DataFrame,
    seen_stop_threshold: int,
    max_empty_pages: int,
    max_pages: int | None,
    product: str = "product_id",
    page: str = "page_no",
    block: int = PAGE_BLOCK,
) -> DataFrame:
    """Last page read of each product: (product, last_page, stopped).

    ``pages`` has one row per product and page with ``n_rows`` and ``n_new``.
    Reading stops at the page that completes a stretch of ``max_empty_pages`` empty
    pages or of ``seen_stop_threshold`` pages without anything new.
    """
    last = F.lit(True) if max_pages is None else F.col(page) <= max_pages
    states = pages.filter((F.col(page) >= 1) & last).select(
        product,
        page,
        (F.col("n_rows") == 0).alias("empty"),
        ((F.col("n_rows") > 0) & (F.col("n_new") == 0)).alias("stale"),
        F.floor((F.col(page) - 1) / block).alias("_block"),
    )
    df = _runs_in_window(states, product, page)
    if max_pages is None or max_pages > block:
        df = df.join(_carry_over_blocks(df, product), [product, "_block"])
    else:
        # All pages of a product fit one block, nothing to carry.
        df = df.select("*", *[F.lit(0).alias(c) for c in ("_e0", "_s0", "_em0", "_sm0")])
    empty_run = F.col("_e0") + F.col("_empties") - F.coalesce(
        F.col("_e0") + F.col("_e_mark"), F.col("_em0")
    )
    stale_run = F.col("_s0") + F.col("_stales") - F.coalesce(
        F.col("_s0") + F.col("_s_mark"), F.col("_sm0")
    )
    stops = (F.col("empty") & (empty_run >= max_empty_pages)) | (
        ~F.col("empty") & (stale_run >= seen_stop_threshold)
    )
    ends = df.groupBy(product).agg(
        F.min(F.when(stops, F.col(page))).alias("_cut"), F.max(page).alias("_end")
    )
    return ends.select(
        product,
        F.coalesce("_cut", "_end").alias("last_page"),
        F.col("_cut").isNotNull().alias("stopped"),
    )


def cut_pages(df: DataFrame, cuts: DataFrame, product: str, page: str) -> DataFrame:
    """Rows up to the last page read."""
    return df.join(cuts.select(product, "last_page"), product).filter(
        F.col(page) <= F.col("last_page")
    ).drop("last_page")


def search_cutoff(results: DataFrame, search: str = "search_url", page: str = "page_no") -> DataFrame:
    """Result pages before the first blocked one of each search.

    ``results`` carries a ``blocked`` flag and no page text.
    """
    walls = results.filter("blocked").groupBy(search).agg(F.min(page).alias("_wall"))
    return (
        results.join(walls, search, "left")
        .filter(F.col("_wall").isNull() | (F.col(page) < F.col("_wall")))
        .drop("_wall")
    )
