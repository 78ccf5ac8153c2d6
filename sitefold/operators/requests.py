"""Page requests and input lists: which pages a job needs."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sitefold.functions.urls import extract_pid, to_review_url, with_page_param


def review_requests(products: DataFrame, max_pages: int, url: str = "product_url") -> DataFrame:
    """Each product URL times pages 1..n: ``product_id``, ``page_no``, ``request_url``."""
    return (
        products.withColumn("product_id", extract_pid(F.col(url)))
        .withColumn("page_no", F.explode(F.sequence(F.lit(1), F.lit(max_pages))))
        .withColumn("request_url", to_review_url(F.col(url), F.col("page_no")))
    )


def review_base(url: Column) -> Column:
    """First review page of a product or review URL: what all requests of a product share."""
    return to_review_url(url, F.lit(1))


def requested_page(request_url: Column) -> Column:
    """Page number a review request asks for; 1 without one."""
    number = F.regexp_extract(request_url, r"[?&]page=([0-9]{1,9})(?:[&#]|$)", 1)
    return F.coalesce(number.try_cast("int"), F.lit(1))


def search_requests(searches: DataFrame, search_pages: int, url: str = "search_url") -> DataFrame:
    """Each search URL times result pages 1..n."""
    last = F.lit(max(1, search_pages))
    return searches.withColumn("page_no", F.explode(F.sequence(F.lit(1), last))).withColumn(
        "request_url", with_page_param(F.col(url), F.col("page_no"))
    )


def union_inputs(*sources: DataFrame) -> DataFrame:
    """URL lists one after another: (ordinal, url) frames get a leading ``source_no``."""
    numbered = [s.select(F.lit(i).alias("source_no"), "ordinal", "url") for i, s in enumerate(sources)]
    return reduce(DataFrame.unionByName, numbered)
