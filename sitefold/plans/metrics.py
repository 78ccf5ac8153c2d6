"""Run counters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F


def _catalog_counters() -> list[Column]:
    def number(outcome: str) -> Column:
        return F.count_if(F.col("outcome") == outcome)

    return [
        F.count(F.lit(1)).alias("scanned"),
        number("written").alias("written"),
        number("non_mobile").alias("skipped_non_mobile"),
        number("blocked").alias("blocked"),
        number("failed").alias("failed"),
    ]


def catalog_metrics(outcomes: DataFrame) -> DataFrame:
    """One row of counters. Missing pages and duplicates count as scanned only."""
    return outcomes.agg(*_catalog_counters())


def observe_catalog(outcomes: DataFrame) -> tuple[DataFrame, Observation]:
    """The same counters, taken while the outcomes are written: no second pass."""
    run = Observation()
    return outcomes.observe(run, *_catalog_counters()), run


def observe_reviews(reviews: DataFrame) -> tuple[DataFrame, Observation]:
    """``total_reviews``, taken while the reviews are written."""
    run = Observation()
    return reviews.observe(run, F.count(F.lit(1)).alias("total_reviews")), run


def review_counts(reviews: DataFrame) -> DataFrame:
    """Rows written per product."""
    return reviews.groupBy("product_id").agg(F.count("*").alias("n_reviews"))


def review_totals(reviews: DataFrame, products: DataFrame) -> DataFrame:
    """One row: reviews written, products failed. ``products`` carries ``outcome``."""
    written = reviews.agg(F.count("*").alias("total_reviews"), F.lit(0).alias("failed_products"))
    failed = products.filter("outcome = 'failed'").agg(
        F.lit(0).alias("total_reviews"), F.count("*").alias("failed_products")
    )
    return written.unionByName(failed).agg(
        F.sum("total_reviews").alias("total_reviews"),
        F.sum("failed_products").alias("failed_products"),
    )
