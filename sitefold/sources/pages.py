"""Landed pages, the input of all page operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# request_url: URL asked for; final_url: after redirects, base of relative links;
# status: HTTP status, null when nothing was received; html: page text.
PAGE_SCHEMA = "request_url string, final_url string, status int, html string"


def read_pages(spark: SparkSession, path: str) -> DataFrame:
    """Landed pages from Parquet.

    Parsing costs far more than reading: ``build_session`` sets small splits
    (``spark.sql.files.maxPartitionBytes``), so pages get many tasks without a shuffle of html.
    """
    return spark.read.parquet(path)


def stream_pages(spark: SparkSession, path: str, schema, **options: str) -> DataFrame:
    return spark.readStream.schema(schema).options(**options).parquet(path)


def as_landed(pages: DataFrame, url: str = "url") -> DataFrame:
    """Give a plain (url, html) table the landed columns, all received with status 200."""
    return pages.select(
        "*",
        F.col(url).alias("request_url"),
        F.col(url).alias("final_url"),
        F.lit(200).alias("status"),
    )
