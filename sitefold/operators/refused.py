"""What a job did not read, and why: pages, JSON-LD documents and sitemap files.

Each function gives rows (source, part, stage, reason), row by row from its input and without a
shuffle: ``source`` is the URL or file, ``part`` the number of the document within a page.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sitefold.functions import jsonld as J
from sitefold.functions import pages as P
from sitefold.functions.classify import page_outcome
from sitefold.functions.text import strip
from sitefold.operators.parse_pages import staged
from sitefold.settings import FIRST_ERROR_STATUS
from sitefold.sources.sitemaps import parsed_documents

REFUSED_COLUMNS = ("source", "part", "stage", "reason")


def _rows(df: DataFrame, source: Column, part: Column, stage: str, reason: Column) -> DataFrame:
    rows = df.select(
        source.alias("source"), part.cast("int").alias("part"), F.lit(stage).alias("stage"),
        reason.alias("reason"),
    )
    return rows.where("reason IS NOT NULL")


def _status(status: Column) -> Column:
    return F.concat(F.lit("status "), status.cast("string"))


def review_page_reason(status: Column, html: Column) -> Column:
    """Why a review page is not read; null for one that is."""
    return (
        F.when(status.isNull(), "no response")
        .when(status >= FIRST_ERROR_STATUS, _status(status))
        .when(html.isNull(), "no text")
    )


def product_page_reason(status: Column, html: Column) -> Column:
    """Why a product page is not read; null for one that is."""
    outcome = page_outcome(status, html)
    return (
        F.when(outcome == "blocked", "bot check")
        .when(outcome == "gone", _status(status))
        .when((outcome == "failed") & status.isNull(), "no response")
        .when((outcome == "failed") & html.isNull(), "no text")
        .when(outcome == "failed", _status(status))
    )


def refused_pages(pages: DataFrame, reason=product_page_reason, source: str = "request_url") -> DataFrame:
    why = reason(F.col("status"), F.col("html"))
    return _rows(pages, F.col(source), F.lit(None), "page", why)


def refused_documents(
    pages: DataFrame, reason=product_page_reason, source: str = "request_url"
) -> DataFrame:
    """JSON-LD texts that no value comes from, of the pages that are read."""
    read = pages.where(reason(F.col("status"), F.col("html")).isNull())
    texts = read.select(F.col(source).alias("source"), "html").selectExpr(
        "source", f"posexplode({P.jsonld_texts('html')}) AS (part, document)"
    )
    texts = staged(texts, _n=f"coalesce(size({J.parse_items('document')}), 0)")
    why = F.when(
        F.col("_n") != 1,
        F.when(F.octet_length("document") >= J.SIZE_LIMIT, "over the size limit or not JSON").otherwise(
            "not JSON"
        ),
    )
    return _rows(texts, F.col("source"), F.col("part"), "json-ld", why)


def refused_sitemaps(documents: DataFrame, schema: str, source: str = "file") -> DataFrame:
    """Landed sitemap documents that are not read; ``schema`` as for their parsing."""
    status = F.col("status") if "status" in documents.columns else F.lit(200)
    rows = parsed_documents(documents.withColumn("_status", status), schema)
    why = (
        F.when(F.col("_status").isNull(), "no response")
        .when(F.col("_status") >= FIRST_ERROR_STATUS, _status(F.col("_status")))
        .when(F.col("xml").isNull() | (strip(F.col("xml")) == ""), "no text")
        .when(F.col("_doc._corrupt_record").isNotNull(), "not XML")
    )
    return _rows(rows, F.col(source), F.lit(None), "sitemap", why)


def refused_inputs(pages: DataFrame, reason=product_page_reason, source: str = "request_url") -> DataFrame:
    """Pages and JSON-LD documents that are not read."""
    return refused_pages(pages, reason, source).unionByName(refused_documents(pages, reason, source))
