"""Catalog job: candidates and landed product pages to catalog rows and counters."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sitefold.functions.classify import page_outcome
from sitefold.functions.text import iso_utc
from sitefold.operators.dedupe import first_per_key, first_rows
from sitefold.operators.parse_pages import products
from sitefold.operators.prefilter import only_wanted
from sitefold.operators.refused import refused_inputs
from sitefold.session import settle
from sitefold.settings import CATALOG_COLUMNS, CatalogOptions


@dataclass(frozen=True)
class CatalogRun:
    """``catalog`` rows to append, ``outcomes``: one row per candidate looked at.

    ``refused``: pages of candidates and JSON-LD documents there that were not read, a pass of
    its own when it is asked for.
    """

    catalog: DataFrame
    outcomes: DataFrame
    refused: DataFrame


def parse_candidates(candidates: DataFrame, pages: DataFrame) -> DataFrame:
    """Each candidate with its parsed page: product columns and ``outcome``.

    Pages of no candidate are left out before parsing: by a broadcast of few candidates, by a
    bit array of many. Only the narrow product rows are shuffled; html never is.
    """
    landed = only_wanted(
        pages.select("request_url", "status", "html"), F.col("request_url"), candidates, "product_url"
    )
    flagged = landed.select(
        "request_url",
        page_outcome(F.col("status"), F.col("html")).alias("outcome"),
        F.col("html"),
    ).withColumn("html", F.when(F.col("outcome") == "parsed", F.col("html")))
    parsed = products(flagged).withColumnRenamed("product_url", "_page_url")
    # A page that landed several times counts once: parsed before failed, then by content.
    row = F.struct(*[c for c in parsed.columns if c not in ("request_url", "outcome")])
    landed_again = [F.col("outcome") != "parsed", "outcome", F.xxhash64(row)]
    parsed = first_per_key(parsed, "request_url", landed_again)
    matched = candidates.join(
        parsed, candidates["product_url"] == parsed["request_url"], "left"
    ).drop("product_url", "request_url")
    return matched.withColumnRenamed("_page_url", "product_url").withColumn(
        "outcome", F.coalesce("outcome", F.lit("failed"))
    )


def _with_matches(df: DataFrame, side: DataFrame) -> DataFrame:
    """Left join on ``product_id``; rows without an id, which match nothing, do not shuffle."""
    named = df.filter("product_id IS NOT NULL").join(side, "product_id", "left")
    return named.unionByName(df.filter("product_id IS NULL"), allowMissingColumns=True)


def decide(
    parsed: DataFrame, options: CatalogOptions, seen: DataFrame | None = None
) -> DataFrame:
    """Final ``outcome`` per candidate, as if taken one by one in ordinal order.

    A row is a duplicate when its id is in ``seen`` or an earlier row with that id was
    kept; only kept rows hide later ones.
    """
    kept = F.col("outcome") == "parsed"
    if not options.include_accessories:
        kept = kept & F.col("is_mobile")
    df = parsed.withColumn("_kept", kept)
    if seen is not None:
        known = seen.select("product_id").distinct().withColumn("_known", F.lit(True))
        df = _with_matches(df, known)
    else:
        df = df.withColumn("_known", F.lit(None).cast("boolean"))
    # A narrow partial aggregate instead of a window: one id may hold many rows.
    firsts = df.filter("_kept AND _known IS NULL").groupBy("product_id").agg(
        F.min("ordinal").alias("_first")
    )
    df = _with_matches(df, firsts)
    outcome = (
        F.when(F.col("outcome") != "parsed", F.col("outcome"))
        .when(F.col("_known") | (F.col("_first") < F.col("ordinal")), "duplicate")
        .when(F.col("_kept"), "written")
        .otherwise("non_mobile")
    )
    return df.withColumn("outcome", outcome).drop("_kept", "_known", "_first")


def export_catalog(
    candidates: DataFrame,
    pages: DataFrame,
    options: CatalogOptions,
    seen: DataFrame | None = None,
    as_of: Column | None = None,
) -> CatalogRun:
    """Catalog rows of the candidates' pages; ``max_products`` may end the search earlier.

    ``seen`` holds ``product_id`` of earlier runs.
    """
    parsed = settle(parse_candidates(candidates, pages), "parsed-candidates")
    decided = settle(decide(parsed, options, seen), "catalog-outcomes")
    outcomes = decided
    if options.max_products is not None:
        rows = decided.filter("outcome = 'written'")
        written = first_rows(rows, options.max_products, "ordinal")
        # Looking at candidates ends with the last row that may be written.
        end = written.agg(F.count("*").alias("n"), F.max("ordinal").alias("last")).first()
        if end["n"] >= options.max_products:
            outcomes = decided.filter(F.col("ordinal") <= end["last"])
    catalog = (
        outcomes.filter("outcome = 'written'")
        .withColumn("scraped_at", iso_utc(as_of))
        .select("ordinal", *CATALOG_COLUMNS)
    )
    refused = refused_inputs(only_wanted(pages, F.col("request_url"), candidates, "product_url"))
    return CatalogRun(catalog, outcomes, refused)
