"""Review job: landed review pages to new, de-duplicated reviews."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sitefold.functions.text import iso_utc
from sitefold.functions.urls import canonicalize_url, extract_pid
from sitefold.operators.dedupe import dedupe_urls, first_per_key, only_new, with_review_key
from sitefold.operators.parse_pages import explode_reviews, review_lists
from sitefold.operators.prefilter import only_wanted
from sitefold.operators.refused import refused_inputs, review_page_reason
from sitefold.operators.requests import requested_page, review_base
from sitefold.operators.stops import cut_pages, page_cuts
from sitefold.session import is_small, settle, text_bytes
from sitefold.settings import FIRST_ERROR_STATUS, REVIEW_COLUMNS, ReviewOptions


@dataclass(frozen=True)
class ReviewRun:
    """``reviews`` to append, and per product URL its ``last_page`` and ``outcome``.

    ``refused``: pages and JSON-LD documents that were not read, a pass of its own when it is
    asked for.
    """

    reviews: DataFrame
    products: DataFrame
    refused: DataFrame


def parse_landed(
    pages: DataFrame, max_pages: int | None, listed: DataFrame | None = None, with_id: bool = True
) -> DataFrame:
    """Parse review pages once and settle the narrow result.

    ``pages``: product_url, page_no, status, html. One row per page comes back, with
    ``reviews``, ``n_rows`` and ``failed``; ``html`` is not carried any further. A page without
    a text or with an HTTP error failed. Of a page that landed several times one that did
    not fail counts, of these the one with most reviews. With ``listed`` (product_url, settled)
    pages of other products are left out before parsing, but for a few beyond the size that
    can be broadcast. ``product_id`` is read from the URL unless ``with_id`` is false.
    """
    wanted = F.col("page_no") >= 1
    if max_pages is not None:
        wanted &= F.col("page_no") <= max_pages
    bad = F.col("status").isNull() | (F.col("status") >= FIRST_ERROR_STATUS)
    keyed = pages.filter(wanted).select(
        canonicalize_url(F.col("product_url")).alias("product_url"),
        F.col("page_no").cast("int").alias("review_page"),
        (bad | F.col("html").isNull()).alias("failed"),
        F.when(~bad, F.col("html")).alias("html"),
    )
    if listed is not None:
        keyed = only_wanted(keyed, F.col("product_url"), listed, "product_url")
    lists = review_lists(keyed).withColumn("n_rows", F.size("reviews"))
    once = first_per_key(
        lists,
        ["product_url", "review_page"],
        ["failed", F.col("n_rows").desc(), F.xxhash64("reviews")],
    )
    # Settled after the choice: rows, counters and failures read it, the latter without reviews.
    if with_id:
        once = once.withColumn("product_id", extract_pid(F.col("product_url")))
    return settle(once, "review-lists")


def _page_counts(lists: DataFrame, fresh: DataFrame) -> DataFrame:
    """Rows and new rows of each page that was read."""
    page = ["product_url", "review_page"]
    new_counts = fresh.groupBy(*page).agg(F.count("*").alias("n_new"))
    all_counts = lists.filter(~F.col("failed")).groupBy(*page).agg(
        F.sum("n_rows").alias("n_rows")
    )
    return all_counts.join(new_counts, page, "left").na.fill(0, ["n_new"])


def _first_failures(lists: DataFrame, last_request: int | None) -> DataFrame:
    """First page of each product that failed, or is absent below a page that landed.

    With ``last_request`` all pages up to it were asked for, so that the one after the last
    landed page is absent too.
    """
    pages = Window.partitionBy("product_url").orderBy("review_page")
    before = F.coalesce(F.lag("review_page").over(pages), F.lit(0))
    gaps = lists.select("product_url", "review_page", "failed", before.alias("_before"))
    first_bad = F.when(F.col("review_page") > F.col("_before") + 1, F.col("_before") + 1).when(
        F.col("failed"), F.col("review_page")
    )
    after = F.lit(None).cast("int")
    if last_request is not None:
        after = F.max("review_page") + 1
        after = F.when(after <= last_request, after)
    bad = F.least(F.min(first_bad), after)
    return gaps.groupBy("product_url").agg(bad.alias("_bad")).filter("_bad IS NOT NULL")


def _product_outcomes(
    counts: DataFrame, lists: DataFrame, options: ReviewOptions, last_request: int | None
) -> DataFrame:
    """Last page read of each product, and whether a failed page ended it."""
    failures = _first_failures(lists, last_request)
    reachable = counts.join(failures, "product_url", "left").filter(
        F.col("_bad").isNull() | (F.col("review_page") < F.col("_bad"))
    )
    cuts = page_cuts(
        reachable,
        options.seen_stop_threshold,
        options.max_empty_pages,
        options.max_pages,
        product="product_url",
        page="review_page",
    )
    hit_failure = F.col("_bad").isNotNull() & ~F.coalesce("stopped", F.lit(False))
    return cuts.join(failures, "product_url", "full_outer").select(
        "product_url",
        extract_pid(F.col("product_url")).alias("product_id"),
        F.coalesce("last_page", F.lit(0)).alias("last_page"),
        F.when(hit_failure, "failed").otherwise("done").alias("outcome"),
    )


def _listed_outcomes(listed: DataFrame, products: DataFrame) -> DataFrame:
    """One outcome for each listed URL; one without any landed page failed."""
    known = products.select("product_url", "last_page", "outcome")
    return listed.join(known, "product_url", "left").select(
        "product_url",
        extract_pid(F.col("product_url")).alias("product_id"),
        F.coalesce("last_page", F.lit(0)).alias("last_page"),
        F.coalesce("outcome", F.lit("failed")).alias("outcome"),
    )


def ingest_reviews(
    pages: DataFrame,
    options: ReviewOptions = ReviewOptions(),
    seen: DataFrame | None = None,
    as_of: Column | None = None,
    urls: DataFrame | None = None,
) -> ReviewRun:
    """New reviews of each product URL up to the page where reading stops.

    ``seen`` holds ``review_id_hash`` of earlier runs. A page whose reviews are all
    known counts as stale. A failed page ends its product, and so does one that is missing
    before a later one; earlier pages stay. Where several URLs share a product id, equal
    reviews are kept once, after each URL was cut at its own last page.

    ``urls`` (ordinal, url) is the list the job was started with: only its products are
    read, those without any landed page failed, and its order decides whose review stays.
    """
    listed = None if urls is None else settle(dedupe_urls(urls), "listed-urls")
    lists = parse_landed(pages, options.max_pages, listed)
    refused = refused_inputs(pages, review_page_reason, "product_url")
    return _ingest(lists, listed, refused, options, seen, as_of)


def ingest_requested(
    pages: DataFrame,
    urls: DataFrame,
    options: ReviewOptions = ReviewOptions(),
    seen: DataFrame | None = None,
    as_of: Column | None = None,
) -> ReviewRun:
    """``ingest_reviews`` from a URL list and pages that only know the URL they were asked for.

    ``urls``: ordinal, url of products. ``pages``: request_url, status, html. The requests of a
    product share their first page's URL, by which landed pages are found before parsing and
    their narrow lists joined to the product after it; html does not shuffle. A requested page
    that never landed is a failed one, also after the last that did: up to ``max_pages``, or the
    one that follows where the number is not limited.
    """
    listed = settle(dedupe_urls(urls), "listed-urls")
    # One-item explodes: the URL forms are long expressions that must not be nested.
    first = F.explode(F.array(review_base(F.col("product_url")))).alias("_first")
    # The id is read once for a product, not for each of its pages.
    manifest = listed.select("product_url", first).select(
        "product_url",
        canonicalize_url(F.col("_first")).alias("_base"),
        extract_pid(F.col("product_url")).alias("product_id"),
    )
    manifest = settle(manifest, "request-manifest")
    asked = pages.select(
        F.explode(F.array(review_base(F.col("request_url")))).alias("product_url"),
        requested_page(F.col("request_url")).alias("page_no"),
        "status",
        "html",
    )
    bases = manifest.select(F.col("_base").alias("product_url"))
    found = parse_landed(asked, options.max_pages, bases, with_id=False)
    side = manifest
    if is_small(manifest, text_bytes(*[F.col(c) for c in manifest.columns])):
        side = F.broadcast(manifest)
    lists = found.withColumnRenamed("product_url", "_base").join(side, "_base").drop("_base")
    last_request = options.max_pages if options.max_pages is not None else 2**31 - 1
    refused = refused_inputs(pages, review_page_reason)
    return _ingest(lists, listed, refused, options, seen, as_of, last_request)


def _ingest(
    lists: DataFrame,
    listed: DataFrame | None,
    refused: DataFrame,
    options: ReviewOptions,
    seen: DataFrame | None,
    as_of: Column | None,
    last_request: int | None = None,
) -> ReviewRun:
    """The job from parsed pages on."""
    rows = with_review_key(explode_reviews(lists.filter(~F.col("failed")).drop("failed", "n_rows")))
    fresh = first_per_key(rows, ["product_url", "review_id_hash"], ["review_page", "pos"])
    if seen is not None:
        fresh = only_new(fresh, seen, "review_id_hash")
    fresh = settle(fresh, "fresh-reviews")
    products = _product_outcomes(_page_counts(lists, fresh), lists, options, last_request)
    if listed is not None:
        products = _listed_outcomes(listed, products)
    products = settle(products, "review-products")
    if options.fail_fast:
        check_no_failure(products)
    read = cut_pages(fresh, products, "product_url", "review_page")
    place = ["product_url", "review_page", "pos"]
    if listed is not None:
        read, place = read.join(listed, "product_url"), ["ordinal", *place]
    once = first_per_key(read, "review_id_hash", place)
    return ReviewRun(
        once.withColumn("scraped_at", iso_utc(as_of)).select(*REVIEW_COLUMNS),
        products,
        refused,
    )


def check_no_failure(products: DataFrame) -> None:
    """Raise when any product failed."""
    bad = products.filter("outcome = 'failed'").limit(1).collect()
    if bad:
        raise RuntimeError(f"review pages failed for product {bad[0]['product_url']}")
