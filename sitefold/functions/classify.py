"""Predicates on URLs, product texts and landed pages."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from sitefold import settings as S
from sitefold.functions.text import all_of, blank_to_null, contains_any, normalize_space
from sitefold.functions.urls import host_of, path_of


def is_candidate_url(
    url: Column,
    include: Sequence[str] = S.URL_INCLUDE_HINTS,
    exclude: Sequence[str] = S.URL_EXCLUDE_HINTS,
    marker: str = S.PRODUCT_PATH_MARKER,
) -> Column:
    """Product path with an include word and no exclude word."""
    slug = F.lower(path_of(url))
    return slug.contains(marker) & contains_any(slug, include) & ~contains_any(slug, exclude)


def classify_product(
    title: Column, category: Column, super_category: Column, sub_category: Column
) -> Column:
    """True for phones, by category first and title second."""
    place = F.lower(
        F.concat_ws(
            " ", blank_to_null(category), blank_to_null(super_category), blank_to_null(sub_category)
        )
    )
    name = F.lower(normalize_space(title))
    return (
        F.when(contains_any(place, S.EXCLUDE_CATEGORY_HINTS), False)
        .when(contains_any(name, S.EXCLUDE_TITLE_HINTS), False)
        .when(contains_any(place, S.MOBILE_CATEGORY_HINTS), True)
        .when(contains_any(name, S.PHONE_TITLE_WORDS), True)
        .otherwise(
            contains_any(name, S.PHONE_BRAND_HINTS) & contains_any(name, S.PHONE_FEATURE_WORDS)
        )
    )


def is_challenge_page(html: Column) -> Column:
    low = F.lower(html)
    return F.coalesce(all_of(low.contains(t) for t in S.CHALLENGE_TEXTS), F.lit(False))


def is_blocked(status: Column, html: Column) -> Column:
    return (status == S.STATUS_BLOCKED) & is_challenge_page(html)


def page_outcome(status: Column, html: Column) -> Column:
    """'gone', 'blocked', 'failed', or 'parsed' for every other status."""
    return (
        F.when(status.isNull() | html.isNull() | status.isin(*S.STATUS_UNAVAILABLE), "failed")
        .when(status == S.STATUS_GONE, "gone")
        .when(is_blocked(status, html), "blocked")
        .otherwise("parsed")
    )


def expands(status: Column, html: Column) -> Column:
    """The link traversal goes on from this page."""
    return (status == S.STATUS_OK) & ~is_challenge_page(html)


def is_product_link(
    url: Column, domain: str, marker: str = S.PRODUCT_PATH_MARKER, exact_domain: bool = False
) -> Column:
    """Link stays on the site and leads to a product. ``url`` is canonical."""
    host = host_of(url)
    on_site = (
        (host == domain) | host.endswith("." + domain) if exact_domain else host.contains(domain)
    )
    return on_site & path_of(url).contains(marker)
