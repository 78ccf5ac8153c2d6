"""Candidate discovery: search pages, sitemaps, seed link graph, and the choice.

Every branch returns (ordinal, product_url, source_sitemap, sitemap_lastmod);
ordinals rise in discovery order.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sitefold import settings as S
from sitefold.functions.classify import expands, is_blocked, is_candidate_url
from sitefold.functions.text import normalize_space
from sitefold.functions.urls import canonical_product_url, path_of
from sitefold.operators.dedupe import candidate_key, first_in_order, first_per_key, limit_shards
from sitefold.operators.parse_pages import page_hrefs, resolve_links
from sitefold.operators.prefilter import only_wanted
from sitefold.operators.stops import search_cutoff
from sitefold.session import ordered_ids, settle
from sitefold.settings import CatalogOptions

CANDIDATE_COLUMNS = ("ordinal", "product_url", "source_sitemap", "sitemap_lastmod")
CANDIDATE_SCHEMA = (
    "ordinal long, product_url string, source_sitemap string, sitemap_lastmod string"
)


def wanted_url(url: Column, options: CatalogOptions) -> Column:
    """Phone-like product URL, or any with the loose filter."""
    if options.loose_url_filter:
        return F.lit(True)
    return is_candidate_url(url, options.include_hints, options.exclude_hints)


def _finish(found: DataFrame, order: list[str], options: CatalogOptions, name: str) -> DataFrame:
    """First-wins on URL and id, ordinals in that order, at most ``max_candidates`` rows."""
    keyed = found.withColumn("_key", candidate_key(F.col("product_url")))
    firsts = first_per_key(keyed, "_key", order)
    numbered = first_in_order(firsts, options.max_candidates, *order)
    return settle(numbered.select(*CANDIDATE_COLUMNS), name)


def search_candidates(pages: DataFrame, options: CatalogOptions) -> DataFrame:
    """Product links of landed search result pages.

    ``pages``: search_ord, search_url, page_no, final_url, status, html.
    """
    last = F.lit(True)
    if options.search_pages is not None:
        last = F.col("page_no") <= options.search_pages
    pages = pages.filter(
        (F.col("page_no") >= 1)
        & last
        & ~F.coalesce(F.col("status").isin(*S.STATUS_UNAVAILABLE), F.lit(True))
    )
    flagged = pages.withColumn("blocked", is_blocked(F.col("status"), F.col("html")))
    # Settled without html: the walls and the links both read it.
    hrefs = settle(page_hrefs(flagged.drop("status")), "search-pages")
    links = resolve_links(
        search_cutoff(hrefs), options.domain, exact_domain=options.exact_domain
    )
    found = links.select(
        "search_ord",
        "page_no",
        F.col("link").alias("product_url"),
        F.col("search_url").alias("source_sitemap"),
        F.concat(F.lit("search_page_"), F.col("page_no").cast("string")).alias("sitemap_lastmod"),
    ).filter(wanted_url(F.col("product_url"), options))
    return _finish(found, ["search_ord", "page_no", "product_url"], options, "search-candidates")


def sitemap_candidates(
    shards: DataFrame, urls: DataFrame, options: CatalogOptions
) -> DataFrame:
    """Product URLs of the sitemap shards that the indexes list.

    ``shards``: index_ord, shard_ord, loc, lastmod. ``urls``: shard_url, url_ord, loc.
    A shard without rows in ``urls`` still counts towards ``max_shards``.
    """
    chosen = limit_shards(shards, options.max_shards).select(
        "index_ord",
        "shard_ord",
        F.col("loc").alias("shard_url"),
        F.col("lastmod").alias("sitemap_lastmod"),
    )
    found = (
        urls.join(chosen, "shard_url")
        .select(
            "index_ord",
            "shard_ord",
            "url_ord",
            canonical_product_url(F.col("loc")).alias("product_url"),
            F.col("shard_url").alias("source_sitemap"),
            "sitemap_lastmod",
        )
        .filter(wanted_url(F.col("product_url"), options))
    )
    return _finish(found, ["index_ord", "shard_ord", "url_ord"], options, "sitemap-candidates")


def reached_shard_limit(shards: DataFrame, options: CatalogOptions) -> bool:
    """More shards are listed than may be read, which ends discovery."""
    if not options.max_shards:
        return False
    return shards.limit(options.max_shards + 1).count() > options.max_shards


def links_of(pages: DataFrame, front: DataFrame, options: CatalogOptions) -> tuple[DataFrame, int]:
    """Wanted product links of the front's pages, and the number of pages parsed for them.

    ``front``: src, _from (settled). Comes back: _from, product_url, source_sitemap, _key. Only
    pages of the front are parsed, and no html shuffles.
    """
    reached = only_wanted(pages, F.col("request_url"), front, "src")
    # One narrow column; an observed metric is lost where a plan turns out to be empty.
    parsed = reached.select("request_url").count()
    # html is blanked rather than filtered: a pushed-down filter would read it twice.
    closed = ~expands(F.col("status"), F.col("html"))
    open_pages = reached.select(
        F.col("request_url").alias("src"),
        "final_url",
        F.when(closed, F.lit("")).otherwise(F.col("html")).alias("html"),
    )
    links = resolve_links(
        page_hrefs(open_pages), options.domain, exact_domain=options.exact_domain
    )
    edges = links.select("src", F.col("link").alias("dst"))
    wanted = edges.filter(wanted_url(F.col("dst"), options))
    # The front is read from files, so the planner knows its size and broadcasts a small one.
    found = wanted.join(front, "src").select(
        "_from",
        F.col("dst").alias("product_url"),
        F.col("src").alias("source_sitemap"),
        candidate_key(F.col("dst")).alias("_key"),
    )
    return found, parsed


@dataclass(frozen=True)
class Traversal:
    """``candidates`` in queue order, and how many pages each level parsed."""

    candidates: DataFrame
    pages_parsed: tuple[int, ...]


def traverse(pages: DataFrame, seeds: DataFrame, options: CatalogOptions) -> Traversal:
    """Breadth-first link traversal from seed products, to ``seed_max_depth`` or the end.

    ``seeds``: ordinal, url. A step parses the pages of the newest level, which are met once
    in the whole run, and anti-joins their links with all keys reached so far. Each level is
    written out, so the plan stays short and a lost executor never repeats earlier levels.
    """
    start = seeds.select(
        F.col("ordinal").alias("_from"),
        canonical_product_url(normalize_space(F.col("url"))).alias("product_url"),
        F.lit("seed").alias("source_sitemap"),
    ).filter(
        path_of(F.col("product_url")).contains(S.PRODUCT_PATH_MARKER)
        & wanted_url(F.col("product_url"), options)
    ).withColumn("_key", candidate_key(F.col("product_url")))
    levels: list[DataFrame] = []
    counters: list[int] = []
    found, total = start, 0
    depth = 0
    while True:
        level = _new_level(found, levels, depth)
        size = level.count()
        if size:
            levels.append(level)
        total += size
        enough = options.max_candidates is not None and total >= options.max_candidates
        if not size or depth == options.seed_max_depth or enough:
            break
        depth += 1
        front = level.select(
            F.col("product_url").alias("src"), F.col("ordinal").alias("_from")
        )
        found, parsed = links_of(pages, front, options)
        counters.append(parsed)
    parsed_pages = tuple(counters)
    if not levels:
        return Traversal(level.select(*CANDIDATE_COLUMNS), parsed_pages)
    reached = reduce(DataFrame.unionByName, levels)
    reached = reached.withColumnRenamed("ordinal", "_place")
    numbered = first_in_order(reached, options.max_candidates, "_depth", "_place")
    settled = settle(numbered.select(*CANDIDATE_COLUMNS), "seed-candidates")
    return Traversal(settled, parsed_pages)


def seed_candidates(pages: DataFrame, seeds: DataFrame, options: CatalogOptions) -> DataFrame:
    """Candidates of ``traverse``."""
    return traverse(pages, seeds, options).candidates


def _new_level(found: DataFrame, levels: list[DataFrame], depth: int) -> DataFrame:
    """First arrivals that no earlier level reached, numbered in queue order."""
    fresh = first_per_key(found, "_key", ["_from", "product_url"])
    if levels:
        reached = reduce(DataFrame.unionByName, [x.select("_key") for x in levels])
        fresh = fresh.join(reached, "_key", "left_anti")
    fresh = fresh.withColumn("_depth", F.lit(depth)).withColumn(
        "sitemap_lastmod", F.lit(f"seed_depth_{depth}")
    )
    # The queue order is that of the parents, then of the sorted links.
    return settle(ordered_ids(fresh, "_from", "product_url"), f"seed-level-{depth}")


def discover(
    options: CatalogOptions,
    search_pages: DataFrame | None = None,
    shards: DataFrame | None = None,
    shard_urls: DataFrame | None = None,
    link_pages: DataFrame | None = None,
    seeds: DataFrame | None = None,
) -> DataFrame:
    """Candidates of one mode, or in ``auto`` of the first that yields any."""
    mode = options.discovery_mode
    options.check_search_urls(search_pages is not None)
    if mode in ("auto", "search") and search_pages is not None:
        found = search_candidates(search_pages, options)
        if mode == "search" or not found.isEmpty():
            return found
    if mode in ("auto", "sitemap") and shards is not None and shard_urls is not None:
        found = sitemap_candidates(shards, shard_urls, options)
        if mode == "sitemap" or not found.isEmpty() or reached_shard_limit(shards, options):
            return found
    if mode in ("auto", "seed") and link_pages is not None and seeds is not None:
        return seed_candidates(link_pages, seeds, options)
    given = [x for x in (search_pages, shards, link_pages, seeds) if x is not None]
    if mode != "auto" or not given:
        raise ValueError(f"discovery_mode '{mode}' lacks its input tables")
    # Every branch that has input found nothing.
    return given[0].sparkSession.createDataFrame([], CANDIDATE_SCHEMA)
