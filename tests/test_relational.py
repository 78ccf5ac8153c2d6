"""De-duplication, stop rules, discovery: against plain loops, and their plans."""

import random

import pytest
from pyspark.sql import functions as F

from sitefold.operators import dedupe as D
from sitefold.operators import discover as G
from sitefold.operators import stops as T
from sitefold.settings import CatalogOptions


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_first_per_key_limits_before_the_shuffle(spark):
    rows = spark.range(1000).selectExpr("id % 3 AS k", "id")
    plan = plan_of(D.first_per_key(rows, "k", "id"))
    assert plan.index("WindowGroupLimit") < plan.index("Exchange")
    assert plan.count("WindowGroupLimit") == 2


def test_hot_key_sends_one_row_per_task(spark):
    """A third of all rows share one key; the shuffle still carries few rows."""
    rows = spark.range(0, 30000, 1, 4).selectExpr("IF(id % 3 = 0, -1, id) AS k", "id")
    first = D.first_per_key(rows, "k", "id")
    assert first.count() == 20001
    assert first.filter("k = -1").first()["id"] == 0


@pytest.mark.parametrize("parts", [1, 7])
def test_dedupe_does_not_depend_on_partitioning(spark, parts):
    rows = spark.range(200).select(
        F.col("id").alias("pos"),
        F.lit(1).alias("review_page"),
        F.lit("P").alias("product_id"),
        F.concat(F.lit("u"), (F.col("id") % 7).cast("string")).alias("reviewer"),
        F.lit("").alias("review_date"),
        F.lit("").alias("title"),
        F.lit("text").alias("review_text"),
    )
    kept = D.dedupe_reviews(rows.repartition(parts))
    assert sorted(r.pos for r in kept.collect()) == list(range(7))


def plain_stop(pages, stale_limit, empty_limit):
    """The stop rules page by page; pages = [(n_rows, n_new), ...]."""
    empties = stales = 0
    for page, (n_rows, n_new) in enumerate(pages, start=1):
        if n_rows == 0:
            empties += 1
            if empties >= empty_limit:
                return page, True
            continue
        empties = 0
        stales = stales + 1 if n_new == 0 else 0
        if stales >= stale_limit:
            return page, True
    return len(pages), False


@pytest.mark.parametrize("block", [3, 4096])
@pytest.mark.parametrize("limits", [(1, 1), (2, 1), (2, 2), (3, 4)])
def test_stop_rules_against_loop(spark, block, limits):
    rng = random.Random(block * 10 + sum(limits))
    states = [(0, 0), (2, 0), (2, 1)]
    products = [
        [states[rng.choice((0, 1, 1, 2, 2, 2))] for _ in range(rng.randint(1, 25))]
        for _ in range(250)
    ]
    rows = [
        (i, page, n_rows, n_new)
        for i, pages in enumerate(products)
        for page, (n_rows, n_new) in enumerate(pages, start=1)
    ]
    frame = spark.createDataFrame(rows, "product_id int, page_no int, n_rows int, n_new int")
    cuts = T.page_cuts(frame, *limits, max_pages=5000, block=block)
    got = {r.product_id: (r.last_page, r.stopped) for r in cuts.collect()}
    assert got == {i: plain_stop(p, *limits) for i, p in enumerate(products)}


def test_page_limit(spark):
    rows = [(1, page, 1, 1) for page in range(1, 30)]
    frame = spark.createDataFrame(rows, "product_id int, page_no int, n_rows int, n_new int")
    row = T.page_cuts(frame, 2, 1, max_pages=10).first()
    assert (row.last_page, row.stopped) == (10, False)


@pytest.mark.parametrize("n", [1, 7, 50, 99, 100, 500])
def test_first_rows_beyond_the_one_task_limit(spark, n):
    rows = spark.range(100).select(F.col("id"), (99 - F.col("id")).alias("o")).repartition(5)
    one_task = D.first_rows(rows, n, "o")
    spread = D.first_rows(rows, n, "o", top_limit=0)
    assert sorted(r.id for r in spread.collect()) == sorted(r.id for r in one_task.collect())
    ids = D.first_in_order(rows, n, "o", top_limit=0).orderBy("ordinal").select("o").collect()
    assert [r.o for r in ids] == list(range(min(n, 100)))


# --- discovery --------------------------------------------------------------------

SITE = "https://www.h.com/mobile/p/"


def plain_crawl(links, seeds, depth_limit, row_limit):
    """Queue crawl: first arrival wins on URL and on the id after /p/."""
    queue = [(s, 0, "seed") for s in seeds]
    urls, ids, out = set(), set(), []
    while queue:
        url, depth, source = queue.pop(0)
        if url in urls:
            continue
        urls.add(url)
        key = url.split("/p/")[1]
        if key in ids:
            continue
        ids.add(key)
        out.append((url, source, f"seed_depth_{depth}"))
        if len(out) >= row_limit:
            break
        if depth < depth_limit:
            queue += [(x, depth + 1, url) for x in sorted(set(links.get(url, [])))]
    return out


@pytest.mark.parametrize("seed", range(3))
@pytest.mark.parametrize("row_limit", [1000, 9])
def test_seed_traversal_against_queue(spark, seed, row_limit):
    rng = random.Random(seed)
    # Two URLs per id, so that the id decides and not only the URL.
    nodes = [f"https://www.h.com/{v}mobile/p/itm{i}" for i in range(20) for v in "ab"]
    links = {n: rng.sample(nodes, rng.randint(0, 4)) for n in nodes if rng.random() < 0.9}
    seeds = rng.sample(nodes, 4)
    pages = spark.createDataFrame(
        [
            (n, n, 200, "".join(f'<a href="{x}">x</a>' for x in out))
            for n, out in links.items()
        ],
        "request_url string, final_url string, status int, html string",
    )
    start = spark.createDataFrame(list(enumerate(seeds)), "ordinal long, url string")
    options = CatalogOptions(domain="h.com", seed_max_depth=2, max_candidates=row_limit)
    found = G.seed_candidates(pages, start, options).orderBy("ordinal").collect()
    got = [(r.product_url, r.source_sitemap, r.sitemap_lastmod) for r in found]
    assert got == plain_crawl(links, seeds, 2, row_limit)


def shard_frames(spark):
    shards = spark.createDataFrame(
        [(0, 0, "s0", "d0"), (0, 1, "gone", ""), (1, 0, "s1", "")],
        "index_ord int, shard_ord int, loc string, lastmod string",
    )
    urls = spark.createDataFrame(
        [("s0", 0, "https://www.h.com/sofa/p/1"), ("s1", 0, SITE + "2"), ("s1", 1, SITE + "2/")],
        "shard_url string, url_ord int, loc string",
    )
    return shards, urls


def seed_frames(spark):
    pages = spark.createDataFrame(
        [(SITE + "9", SITE + "9", 200, "")],
        "request_url string, final_url string, status int, html string",
    )
    return pages, spark.createDataFrame([(0, SITE + "9")], "ordinal long, url string")


def run_auto(spark, **given):
    shards, urls = shard_frames(spark)
    pages, seeds = seed_frames(spark)
    options = CatalogOptions(domain="h.com", **given)
    found = G.discover(options, shards=shards, shard_urls=urls, link_pages=pages, seeds=seeds)
    return [(r.product_url, r.source_sitemap) for r in found.orderBy("ordinal").collect()]


def test_auto_reads_sitemaps_first(spark):
    assert run_auto(spark) == [(SITE + "2", "s1")]


def test_auto_falls_back_to_seeds(spark):
    assert run_auto(spark, include_hints=("9",), max_shards=3) == [(SITE + "9", "seed")]


def test_shard_limit_blocks_the_fallback(spark):
    assert run_auto(spark, max_shards=1) == []


def test_loose_filter(spark):
    found = run_auto(spark, loose_url_filter=True)
    assert found == [("https://www.h.com/sofa/p/1", "s0"), (SITE + "2", "s1")]


def test_search_needs_pages():
    with pytest.raises(ValueError):
        G.discover(CatalogOptions(domain="h", discovery_mode="search"))


def test_keys_over_whole_texts(spark):
    """Reviews that differ after the leading characters: one key by default, two by whole texts."""
    from sitefold.operators.dedupe import dedupe_in_page, dedupe_reviews

    long = "x" * 300
    rows = [("P", 1, 0, "r", "d", "t", long + "a"), ("P", 1, 1, "r", "d", "t", long + "b"), ("P", 1, 2, "r", "d", "t", long + "a")]
    df = spark.createDataFrame(
        rows, "product_id string, review_page int, pos int, reviewer string, review_date string, title string, review_text string"
    )
    assert dedupe_reviews(df).count() == 1
    assert dedupe_reviews(df, chars=None).count() == 2
    assert dedupe_in_page(df, "review_page", "pos").count() == 1
    assert [r.pos for r in dedupe_in_page(df, "review_page", "pos", chars=None).orderBy("pos").collect()] == [0, 1]
