"""Checks of de-duplication, incremental reads, limits, stop rules and discovery."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from checks import render as R
from checks.registry import norm_sql, query

from sitefold.operators import dedupe as D
from sitefold.operators import discover as G
from sitefold.operators import stops as T
from sitefold.operators.requests import union_inputs
from sitefold.session import new_path
from sitefold.settings import CatalogOptions
from sitefold.sources import sitemaps

# Documents read as reviews: product = source, reviewer = lang, text, no title or date.


def _doc_reviews(spark: SparkSession, sf: str) -> DataFrame:
    return R.table(spark, sf, "documents").select(
        "doc_id",
        F.col("source").alias("product_id"),
        F.col("lang").alias("reviewer"),
        F.lit("").alias("review_date"),
        F.lit("").alias("title"),
        F.col("text").alias("review_text"),
    )


def _doc_key_sql(*parts: str) -> str:
    return "sha256(" + " || '||' || ".join(parts) + ")"


_IN_PAGE_SQL = _doc_key_sql(norm_sql("lang"), "''", "''", norm_sql("substr(text, 1, 160)"))
_REVIEW_SQL = _doc_key_sql(
    norm_sql("source"), norm_sql("lang"), "''", "''", norm_sql("substr(text, 1, 200)")
)


@query(f"SELECT source, min(doc_id) AS doc_id FROM documents GROUP BY source, {_IN_PAGE_SQL}")
def dedupe_in_page(spark: SparkSession, sf: str) -> DataFrame:
    reviews = _doc_reviews(spark, sf).withColumnRenamed("product_id", "source")
    return D.dedupe_in_page(reviews, "source", "doc_id").select("source", "doc_id")


@query(f"SELECT {_REVIEW_SQL} AS review_id_hash, min(doc_id) AS doc_id FROM documents GROUP BY 1")
def dedupe_reviews(spark: SparkSession, sf: str) -> DataFrame:
    kept = D.dedupe_reviews(_doc_reviews(spark, sf), "doc_id")
    return kept.select("review_id_hash", "doc_id")


@query("""
SELECT regexp_extract(url, '^[a-z]+://[^/?#]*') || '/home?page=' || (page_id % 2) AS product_url,
  min(page_id) AS ordinal FROM pages GROUP BY 1
""")
def dedupe_urls(spark: SparkSession, sf: str) -> DataFrame:
    page = F.col("page_id").cast("string")
    home = F.concat(
        F.regexp_extract("url", "^[a-z]+://[^/?#]*", 0), F.lit("/home?iid="), page,
        F.lit("&page="), (F.col("page_id") % 2).cast("string"), F.lit("#"), page,
    )
    urls = R.table(spark, sf, "pages").select(F.col("page_id").alias("ordinal"), home.alias("url"))
    return D.dedupe_urls(urls)


@query("""
SELECT source_no, page_id AS ordinal, url FROM (
  SELECT 0 AS source_no, page_id, url FROM pages WHERE url LIKE '%?%'
  UNION ALL SELECT 1, page_id, url || '?again' FROM pages)
""")
def union_url_inputs(spark: SparkSession, sf: str) -> DataFrame:
    pages = R.table(spark, sf, "pages").select(F.col("page_id").alias("ordinal"), "url")
    again = pages.withColumn("url", F.concat("url", F.lit("?again")))
    return union_inputs(pages.filter("url LIKE '%?%'"), again)


_EVENT_URL = """CASE event_type
  WHEN 'click' THEN 'https://shop.example/a/p/itm' || user_id
  WHEN 'view' THEN 'https://shop.example/b/p/itm' || user_id
  WHEN 'error' THEN 'https://shop.example/list/itm' || user_id
  ELSE 'https://shop.example/q/' || event_type END"""


@query(f"""
SELECT product_url, event_id FROM (
  SELECT event_id, url AS product_url, row_number() OVER (
    PARTITION BY CASE WHEN url LIKE '%/p/%' THEN 'i' || regexp_extract(url, 'itm\\d+') ELSE url END
    ORDER BY event_id) AS rn
  FROM (SELECT event_id, {_EVENT_URL} AS url FROM events))
WHERE rn = 1
""")
def dedupe_candidates(spark: SparkSession, sf: str) -> DataFrame:
    found = R.table(spark, sf, "events").selectExpr("event_id", f"{_EVENT_URL} AS product_url")
    return D.dedupe_candidates(found, order="event_id")


def _brand_products(spark: SparkSession, sf: str) -> DataFrame:
    return R.table(spark, sf, "part").select(
        F.col("p_partkey").alias("ordinal"),
        F.concat("p_brand", F.lit("-"), F.col("p_type")).alias("product_id"),
        (F.col("p_size") % 2 == 0).alias("is_mobile"),
    )


@query("""
SELECT p_brand || '-' || p_type AS product_id, min(p_partkey) AS ordinal, true AS is_mobile
FROM part WHERE p_size % 2 = 0 GROUP BY 1
""")
def dedupe_catalog(spark: SparkSession, sf: str) -> DataFrame:
    return D.dedupe_catalog(_brand_products(spark, sf))


@query(f"""
SELECT k AS review_id_hash, min(doc_id) AS doc_id
FROM (SELECT doc_id, {_REVIEW_SQL} AS k FROM documents)
WHERE k NOT IN (SELECT {_REVIEW_SQL} FROM documents WHERE doc_id IN (SELECT doc_id FROM labels)) GROUP BY 1
""")
def incremental_reviews(spark: SparkSession, sf: str) -> DataFrame:
    reviews = _doc_reviews(spark, sf)
    labelled = reviews.join(R.table(spark, sf, "labels").select("doc_id"), "doc_id", "left_semi")
    seen = D.with_review_key(labelled).select("review_id_hash").distinct()
    fresh = D.only_new(D.dedupe_reviews(reviews, "doc_id"), seen, "review_id_hash")
    return fresh.select("review_id_hash", "doc_id")


@query("""
SELECT p_brand || '-' || p_type AS product_id, min(p_partkey) AS ordinal
FROM part WHERE p_size % 2 = 0 AND p_brand || '-' || p_type NOT IN (
  SELECT p_brand || '-' || p_type FROM part WHERE p_size = 7) GROUP BY 1
""")
def incremental_catalog(spark: SparkSession, sf: str) -> DataFrame:
    rows = _brand_products(spark, sf)
    seen = R.table(spark, sf, "part").filter("p_size = 7").select(
        F.concat("p_brand", F.lit("-"), F.col("p_type")).alias("product_id")
    ).distinct()
    return D.dedupe_catalog(D.only_new(rows, seen, "product_id")).drop("is_mobile")


@query("""
SELECT 'https://shop.example/p/' || p_name AS product_url, min(p_partkey) AS ordinal
FROM part GROUP BY 1 ORDER BY 2 LIMIT 20
""")
def limit_candidates(spark: SparkSession, sf: str) -> DataFrame:
    found = R.table(spark, sf, "part").select(
        F.col("p_partkey").alias("ordinal"),
        F.concat(F.lit("https://shop.example/p/"), F.col("p_name")).alias("product_url"),
    )
    return D.first_rows(D.dedupe_candidates(found), 20, "ordinal")


@query("""
SELECT s_nationkey AS index_ord, s_suppkey AS shard_ord, s_name AS loc FROM supplier
ORDER BY 1, 2 LIMIT 20
""")
def limit_shards(spark: SparkSession, sf: str) -> DataFrame:
    shards = R.table(spark, sf, "supplier").select(
        F.col("s_nationkey").alias("index_ord"),
        F.col("s_suppkey").alias("shard_ord"),
        F.col("s_name").alias("loc"),
    )
    return D.limit_shards(shards, 20)


# Events read as review pages: product = user, page = day of the month, key = type and k % 3.
_DAYS = 30
_EVENT_KEY = "event_type || (CAST(regexp_extract(props, '[0-9]+', 0) AS INT) % 3)"


def _event_pages(spark: SparkSession, sf: str) -> DataFrame:
    """(product_id, page_no, n_rows, n_new), days without events as empty pages."""
    rows = R.table(spark, sf, "events").select(
        F.col("user_id").alias("product_id"),
        F.dayofmonth("ts").alias("page_no"),
        F.expr(_EVENT_KEY).alias("key"),
        "event_id",
    )
    firsts = D.first_per_key(rows, ["product_id", "key"], ["page_no", "event_id"])
    new_counts = firsts.groupBy("product_id", "page_no").agg(F.count("*").alias("n_new"))
    counts = rows.groupBy("product_id", "page_no").agg(F.count("*").alias("n_rows"))
    days = rows.select("product_id").distinct().withColumn(
        "page_no", F.explode(F.sequence(F.lit(1), F.lit(_DAYS)))
    )
    page = ["product_id", "page_no"]
    return days.join(counts, page, "left").join(new_counts, page, "left").na.fill(0)


@query(f"""
WITH RECURSIVE rows AS (
  SELECT user_id, day(ts)::INT AS page, {_EVENT_KEY} AS key, event_id FROM events),
firsts AS (
  SELECT user_id, page, count(*) AS n_new FROM (SELECT *, row_number() OVER (
    PARTITION BY user_id, key ORDER BY page, event_id) AS rn FROM rows) WHERE rn = 1 GROUP BY ALL),
counts AS (SELECT user_id, page, count(*) AS n_rows FROM rows GROUP BY ALL),
pages AS (
  SELECT u.user_id, d.page, coalesce(n_rows, 0) AS n_rows, coalesce(n_new, 0) AS n_new
  FROM (SELECT DISTINCT user_id FROM events) u
  JOIN (SELECT unnest(range(1, {_DAYS + 1}))::INT AS page) d ON true
  LEFT JOIN counts c ON c.user_id = u.user_id AND c.page = d.page
  LEFT JOIN firsts f ON f.user_id = u.user_id AND f.page = d.page),
walk AS (
  SELECT user_id, 0 AS page, 0 AS empties, 0 AS stales, false AS stopped
  FROM (SELECT DISTINCT user_id FROM events)
  UNION ALL
  SELECT user_id, page, empties, stales, empties >= 3 OR (n_rows > 0 AND stales >= 2) FROM (
    SELECT p.user_id, p.page, p.n_rows,
      CASE WHEN p.n_rows = 0 THEN w.empties + 1 ELSE 0 END AS empties,
      CASE WHEN p.n_rows = 0 THEN w.stales WHEN p.n_new = 0 THEN w.stales + 1 ELSE 0 END AS stales
    FROM walk w JOIN pages p ON p.user_id = w.user_id AND p.page = w.page + 1
    WHERE NOT w.stopped))
SELECT user_id AS product_id, max(page)::INT AS last_page, bool_or(stopped) AS stopped
FROM walk GROUP BY user_id
""")
def stop_rules(spark: SparkSession, sf: str) -> DataFrame:
    return T.page_cuts(_event_pages(spark, sf), 2, 3, _DAYS)


def _searches(spark: SparkSession, sf: str) -> DataFrame:
    """Customers as search result pages, four pages to a search; some are walls."""
    pages = R.graph_pages(spark, sf)
    key = F.col("c_custkey")
    search = F.floor(key / 4)
    return pages.select(
        search.alias("search_ord"),
        F.concat(F.lit(f"{R.SITE}/search?q="), search.cast("string")).alias("search_url"),
        (key % 4 + 1).cast("int").alias("page_no"),
        F.col("request_url").alias("final_url"),
        F.when(key % 9 == 2, 403).when(key % 9 == 5, 503).otherwise(200).alias("status"),
        F.when(key % 9 == 2, F.lit("<p>reCAPTCHA</p><p>are you a human</p>"))
        .otherwise(F.col("html"))
        .alias("html"),
    )


@query("""
SELECT search_ord, page_no FROM (
  SELECT c_custkey // 4 AS search_ord, (c_custkey % 4 + 1)::INT AS page_no,
    min(CASE WHEN c_custkey % 9 = 2 THEN c_custkey % 4 + 1 END)
      OVER (PARTITION BY c_custkey // 4) AS wall FROM customer)
WHERE wall IS NULL OR page_no < wall
""")
def search_cutoff(spark: SparkSession, sf: str) -> DataFrame:
    flagged = _searches(spark, sf).withColumn("blocked", F.col("status") == 403).drop("html")
    return T.search_cutoff(flagged).select("search_ord", "page_no")


def options(**given) -> CatalogOptions:
    return CatalogOptions(domain=R.DOMAIN, exclude_hints=("itm13",), **given)


@query("""
WITH pages AS (
  SELECT c_custkey AS k, c_custkey // 4 AS s, (c_custkey % 4 + 1)::INT AS p,
    (SELECT count(*) FROM customer) AS n,
    min(CASE WHEN c_custkey % 9 = 2 THEN c_custkey % 4 + 1 END)
      OVER (PARTITION BY c_custkey // 4) AS wall FROM customer),
links AS (
  SELECT DISTINCT s, p, 'https://www.shop.example/mobile-phone/p/itm' || unnest([2 * k % n, (3 * k + 1) % n]) AS url
  FROM pages WHERE k % 9 <> 5 AND (wall IS NULL OR p < wall)),
firsts AS (
  SELECT *, row_number() OVER (PARTITION BY url ORDER BY s, p) AS rn FROM links
  WHERE NOT contains(url, 'itm13'))
SELECT url AS product_url, 'https://www.shop.example/search?q=' || s AS source_sitemap,
  'search_page_' || p AS sitemap_lastmod, row_number() OVER (ORDER BY s, p, url)::INT AS place
FROM firsts WHERE rn = 1
""")
def discover_search(spark: SparkSession, sf: str) -> DataFrame:
    return _placed(G.search_candidates(_searches(spark, sf), options()))


def _placed(found: DataFrame) -> DataFrame:
    """Discovery order as dense places, to compare it with the oracle's.

    Ordinals are dense within a task; only a count for each task meets in the running sum.
    """
    rows = found.withColumn("_task", F.shiftright("ordinal", 33))
    before = Window.orderBy("_task").rowsBetween(Window.unboundedPreceding, -1)
    tasks = rows.groupBy("_task").agg(F.count("*").alias("_n"))
    tasks = tasks.select("_task", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    place = F.col("ordinal") - F.shiftleft("_task", 33) + F.col("_before") + 1
    return rows.join(tasks, "_task").withColumn("place", place.cast("int")).drop(
        "ordinal", "_task", "_before"
    )


def sitemap_frames(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """(shards, urls) as the discovery reads them."""
    indexes, documents = R.sitemap_documents(spark, sf)
    return sitemaps.sitemap_index(indexes), sitemaps.sitemap_urls(documents)


_SITEMAP_SQL = """
SELECT row_number() OVER (ORDER BY p_partkey)::INT AS place, 'https://www.shop.example/mobile-phone/p/itm' || p_partkey AS product_url,
  'https://www.shop.example/map-' || p_partkey // 200 || '.xml' AS source_sitemap,
  CASE WHEN p_partkey // 200 % 2 = 0 THEN '2024-01-01' ELSE '' END AS sitemap_lastmod
FROM part WHERE NOT contains('itm' || p_partkey, 'itm13')
"""


@query(_SITEMAP_SQL)
def discover_sitemap(spark: SparkSession, sf: str) -> DataFrame:
    shards, urls = sitemap_frames(spark, sf)
    return _placed(G.sitemap_candidates(shards, urls, options()))


@query(_SITEMAP_SQL)
def discover_sitemap_files(spark: SparkSession, sf: str) -> DataFrame:
    """The same from files that the XML reader streams, plain and gz, with places from there."""
    indexes, documents = R.sitemap_documents(spark, sf)
    folder = new_path(spark, "sitemap-entries")
    parts = documents.select("shard_url", F.sha2("shard_url", 256).alias("part"), "xml")
    parts.select("part", F.col("xml").alias("value")).write.partitionBy("part").text(f"{folder}/urls")
    indexes.select("index_ord", F.col("xml").alias("value")).write.partitionBy("index_ord").text(
        f"{folder}/indexes", compression="gzip"
    )
    urls = sitemaps.read_url_entries(spark, f"{folder}/urls/*/*")
    urls = urls.withColumn("part", F.regexp_extract("file", "part=([0-9a-f]+)", 1))
    shards = sitemaps.read_index_entries(spark, f"{folder}/indexes/*/*")
    index_ord = F.regexp_extract("file", r"index_ord=(\d+)", 1).cast("long")
    return _placed(
        G.sitemap_candidates(
            shards.withColumn("index_ord", index_ord),
            urls.join(parts.select("shard_url", "part"), "part"),
            options(),
        )
    )


@query(_SITEMAP_SQL + " AND p_partkey // 200 < 7 ORDER BY p_partkey LIMIT 1200")
def discover_limited(spark: SparkSession, sf: str) -> DataFrame:
    """Both limits at once: 7 shards, and of their URLs the first 1,200."""
    shards, urls = sitemap_frames(spark, sf)
    return _placed(G.sitemap_candidates(shards, urls, options(max_shards=7, max_candidates=1200)))


@query(_SITEMAP_SQL)
def discover_auto(spark: SparkSession, sf: str) -> DataFrame:
    """Search pages exist but hold no product link, so the sitemaps are used."""
    pages = R.table(spark, sf, "pages").select(
        F.col("page_id").alias("search_ord"),
        F.col("url").alias("search_url"),
        F.lit(1).alias("page_no"),
        F.col("url").alias("final_url"),
        F.lit(200).alias("status"),
        "html",
    )
    shards, urls = sitemap_frames(spark, sf)
    return _placed(
        G.discover(options(), search_pages=pages, shards=shards, shard_urls=urls)
    )


def _bfs_sql(depth: int) -> str:
    """Levels of the traversal, each in queue order: by the parent's place, then by link."""
    url = "'https://www.shop.example/mobile-phone/p/itm' || "
    levels = [f"""l0 AS MATERIALIZED (
  SELECT c_custkey AS node, 'seed' AS source, row_number() OVER (ORDER BY c_custkey) AS place
  FROM customer WHERE c_nationkey = 7 AND NOT contains('itm' || c_custkey, 'itm13'))"""]
    for at in range(1, depth + 1):
        seen = " UNION ALL ".join(f"SELECT node FROM l{i}" for i in range(at))
        levels.append(f"""l{at} AS MATERIALIZED (
  SELECT node, source, row_number() OVER (ORDER BY parent, {url} node) AS place FROM (
    SELECT dst AS node, {url} src AS source, place AS parent FROM l{at - 1} JOIN edges ON src = node
    WHERE dst NOT IN ({seen}) AND NOT contains('itm' || dst, 'itm13')
    QUALIFY row_number() OVER (PARTITION BY dst ORDER BY place) = 1))""")
    rows = " UNION ALL ".join(f"SELECT {i} AS depth, * FROM l{i}" for i in range(depth + 1))
    return f"""
WITH edges AS (
  SELECT DISTINCT c_custkey AS src, unnest([2 * c_custkey % n, (3 * c_custkey + 1) % n]) AS dst
  FROM customer, (SELECT count(*) AS n FROM customer) WHERE c_custkey % 11 <> 5),
{", ".join(levels)}
SELECT {url} node AS product_url, 'seed_depth_' || depth AS sitemap_lastmod, source AS source_sitemap,
  row_number() OVER (ORDER BY depth, place) AS place
FROM ({rows})
"""


@query(_bfs_sql(3))
def link_bfs(spark: SparkSession, sf: str) -> DataFrame:
    """Candidates of the link graph with where each came from and its place in the queue."""
    seeds = R.table(spark, sf, "customer").filter("c_nationkey = 7").select(
        F.col("c_custkey").alias("ordinal"), R.product_url(F.col("c_custkey")).alias("url")
    )
    found = G.seed_candidates(
        R.graph_pages(spark, sf), seeds, options(seed_max_depth=3)
    )
    place = F.row_number().over(Window.orderBy("ordinal")).cast("long")
    return found.select("product_url", "sitemap_lastmod", "source_sitemap", place.alias("place"))


@query("""
SELECT p_partkey // 1000 AS index_ord, p_partkey // 200 % 5 AS shard_ord,
  'https://www.shop.example/map-' || p_partkey // 200 || '.xml' AS loc,
  CASE WHEN p_partkey // 200 % 2 = 0 THEN '2024-01-01' ELSE '' END AS lastmod
FROM part GROUP BY ALL
""")
def sitemap_index(spark: SparkSession, sf: str) -> DataFrame:
    shards, _ = sitemap_frames(spark, sf)
    return shards.withColumn("shard_ord", F.col("shard_ord").cast("long"))


@query("""
SELECT 'https://www.shop.example/map-' || p_partkey // 200 || '.xml' AS shard_url,
  p_partkey % 200 AS url_ord,
  'http://WWW.Shop.example/hi/mobile-phone/p/itm' || p_partkey || '/' AS loc
FROM part
""")
def sitemap_urls(spark: SparkSession, sf: str) -> DataFrame:
    _, urls = sitemap_frames(spark, sf)
    return urls.withColumn("url_ord", F.col("url_ord").cast("long"))


@query("""
SELECT 'http://WWW.Shop.example/hi/mobile-phone/p/itm' || p_partkey || '/' AS loc,
  unnest(['gz', 'plain']) AS kind FROM part
""")
def sitemap_files(spark: SparkSession, sf: str) -> DataFrame:
    """Shards as files with a prefixed namespace and image locations, plain and gz."""
    _, documents = R.sitemap_documents(spark, sf)
    # The prefix of the root goes on its own elements; image:loc must not count as a location.
    xml = F.regexp_replace("xml", "<(/?)(urlset|url|loc)", "<$1sm:$2")
    xml = F.replace(xml, F.lit("xmlns="), F.lit("xmlns:image='urn:image' xmlns:sm="))
    image = "<image:image><image:loc>http://a.b/c.png</image:loc></image:image></sm:url>"
    documents = documents.select(
        F.sha2("shard_url", 256).alias("part"), F.replace(xml, F.lit("</sm:url>"), F.lit(image)).alias("value")
    )
    folder = new_path(spark, "sitemap-files")
    documents.write.partitionBy("part").text(f"{folder}/gz", compression="gzip")
    documents.write.partitionBy("part").text(f"{folder}/plain")
    found = [
        sitemaps.read_xml_files(spark, f"{folder}/{kind}/*/*").withColumn("kind", F.lit(kind))
        for kind in ("gz", "plain")
    ]
    return sitemaps.sitemap_urls(found[0].unionByName(found[1])).select("loc", "kind")
