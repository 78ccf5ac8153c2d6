"""Checks of sources, sinks, the two jobs and their streams."""

from __future__ import annotations


from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from checks import render as R
from checks.page_queries import PRODUCT_SQL
from checks.registry import query
from checks.relational import _DAYS, _EVENT_KEY, sitemap_frames
from sitefold.operators.dedupe import with_review_key
from sitefold.functions.urls import to_review_url
from sitefold.operators.discover import discover
from sitefold.operators.refused import refused_inputs as refused_of, refused_sitemaps
from sitefold.plans.catalog import export_catalog
from sitefold.plans.metrics import catalog_metrics, review_counts as count_reviews, review_totals as totals_of
from sitefold.plans.reviews import ingest_requested, ingest_reviews as ingest
from sitefold.session import new_path
from sitefold.settings import CatalogOptions, ReviewOptions
from sitefold.sources import seen as seen_files
from sitefold.sources import sinks, sitemaps, url_lists
from sitefold.sources.staged import StagedAppend
from sitefold.sources.pages import stream_pages
from sitefold.streaming import jobs

# --- sources ----------------------------------------------------------------------


@query("""
SELECT 'prose' AS kind, url FROM pages
UNION ALL SELECT 'comment', url || '/c' FROM pages
UNION ALL SELECT 'plain', regexp_replace(url, '^https?://', '') FROM pages
""")
def read_url_text(spark: SparkSession, sf: str) -> DataFrame:
    """One folder of prose with URLs, one of plain lines without any."""
    url = F.col("url")
    pages = R.table(spark, sf, "pages")
    prose, plain = new_path(spark, "urls-prose"), new_path(spark, "urls-plain")
    text = F.concat(F.lit("see <"), url, F.lit(">\n\n# ["), url, F.lit("/c] # old"))
    pages.select(text).write.text(prose)
    bare = F.regexp_replace(url, "^https?://", "")
    pages.select(F.concat(F.lit("  # no\n\n  "), bare, F.lit("  "))).write.text(plain)
    found = url_lists.read_url_text(spark, prose).select(
        F.when(F.col("url").endswith("/c"), "comment").otherwise("prose").alias("kind"), "url"
    )
    lines = url_lists.read_url_text(spark, plain).select(F.lit("plain").alias("kind"), "url")
    return found.unionByName(lines)


@query("SELECT url FROM pages UNION ALL SELECT url || ',\"x\"' FROM pages")
def read_url_csv(spark: SparkSession, sf: str) -> DataFrame:
    path = new_path(spark, "urls-csv")
    pages = R.table(spark, sf, "pages")
    rows = pages.select(
        F.explode(F.array(F.concat(F.lit(" "), "url"), F.lit("  "), F.concat("url", F.lit(',"x"')))).alias("product_url"),
        "page_id",
    )
    rows.write.options(header=True, escape='"').csv(path)
    return url_lists.read_url_csv(spark, path).select("url")


# Pages in one JSON list, whatever the table size.
_LIST_PAGES = 1000


@query("SELECT url FROM pages UNION ALL SELECT page_id::VARCHAR FROM pages")
def read_url_json(spark: SparkSession, sf: str) -> DataFrame:
    """JSON arrays of up to a thousand pages, one to a file."""
    path = new_path(spark, "urls-json")
    pages = R.table(spark, sf, "pages")
    items = F.array(F.concat(F.lit(" "), "url"), F.col("page_id").cast("string"), F.lit(" "))
    # By place, not by value, so that no file grows with equal rows.
    placed = pages.select(F.floor(F.monotonically_increasing_id() / _LIST_PAGES).alias("list"), items.alias("items"))
    lists = placed.groupBy("list").agg(F.to_json(F.flatten(F.collect_list("items"))).alias("value"))
    lists.select("value").write.option("maxRecordsPerFile", 1).text(path)
    return url_lists.read_url_json(spark, path).select("url")


@query("SELECT url FROM pages")
def read_seeds(spark: SparkSession, sf: str) -> DataFrame:
    path = new_path(spark, "seeds")
    text = F.concat(F.lit("# head\n\n  "), F.col("url"), F.lit(" "))
    R.table(spark, sf, "pages").select(text).write.text(path)
    return url_lists.read_seeds(spark, path).select("url")


def _hash_of(column: str) -> Column:
    return F.sha2(F.col(column), 256)


@query("SELECT DISTINCT sha256(props) AS review_id_hash FROM events")
def seen_hashes(spark: SparkSession, sf: str) -> DataFrame:
    path = new_path(spark, "seen-jsonl")
    good = F.to_json(F.struct(_hash_of("props").alias("review_id_hash"), "value"))
    lines = F.array(good, F.lit(""), F.lit('{"review_id_hash": 5}'), F.substring(good, 1, 30))
    R.table(spark, sf, "events").select(F.explode(lines)).write.text(path)
    return seen_files.read_seen_hashes(spark, path)


@query("SELECT DISTINCT p_name AS product_id FROM part")
def seen_ids(spark: SparkSession, sf: str) -> DataFrame:
    path = new_path(spark, "seen-csv")
    ids = F.explode(F.array(F.concat(F.lit("  "), "p_name", F.lit(" ")), F.lit(" ")))
    rows = R.table(spark, sf, "part").select(ids.alias("product_id"), F.col("p_type").alias("title"))
    sinks.write_csv(rows, path)
    return seen_files.read_seen_ids(spark, path)


# --- sinks ------------------------------------------------------------------------

_OUT_TYPE = (
    "product_id string, product_url string, review_page int, review_id_hash string, rating int,"
    " title string, review_text string, reviewer string, review_date string, variant string,"
    " helpful_count int, scraped_at string"
)


def _doc_rows(spark: SparkSession, sf: str) -> DataFrame:
    """Documents in the shape of review rows."""
    return R.table(spark, sf, "documents").select(
        F.concat(F.col("source"), F.lit("/"), F.col("lang")).alias("product_id"),
        F.lit("u").alias("product_url"),
        F.lit(1).alias("review_page"),
        _hash_of("text").alias("review_id_hash"),
        F.when(F.col("n_chars") > 500, F.lit(5)).alias("rating"),
        F.concat(F.lit('"q", '), F.col("lang")).alias("title"),
        F.col("text").alias("review_text"),
        F.lit("").alias("reviewer"),
        F.lit("").alias("review_date"),
        F.lit("é").alias("variant"),
        F.col("doc_id").cast("int").alias("helpful_count"),
        F.lit("t").alias("scraped_at"),
    )


_SINK_SQL = """
SELECT doc_id::INT AS helpful_count, source || '/' || lang AS product_id,
  CASE WHEN n_chars > 500 THEN 5 END::INT AS rating, '"q", ' || lang AS title,
  text AS review_text, 'é' AS variant FROM documents
"""
_SINK_COLUMNS = ("helpful_count", "product_id", "rating", "title", "review_text", "variant")


@query(f"SELECT *, true AS ascii, n_chars <= 500 AS null_written FROM ({_SINK_SQL}) "
       "JOIN (SELECT doc_id::INT AS helpful_count, n_chars FROM documents) USING (helpful_count)")
def sink_jsonl(spark: SparkSession, sf: str) -> DataFrame:
    folder = new_path(spark, "sink-jsonl")
    sinks.write_reviews(_doc_rows(spark, sf), folder, "jsonl")
    lines = spark.read.text(f"{folder}/jsonl")
    row = F.from_json("value", _OUT_TYPE)
    back = lines.select(
        row.alias("r"),
        (~F.col("value").rlike(r"[^\x00-\x7f]")).alias("ascii"),
        F.col("value").contains('"rating":null').alias("null_written"),
    )
    chars = R.table(spark, sf, "documents").select(
        F.col("doc_id").cast("int").alias("helpful_count"), "n_chars"
    )
    return back.select(*[f"r.{c}" for c in _SINK_COLUMNS], "ascii", "null_written").join(
        chars, "helpful_count"
    )


def _csv_back(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(_OUT_TYPE).csv(path, header=True, multiLine=True, escape='"')


@query(_SINK_SQL)
def sink_csv(spark: SparkSession, sf: str) -> DataFrame:
    folder = new_path(spark, "sink-csv")
    sinks.write_reviews(_doc_rows(spark, sf), folder, "both")
    return _csv_back(spark, f"{folder}/csv").select(*_SINK_COLUMNS)


@query(f"SELECT *, regexp_replace(product_id, '[^A-Za-z0-9_-]+', '_', 'g') AS folder FROM ({_SINK_SQL})")
def sink_partitioned(spark: SparkSession, sf: str) -> DataFrame:
    folder = new_path(spark, "sink-product")
    sinks.write_reviews(_doc_rows(spark, sf), folder, "jsonl", per_product=True)
    back = spark.read.schema(_OUT_TYPE + ", safe_product_id string").json(f"{folder}/jsonl")
    return back.select(*_SINK_COLUMNS, F.col("safe_product_id").alias("folder"))


@query(f"SELECT *, unnest(['csv', 'jsonl']) AS kind FROM ({_SINK_SQL})")
def sink_replayed(spark: SparkSession, sf: str) -> DataFrame:
    """A run that failed between both formats and is then repeated twice: each row once in each."""
    folder = new_path(spark, "sink-replayed")
    rows = _doc_rows(spark, sf)

    def fail(path: str) -> None:
        sinks.write_reviews(rows, path, "jsonl")
        raise InterruptedError

    try:
        StagedAppend(spark, folder, "run-1").append(fail)
    except InterruptedError:
        pass
    for _ in range(2):
        sinks.write_reviews(rows, folder, "both", run_id="run-1")
    lines = spark.read.schema(_OUT_TYPE).json(f"{folder}/jsonl").withColumn("kind", F.lit("jsonl"))
    cells = _csv_back(spark, f"{folder}/csv").withColumn("kind", F.lit("csv"))
    return cells.unionByName(lines).select(*_SINK_COLUMNS, "kind")


@query("""
SELECT p_partkey::VARCHAR AS product_id, p_name || ', "new"' AS title, p_type AS category,
  '' AS currency FROM part
""")
def sink_catalog(spark: SparkSession, sf: str) -> DataFrame:
    path = new_path(spark, "sink-catalog")
    rows = R.table(spark, sf, "part").select(
        F.col("p_type").alias("category"),
        F.col("p_partkey").cast("string").alias("product_id"),
        F.concat("p_name", F.lit(', "new"')).alias("title"),
        F.lit("").alias("currency"),
    )
    sinks.write_catalog(rows, path)
    back = spark.read.csv(path, header=True, multiLine=True, escape='"')
    return back.select("product_id", "title", "category", F.coalesce("currency", F.lit("")).alias("currency"))


# --- review job -------------------------------------------------------------------
# Events as review pages: product = user, page = day, one review per key and day. Days
# without events are empty pages; one day in a hundred fails.


def _fails(user: Column, day: Column) -> Column:
    return (user * _DAYS + day) % 100 == 37


def _event_url() -> Column:
    """Product URL of a user."""
    user = F.lpad(F.col("user_id").cast("string"), 9, "0")
    return F.concat(F.lit(f"{R.SITE}/phone/p/itm1?iid=7&pid=USR"), user)


def event_review_pages(spark: SparkSession, sf: str) -> DataFrame:
    rows = R.table(spark, sf, "events").select(
        "user_id", F.dayofmonth("ts").alias("page_no"), F.expr(_EVENT_KEY).alias("key")
    ).distinct()
    review = F.struct(
        F.lit("Review").alias("@type"), F.col("key").alias("name"), F.col("key").alias("reviewBody")
    )
    # At most fifteen keys to a page.
    filled = rows.groupBy("user_id", "page_no").agg(
        F.sort_array(F.collect_list(review)).alias("reviews")
    )
    days = rows.select("user_id").distinct().withColumn(
        "page_no", F.explode(F.sequence(F.lit(1), F.lit(_DAYS)))
    )
    pages = R.many_tasks(days.join(filled, ["user_id", "page_no"], "left"))
    body = F.when(F.col("reviews").isNull(), F.lit("")).otherwise(R.jsonld(F.col("reviews")))
    return pages.select(
        _event_url().alias("product_url"),
        "page_no",
        F.when(_fails(F.col("user_id"), F.col("page_no")), 500).otherwise(200).alias("status"),
        R.html_page(body, F.lit("<body>")).alias("html"),
    )


def event_seen(spark: SparkSession, sf: str) -> DataFrame:
    """Hashes an earlier run wrote: the key 'click0' of every user."""
    users = R.table(spark, sf, "events").select("user_id").distinct()
    key = F.lit("click0")
    rows = users.select(
        F.concat(F.lit("USR"), F.lpad(F.col("user_id").cast("string"), 9, "0")).alias("product_id"),
        F.lit("").alias("reviewer"),
        F.lit("").alias("review_date"),
        key.alias("title"),
        key.alias("review_text"),
    )
    return with_review_key(rows).select("review_id_hash")


def _run_sql(missing: str = "false", last: str = "u.last") -> str:
    """The job in SQL; ``missing``: pages (user_id, page) that never landed, looked for to ``last``."""
    return f"""
WITH RECURSIVE rows AS (
  SELECT DISTINCT user_id, day(ts)::INT AS page, {_EVENT_KEY} AS key FROM events
  WHERE NOT ({missing.format(page='day(ts)')})),
landed AS (
  SELECT user_id, page FROM (SELECT DISTINCT user_id FROM events),
    (SELECT unnest(range(1, {_DAYS + 1}))::INT AS page) WHERE NOT ({missing.format(page='page')})),
bad AS (
  SELECT u.user_id, min(d.page) AS bad
  FROM (SELECT user_id, max(page) AS last FROM landed GROUP BY user_id) u
  JOIN (SELECT unnest(range(1, {_DAYS + 1}))::INT AS page) d ON d.page <= {last}
    AND ((user_id * {_DAYS} + d.page) % 100 = 37 OR {missing.format(page='d.page')})
  GROUP BY u.user_id),
firsts AS (SELECT user_id, key, min(page) AS page FROM rows r
  WHERE key <> 'click0' AND NOT EXISTS (
    SELECT 1 WHERE (r.user_id * {_DAYS} + r.page) % 100 = 37) GROUP BY ALL),
news AS (SELECT user_id, page, count(*) AS n_new FROM firsts GROUP BY ALL),
counts AS (SELECT user_id, page, count(*) AS n_rows FROM rows GROUP BY ALL),
pages AS (
  SELECT u.user_id, d.page, coalesce(n_rows, 0) AS n_rows, coalesce(n_new, 0) AS n_new
  FROM (SELECT DISTINCT user_id FROM events) u
  JOIN (SELECT unnest(range(1, {_DAYS + 1}))::INT AS page) d ON true
  LEFT JOIN counts c ON c.user_id = u.user_id AND c.page = d.page
  LEFT JOIN news f ON f.user_id = u.user_id AND f.page = d.page
  JOIN landed l ON l.user_id = u.user_id AND l.page = d.page
  LEFT JOIN bad b ON b.user_id = u.user_id
  WHERE bad IS NULL OR d.page < bad),
walk AS (
  SELECT user_id, 0 AS page, 0 AS empties, 0 AS stales, false AS stopped
  FROM (SELECT DISTINCT user_id FROM events)
  UNION ALL
  SELECT user_id, page, empties, stales, empties >= 3 OR (n_rows > 0 AND stales >= 2) FROM (
    SELECT p.user_id, p.page, p.n_rows,
      CASE WHEN p.n_rows = 0 THEN w.empties + 1 ELSE 0 END AS empties,
      CASE WHEN p.n_rows = 0 THEN w.stales WHEN p.n_new = 0 THEN w.stales + 1 ELSE 0 END AS stales
    FROM walk w JOIN pages p ON p.user_id = w.user_id AND p.page = w.page + 1
    WHERE NOT w.stopped)),
ends AS (
  SELECT user_id, max(page)::INT AS last_page,
    CASE WHEN bool_or(stopped) OR max(bad) IS NULL THEN 'done' ELSE 'failed' END AS outcome
  FROM walk LEFT JOIN bad USING (user_id) GROUP BY user_id),
written AS (
  SELECT 'USR' || lpad(user_id::VARCHAR, 9, '0') AS product_id, page AS review_page, key AS title
  FROM firsts JOIN ends USING (user_id) WHERE page <= last_page)
"""


def _review_run(spark: SparkSession, sf: str):
    options = ReviewOptions(max_pages=_DAYS, seen_stop_threshold=2, max_empty_pages=3)
    return ingest(event_review_pages(spark, sf), options, event_seen(spark, sf))


@query(_run_sql() + """
SELECT product_id, review_page, title, title AS review_text,
  sha256(product_id || '||||||' || title || '||' || title) AS review_id_hash,
  'https://www.shop.example/phone/p/itm1?pid=' || product_id AS product_url,
  NULL::INT AS rating FROM written
""")
def ingest_reviews(spark: SparkSession, sf: str) -> DataFrame:
    rows = _review_run(spark, sf).reviews
    return rows.select(
        "product_id", "review_page", "title", "review_text", "review_id_hash", "product_url", "rating"
    )


_MISSING = f"(user_id * {_DAYS} + {{page}}) % 50 = 11"
_ENDS_SQL = """
SELECT 'USR' || lpad(user_id::VARCHAR, 9, '0') AS product_id, last_page, outcome FROM ends
"""


@query(_run_sql(_MISSING) + _ENDS_SQL)
def page_gaps(spark: SparkSession, sf: str) -> DataFrame:
    """Some pages never landed: a product ends as failed before its first gap."""
    user = F.regexp_extract("product_url", "USR([0-9]+)", 1).cast("long")
    landed = event_review_pages(spark, sf).filter((user * _DAYS + F.col("page_no")) % 50 != 11)
    options = ReviewOptions(seen_stop_threshold=2, max_empty_pages=3)
    return ingest(landed, options, event_seen(spark, sf)).products.drop("product_url")


_NEVER_LANDED = f"((user_id * {_DAYS} + {{page}}) % 50 = 11 OR (user_id % 3 = 0 AND {{page}} > 12))"
_LISTED = "CAST(substr(product_id, 4) AS INT) % 7 <> 0"


def _requested_run(spark: SparkSession, sf: str):
    """Pages that know only what was asked for, some of unlisted products, some never landed."""
    user = F.regexp_extract("product_url", "USR([0-9]+)", 1).cast("long")
    page = F.col("page_no")
    gone = ((user * _DAYS + page) % 50 == 11) | ((user % 3 == 0) & (page > 12))
    all_pages = event_review_pages(spark, sf)
    landed = all_pages.filter(~gone).select(
        F.explode(F.array(to_review_url(F.col("product_url"), page))).alias("request_url"), "status", "html"
    )
    # The products of the pages, from the users alone: the pages need not be built again for them.
    # Distinct users first: an event is no new URL.
    users = R.table(spark, sf, "events").select("user_id").distinct()
    products = users.select(F.explode(F.array(_event_url())).alias("product_url"))
    urls = products.filter(user % 7 != 0).select(user.alias("ordinal"), F.col("product_url").alias("url"))
    options = ReviewOptions(max_pages=_DAYS, seen_stop_threshold=2, max_empty_pages=3)
    return ingest_requested(landed, urls.distinct(), options, event_seen(spark, sf))


@query(_run_sql(_NEVER_LANDED, str(_DAYS)) + f"""
SELECT product_id, review_page, title FROM written WHERE {_LISTED}
""")
def requested_reviews(spark: SparkSession, sf: str) -> DataFrame:
    return _requested_run(spark, sf).reviews.select("product_id", "review_page", "title")


@query(_run_sql(_NEVER_LANDED, str(_DAYS)) + f"SELECT * FROM ({_ENDS_SQL}) WHERE {_LISTED}")
def requested_products(spark: SparkSession, sf: str) -> DataFrame:
    return _requested_run(spark, sf).products.drop("product_url")


@query(_run_sql() + """
SELECT (SELECT count(*) FROM written) AS total_reviews, count(*) FILTER (outcome = 'failed') AS failed_products
FROM ends
""")
def review_totals(spark: SparkSession, sf: str) -> DataFrame:
    run = _review_run(spark, sf)
    return totals_of(run.reviews, run.products).select("total_reviews", "failed_products")


@query(_run_sql() + "SELECT product_id, count(*) AS n_reviews FROM written GROUP BY product_id")
def review_counts(spark: SparkSession, sf: str) -> DataFrame:
    return count_reviews(_review_run(spark, sf).reviews)


@query(_run_sql() + """
SELECT 'USR' || lpad(user_id::VARCHAR, 9, '0') AS product_id, last_page, outcome FROM ends
""")
def quarantine(spark: SparkSession, sf: str) -> DataFrame:
    """How each product ended: read to its stop page, or cut short by a failed page."""
    return _review_run(spark, sf).products.drop("product_url")


# --- catalog job ------------------------------------------------------------------


def _catalog_run(
    spark: SparkSession, sf: str, max_products: int | None = None, pages: DataFrame | None = None
):
    options = CatalogOptions(
        domain=R.DOMAIN, discovery_mode="sitemap", max_products=max_products,
    )
    shards, urls = sitemap_frames(spark, sf)
    candidates = discover(options, shards=shards, shard_urls=urls)
    seen = R.table(spark, sf, "part").filter("p_size = 7").select(
        F.concat(F.lit("itm"), F.col("p_partkey").cast("string")).alias("product_id")
    )
    return export_catalog(candidates, pages or R.product_pages(spark, sf), options, seen)


def _catalog_sql(limit: str = "true") -> str:
    return f"""
WITH decided AS (
  SELECT *, CASE WHEN p_partkey % 10 = 7 THEN 'gone' WHEN p_partkey % 20 = 8 THEN 'blocked'
    WHEN p_size = 7 THEN 'duplicate' WHEN is_mobile THEN 'written' ELSE 'non_mobile' END AS outcome
  FROM ({PRODUCT_SQL}) JOIN (SELECT p_partkey, p_size FROM part) USING (p_partkey)),
looked AS (
  SELECT * FROM (SELECT *, count(*) FILTER (outcome = 'written') OVER (
      ORDER BY p_partkey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM decided)
  WHERE {limit})
"""


_WRITTEN_SQL = """
SELECT product_id, product_url, title, price, currency, rating, review_count, category,
  super_category, sub_category, 'https://www.shop.example/map-' || p_partkey // 200 || '.xml' AS source_sitemap,
  CASE WHEN p_partkey // 200 % 2 = 0 THEN '2024-01-01' ELSE '' END AS sitemap_lastmod
FROM looked WHERE outcome = 'written'
"""


@query(_catalog_sql("before < 300") + _WRITTEN_SQL)
def catalog_limited(spark: SparkSession, sf: str) -> DataFrame:
    """The first 300 products that may be written."""
    return _catalog_run(spark, sf, 300).catalog.drop("scraped_at", "ordinal")


@query(_catalog_sql() + _WRITTEN_SQL)
def catalog_export(spark: SparkSession, sf: str) -> DataFrame:
    return _catalog_run(spark, sf).catalog.drop("scraped_at", "ordinal")


@query(_catalog_sql() + _WRITTEN_SQL)
def relanded_pages(spark: SparkSession, sf: str) -> DataFrame:
    """Each tenth page landed twice: its product is still looked at and written once."""
    pages = R.product_pages(spark, sf)
    twice = pages.unionByName(pages.filter("p_partkey % 10 = 3"))
    return _catalog_run(spark, sf, pages=twice).catalog.drop("scraped_at", "ordinal")


@query(_catalog_sql() + """
SELECT count(*) AS scanned, count(*) FILTER (outcome = 'written') AS written,
  count(*) FILTER (outcome = 'non_mobile') AS skipped_non_mobile,
  count(*) FILTER (outcome = 'blocked') AS blocked, count(*) FILTER (outcome = 'failed') AS failed
FROM looked
""")
def run_metrics(spark: SparkSession, sf: str) -> DataFrame:
    return catalog_metrics(_catalog_run(spark, sf).outcomes)


# --- streams ----------------------------------------------------------------------


def _run_stream(spark: SparkSession, pages: DataFrame, start, name: str) -> DataFrame:
    """Land pages as several files and stream them in several batches, in two runs."""
    source, target = new_path(spark, f"{name}-in"), new_path(spark, f"{name}-out")
    checkpoint = new_path(spark, f"{name}-state")
    # A batch needs a file for each core, or most of them wait while two files are parsed.
    cores = spark.sparkContext.defaultParallelism
    pages.repartition(3 * cores, *pages.columns[:2]).write.parquet(source)
    for _ in range(2):
        stream = stream_pages(spark, source, pages.schema, maxFilesPerTrigger=str(cores))
        start(stream, target, checkpoint).awaitTermination()
    return spark.read.parquet(target)


@query(f"""
SELECT DISTINCT 'USR' || lpad(user_id::VARCHAR, 9, '0') AS product_id, {_EVENT_KEY} AS title
FROM events WHERE (user_id * {_DAYS} + day(ts)) % 100 <> 37
""")
def stream_ingest(spark: SparkSession, sf: str) -> DataFrame:
    written = _run_stream(
        spark, event_review_pages(spark, sf), jobs.ingest_reviews_stream, "stream-reviews"
    )
    return written.select("product_id", "title")


@query(f"""
SELECT product_id, title, category, rating FROM ({PRODUCT_SQL})
WHERE is_mobile AND p_partkey % 10 <> 7
""")
def stream_catalog(spark: SparkSession, sf: str) -> DataFrame:
    pages = R.product_pages(spark, sf).withColumnRenamed("p_partkey", "ordinal")
    written = _run_stream(spark, pages, jobs.catalog_stream, "stream-catalog")
    return written.select("product_id", "title", "category", "rating")


@query(f"""
SELECT product_id, title, category, rating FROM ({PRODUCT_SQL})
WHERE is_mobile AND p_partkey % 10 <> 7
""")
def stream_restart(spark: SparkSession, sf: str) -> DataFrame:
    """A second stream with a new checkpoint on the same target adds and replaces nothing wrong."""
    pages = R.product_pages(spark, sf).withColumnRenamed("p_partkey", "ordinal")
    target = new_path(spark, "stream-restart-out")
    for part in (pages.filter("ordinal % 3 = 0"), pages):
        source, checkpoint = new_path(spark, "stream-restart-in"), new_path(spark, "stream-restart-state")
        part.write.parquet(source)
        stream = stream_pages(spark, source, pages.schema)
        jobs.catalog_stream(stream, target, checkpoint).awaitTermination()
    return spark.read.parquet(target).select("product_id", "title", "category", "rating")


# --- what was not read ----------------------------------------------------------------


_REFUSED_PAGES_SQL = """
SELECT url AS source, NULL::INT AS part, 'page' AS stage,
  CASE page_id % 10 WHEN 0 THEN 'no response' WHEN 1 THEN 'status 404' WHEN 2 THEN 'bot check'
    WHEN 3 THEN 'status 503' ELSE 'no text' END AS reason
FROM pages WHERE page_id % 10 IN (0, 1, 2, 3, 4)
UNION ALL
SELECT url, part, 'json-ld', 'not JSON' FROM pages, (VALUES (1), (2)) t(part) WHERE page_id % 10 = 5
"""


def _rough_inputs(spark: SparkSession, sf: str) -> DataFrame:
    """Landed pages of which half cannot be read, for one reason each."""
    kind = F.col("page_id") % 10
    script = '<script type="application/ld+json">'
    texts = F.concat(
        F.lit(f'{script}{{"a": 1}}</script>{script}{{bad </script>{script}[1, '),
        F.col("page_id").cast("string"), F.lit("</script>"), "html",
    )
    return R.table(spark, sf, "pages").select(
        F.col("page_id").alias("ordinal"),
        F.col("url").alias("request_url"),
        F.when(kind == 0, None).when(kind == 1, 404).when(kind == 2, 403).when(kind == 3, 503)
        .otherwise(200).alias("status"),
        F.when(kind == 2, "reCAPTCHA: Are you a human?").when(kind == 4, None).when(kind == 5, texts)
        .otherwise(F.col("html")).alias("html"),
    )


@query(f"""
{_REFUSED_PAGES_SQL}
UNION ALL
SELECT url, NULL, 'sitemap', CASE page_id % 10 WHEN 6 THEN 'not XML' WHEN 7 THEN 'status 503' ELSE 'no text' END
FROM pages WHERE page_id % 10 IN (6, 7, 8)
""")
def refused_inputs(spark: SparkSession, sf: str) -> DataFrame:
    """Pages, JSON-LD documents and sitemap documents that are not read, each with its reason."""
    pages = _rough_inputs(spark, sf)
    kind = F.col("ordinal") % 10
    documents = pages.select(
        F.col("request_url").alias("file"),
        F.when(kind == 7, 503).otherwise(200).alias("status"),
        F.when(kind == 6, "<urlset><url>").when(kind == 8, " ")
        .otherwise("<urlset><url><loc>u</loc></url></urlset>").alias("xml"),
    )
    return refused_of(pages).unionByName(refused_sitemaps(documents, sitemaps.URLSET))


@query(_REFUSED_PAGES_SQL)
def stream_refused(spark: SparkSession, sf: str) -> DataFrame:
    """The same pages as a stream of several batches, started twice on one checkpoint."""
    source, target = new_path(spark, "stream-refused-in"), new_path(spark, "stream-refused-out")
    checkpoint = new_path(spark, "stream-refused-state")
    pages = _rough_inputs(spark, sf)
    pages.repartition(4, "ordinal").write.parquet(source)
    for _ in range(2):
        stream = stream_pages(spark, source, pages.schema, maxFilesPerTrigger="2")
        jobs.catalog_stream(stream, target, checkpoint).awaitTermination()
    return jobs.read_refused(spark, target).select("source", "part", "stage", "reason")
