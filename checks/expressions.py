"""Checks of the text and URL expressions and the predicates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from checks import render as R
from checks.registry import norm_sql, query
from sitefold import settings as S
from sitefold.functions import classify as C
from sitefold.functions import text as X
from sitefold.functions import urls as U
from sitefold.operators.requests import review_requests, search_requests


@query(f"SELECT doc_id, {norm_sql('text')} AS text FROM documents")
def normalize_space(spark: SparkSession, sf: str) -> DataFrame:
    docs = R.table(spark, sf, "documents")
    return docs.select("doc_id", X.normalize_space(F.col("text")).alias("text"))


_PROSE = "'See (' || url || ') or [' || url || ']; \"' || url || '\".' || html"


@query(f"""
SELECT page_id, url_no - 1 AS url_no, found[url_no] AS url
FROM (SELECT page_id, found, unnest(range(1, len(found) + 1)) AS url_no FROM (
  SELECT page_id, regexp_extract_all({_PROSE}, 'https?://[^\\s\\]\\[\\"''<>]+') AS found FROM pages))
""")
def extract_urls(spark: SparkSession, sf: str) -> DataFrame:
    pages = R.table(spark, sf, "pages").withColumn("prose", F.expr(_PROSE))
    found = pages.select(
        "page_id", F.posexplode(X.extract_urls(F.col("prose"))).alias("url_no", "url")
    )
    return found.withColumn("url_no", F.col("url_no").cast("long"))


_TRACKING = "otracker=s&iid=1&pid=P"


def _tracked(pages: DataFrame) -> DataFrame:
    """Page URLs with tracking keys, blanks, an empty value and a fragment added."""
    base = F.regexp_extract("url", "^[^?#]*", 0)
    query_text = F.regexp_extract("url", r"\?([^#]*)", 1)
    return pages.select(
        "page_id",
        F.concat(
            F.lit("  "), base, F.lit("?"), query_text,
            F.lit("&" + _TRACKING), F.col("page_id").cast("string"),
            F.lit("&aspect=x&v=a%20b*~&e=&qH=2&v=z#top "),
        ).alias("url"),
    )


@query("""
SELECT page_id, regexp_extract(url, '^[^?#]*') || '?'
  || CASE WHEN url LIKE '%?%' THEN regexp_extract(url, '\\?([^#]*)', 1) || '&' ELSE '' END
  || 'pid=P' || page_id || '&v=a+b%2A~&qH=2' AS url
FROM pages
""")
def canonicalize_url(spark: SparkSession, sf: str) -> DataFrame:
    tracked = _tracked(R.table(spark, sf, "pages"))
    return tracked.select("page_id", U.canonicalize_url(F.col("url")).alias("url"))


_HOST_SQL = "regexp_extract(url, '^[a-z]+://([^/?#]*)', 1)"
_PATH_SQL = "regexp_extract(url, '^[a-z]+://[^/?#]*([^?#]*)', 1)"


@query(f"""
SELECT page_id, 'https://' || lower({_HOST_SQL}) || rtrim({_PATH_SQL}, '/') AS url FROM pages
""")
def canonical_product_url(spark: SparkSession, sf: str) -> DataFrame:
    parts = F.regexp_extract
    pattern = r"^[a-z]+://([^/?#]*)(.*)"
    local = F.concat(
        F.lit("HTTP://"), F.upper(parts("url", pattern, 1)), F.lit("/hi"), parts("url", pattern, 2)
    )
    pages = R.table(spark, sf, "pages")
    return pages.select("page_id", U.canonical_product_url(local).alias("url"))


@query("""
SELECT p_partkey, page_no, pid AS product_id,
  'https://www.shop.example/mobile-phone/product-reviews/itm' || p_partkey
    || '?pid=' || pid || '&page=' || page_no AS request_url
FROM (SELECT p_partkey, unnest([1, 2, 3])::INT AS page_no,
        'MOB' || lpad(p_partkey::VARCHAR, 10, '0') AS pid FROM part)
""")
def review_urls(spark: SparkSession, sf: str) -> DataFrame:
    key = F.col("p_partkey")
    pid = F.concat(F.lit("MOB"), F.lpad(key.cast("string"), 10, "0"))
    urls = R.table(spark, sf, "part").select(
        "p_partkey", F.concat(R.product_url(key), F.lit("?x=1&pid="), pid).alias("product_url")
    )
    return review_requests(urls, 3).drop("product_url")


@query("""
SELECT page_id, page_no, CASE
  WHEN url LIKE '%page=2%' THEN replace(split_part(url, '#', 1), 'page=2', 'page=' || page_no)
  WHEN url LIKE '%?%' THEN split_part(url, '#', 1) || '&page=' || page_no
  ELSE split_part(url, '#', 1) || '?page=' || page_no END AS request_url
FROM (SELECT page_id, url, unnest([1, 2, 3])::INT AS page_no FROM pages)
""")
def with_page_param(spark: SparkSession, sf: str) -> DataFrame:
    searches = R.table(spark, sf, "pages").select("page_id", F.col("url").alias("search_url"))
    return search_requests(searches, 3).drop("search_url")


def _id_url(suffix: Column) -> Column:
    return F.concat(F.regexp_extract("url", "^[^?#]*", 0), suffix)


@query("""
SELECT page_id, CASE page_id % 3 WHEN 0 THEN 'P' || page_id
  WHEN 1 THEN 'MOB' || lpad(page_id::VARCHAR, 9, '0') ELSE 'UNKNOWN' END AS pid
FROM pages
""")
def extract_pid(spark: SparkSession, sf: str) -> DataFrame:
    page = F.col("page_id").cast("string")
    url = (
        F.when(F.col("page_id") % 3 == 0, _id_url(F.concat(F.lit("?pid=&pid=P"), page)))
        .when(F.col("page_id") % 3 == 1, _id_url(F.concat(F.lit("/x-MOB"), F.lpad(page, 9, "0"))))
        .otherwise(_id_url(F.lit("?q=MOBX123456789")))
    )
    return R.table(spark, sf, "pages").select("page_id", U.extract_pid(url).alias("pid"))


@query("""
SELECT page_id, CASE page_id % 3 WHEN 0 THEN 'itm' || page_id
  WHEN 1 THEN 'MOBX123456789' ELSE '' END AS product_id
FROM pages
""")
def extract_product_id(spark: SparkSession, sf: str) -> DataFrame:
    page = F.col("page_id").cast("string")
    url = (
        F.when(F.col("page_id") % 3 == 0, _id_url(F.concat(F.lit("/p/itm"), page, F.lit("/x?a=1"))))
        .when(F.col("page_id") % 3 == 1, _id_url(F.lit("?q=MOBX123456789")))
        .otherwise(_id_url(F.lit("")))
    )
    pages = R.table(spark, sf, "pages")
    return pages.select("page_id", U.extract_product_id(url).alias("product_id"))


@query("""
SELECT doc_id, TRY_CAST(nullif(regexp_extract(replace(text, ',', ''), '\\d+'), '') AS INT) AS n
FROM documents
""")
def to_int(spark: SparkSession, sf: str) -> DataFrame:
    return R.table(spark, sf, "documents").select("doc_id", X.to_int(F.col("text")).alias("n"))


def _key_sql(text: str) -> str:
    return f"sha256({norm_sql('source')} || '||' || {norm_sql('lang')} || '||' || {norm_sql(text)})"


@query(f"SELECT doc_id, {_key_sql('text')} AS key FROM documents")
def stable_hash(spark: SparkSession, sf: str) -> DataFrame:
    key = X.stable_hash(F.col("source"), F.col("lang"), F.col("text"))
    return R.table(spark, sf, "documents").select("doc_id", key.alias("key"))


@query(f"""
SELECT doc_id, sha256(doc_id || '||' || {norm_sql('source')} || '||' || {norm_sql('lang')} || '||t||'
  || {norm_sql('substr(text, 1, 200)')}) AS leading,
  sha256(doc_id || '||' || {norm_sql('source')} || '||' || {norm_sql('lang')} || '||t||'
  || {norm_sql('text')}) AS whole
FROM documents
""")
def review_keys(spark: SparkSession, sf: str) -> DataFrame:
    """Review keys over the leading characters of a text, their default, and over all of it."""
    parts = [F.col("doc_id").cast("string"), F.col("source"), F.col("lang"), F.lit("t"), F.col("text")]
    return R.table(spark, sf, "documents").select(
        "doc_id", X.review_key(*parts).alias("leading"), X.review_key(*parts, chars=None).alias("whole")
    )


@query("SELECT page_id, substr(sha256(url), 1, 20) AS product_id FROM pages")
def surrogate_id(spark: SparkSession, sf: str) -> DataFrame:
    pages = R.table(spark, sf, "pages")
    return pages.select("page_id", U.surrogate_id(F.col("url")).alias("product_id"))


@query("""
SELECT p_partkey, CASE WHEN p_partkey % 20 = 8 THEN '' ELSE p_brand END AS super_category
FROM part
""")
def first_match(spark: SparkSession, sf: str) -> DataFrame:
    found = X.first_match(F.col("html"), "superCategory")
    return R.product_pages(spark, sf).select("p_partkey", found.alias("super_category"))


@query(f"""
SELECT page_id, url FROM pages
WHERE contains(lower({_PATH_SQL}), '/') AND (contains(lower({_PATH_SQL}), 'en')
  OR contains(lower({_PATH_SQL}), 'fr')) AND NOT contains(lower({_PATH_SQL}), '7')
  AND NOT contains(lower({_PATH_SQL}), '.html')
""")
def candidate_urls(spark: SparkSession, sf: str) -> DataFrame:
    keep = C.is_candidate_url(F.col("url"), ("en", "fr"), ("7", ".html"), marker="/")
    return R.table(spark, sf, "pages").filter(keep).select("page_id", "url")


def _any_sql(text: str, words: tuple[str, ...]) -> str:
    return "(" + " OR ".join(f"contains({text}, '{w}')" for w in words) + ")"


_TITLES = ("{n} samsung 5g", "{n} back cover", "pixel frame {n}", "{n} Smartphone", "{n}", "HMD {n}  gb")
_CATEGORIES = ("Mobiles", "Mobile Accessories", "Showcase", "", "Handset")


def _titles(name: str) -> str:
    cases = " ".join(
        f"WHEN {i} THEN '{t.split('{n}')[0]}' || p_name || '{t.split('{n}')[1]}'"
        for i, t in enumerate(_TITLES)
    )
    return f"CASE p_partkey % {len(_TITLES)} {cases} END AS {name}"


def _categories(name: str) -> str:
    cases = " ".join(f"WHEN {i} THEN '{c}'" for i, c in enumerate(_CATEGORIES))
    return f"CASE p_size % {len(_CATEGORIES) + 3} {cases} ELSE '' END AS {name}"


@query(f"""
SELECT p_partkey, CASE
  WHEN {_any_sql('place', S.EXCLUDE_CATEGORY_HINTS)} THEN false
  WHEN {_any_sql('name', S.EXCLUDE_TITLE_HINTS)} THEN false
  WHEN {_any_sql('place', S.MOBILE_CATEGORY_HINTS)} THEN true
  WHEN {_any_sql('name', S.PHONE_TITLE_WORDS)} THEN true
  ELSE {_any_sql('name', S.PHONE_BRAND_HINTS)} AND {_any_sql('name', S.PHONE_FEATURE_WORDS)}
  END AS is_mobile
FROM (SELECT p_partkey, lower({norm_sql('title')}) AS name,
        lower(CASE WHEN category = '' THEN p_type ELSE category || ' ' || p_type END) AS place
      FROM (SELECT p_partkey, p_type, {_titles('title')}, {_categories('category')} FROM part))
""")
def classify_products(spark: SparkSession, sf: str) -> DataFrame:
    parts = R.table(spark, sf, "part").selectExpr(
        "p_partkey", "p_type", _titles("title"), _categories("category")
    )
    mobile = C.classify_product(F.col("title"), F.col("category"), F.lit(""), F.col("p_type"))
    return parts.select("p_partkey", mobile.alias("is_mobile"))


def _walled(pages: DataFrame) -> DataFrame:
    """Every tenth page becomes a bot check; status follows the id."""
    key = F.col("page_id")
    wall = F.lit("<html><title>reCAPTCHA</title><h1>Are You a HUMAN?</h1></html>")
    return pages.select(
        "page_id",
        F.when(key % 4 == 0, 403)
        .when(key % 7 == 1, 404)
        .when(key % 7 == 2, 500)
        .when(key % 7 == 3, 503)
        .otherwise(200)
        .alias("status"),
        F.when(key % 10 == 0, wall).otherwise(F.col("html")).alias("html"),
    )


@query("SELECT page_id FROM pages WHERE page_id % 10 = 0")
def challenge_pages(spark: SparkSession, sf: str) -> DataFrame:
    pages = _walled(R.table(spark, sf, "pages"))
    return pages.filter(C.is_challenge_page(F.col("html"))).select("page_id")


@query("""
SELECT page_id, CASE WHEN page_id % 20 = 0 THEN 'blocked' WHEN page_id % 4 = 0 THEN 'parsed'
  WHEN page_id % 7 = 1 THEN 'gone' WHEN page_id % 7 = 3 THEN 'failed' ELSE 'parsed' END AS outcome
FROM pages
""")
def page_outcomes(spark: SparkSession, sf: str) -> DataFrame:
    pages = _walled(R.table(spark, sf, "pages"))
    return pages.select(
        "page_id", C.page_outcome(F.col("status"), F.col("html")).alias("outcome")
    )
