"""Checks of the page operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from checks import render as R
from checks.registry import norm_sql, query
from sitefold.operators import parse_pages as P
from sitefold.sources.pages import as_landed


@query("""
SELECT p_partkey, p_name AS name, 0 AS script_no FROM part
WHERE p_partkey % 3 <> 0 AND p_partkey % 20 <> 8
""")
def jsonld_docs(spark: SparkSession, sf: str) -> DataFrame:
    docs = P.jsonld_documents(R.product_pages(spark, sf))
    name = F.get_json_object("document", "$.name")
    return docs.select("p_partkey", name.alias("name"), "script_no")


_TURN = "conv_id, (turn // 2 + 1)::INT AS page_no, (turn % 2)::INT AS pos"
_FIELDS = (
    "(turn % 5 + 1)::INT AS rating, 'Turn ' || turn AS title, "
    f"{norm_sql('text')} AS review_text, role AS reviewer"
)


def _review_rows(df: DataFrame) -> DataFrame:
    return df.drop("product_url", "status")


@query(f"""
SELECT {_TURN}, {_FIELDS}, '' AS review_date, turn::VARCHAR AS variant,
  NULL::INT AS helpful_count FROM conversations
""")
def jsonld_reviews(spark: SparkSession, sf: str) -> DataFrame:
    return _review_rows(P.jsonld_reviews(R.review_pages(spark, sf, "json")))


@query(f"""
SELECT {_TURN}, {_FIELDS}, '12 Jan, 2024' AS review_date, '' AS variant,
  NULL::INT AS helpful_count FROM conversations
""")
def html_reviews(spark: SparkSession, sf: str) -> DataFrame:
    return _review_rows(P.html_reviews(R.review_pages(spark, sf, "html")))


@query(f"""
SELECT {_TURN}, {_FIELDS}, CASE WHEN conv_id % 2 = 0 THEN '' ELSE '12 Jan, 2024' END AS review_date,
  CASE WHEN conv_id % 2 = 0 THEN turn::VARCHAR ELSE '' END AS variant,
  NULL::INT AS helpful_count FROM conversations
""")
def review_pages(spark: SparkSession, sf: str) -> DataFrame:
    return _review_rows(P.page_reviews(R.review_pages(spark, sf, "mixed")))


PRODUCT_SQL = """
SELECT p_partkey, 'itm' || p_partkey AS product_id,
  'https://www.shop.example/mobile-phone/p/itm' || p_partkey AS product_url,
  CASE WHEN wall THEN 'Are you a human?' ELSE p_name END AS title,
  CASE WHEN wall OR shown THEN '' ELSE p_retailprice::VARCHAR END AS price,
  CASE WHEN wall OR shown THEN '' ELSE 'INR' END AS currency,
  CASE WHEN wall THEN '' ELSE (p_size % 5 + 1)::VARCHAR END AS rating,
  CASE WHEN wall THEN '' ELSE (p_size * 1000)::VARCHAR END AS review_count,
  CASE WHEN wall THEN '' WHEN shown THEN 'Mobiles' ELSE p_type END AS category,
  CASE WHEN wall THEN '' ELSE p_brand END AS super_category, '' AS sub_category,
  shown AND NOT wall AS is_mobile
FROM (SELECT *, p_partkey % 3 = 0 AS shown, p_partkey % 20 = 8 AS wall FROM part)
"""


@query(PRODUCT_SQL)
def products(spark: SparkSession, sf: str) -> DataFrame:
    rows = P.products(R.product_pages(spark, sf))
    return rows.drop("request_url", "final_url", "status")


_NO_SCRIPT = "regexp_replace(html, '<!--.*?-->|<script.*?</script>|<style.*?</style>', '', 'gs')"
_HOST = "regexp_extract(url, '^[a-z]+://([^/?#]*)', 1)"


@query(f"""
SELECT page_id, link FROM (SELECT DISTINCT page_id, 'https://' || lower({_HOST})
        || regexp_replace(regexp_extract(href, '^[^?#]*'), '([^/])/+$', '\\1') AS link
  FROM (SELECT page_id, url, unnest(regexp_extract_all({_NO_SCRIPT}, '<a href="([^"]*)"', 1)) AS href
        FROM pages))
""")
def page_links(spark: SparkSession, sf: str) -> DataFrame:
    pages = as_landed(R.table(spark, sf, "pages")).select("page_id", "final_url", "html")
    return P.product_links(pages, "example.", marker="/").drop("final_url")


@query("""
SELECT page_id, tag, count(*) AS n
FROM (SELECT page_id, lower(unnest(regexp_extract_all(
    regexp_replace(regexp_replace(html, '<!--.*?-->', '', 'gs'),
      '(<(?:script|style))[^>]*>.*?</(?:script|style)>', '\\1>', 'gs'),
    '<([a-zA-Z][a-zA-Z0-9]*)', 1))) AS tag FROM pages)
GROUP BY page_id, tag
""")
def elements(spark: SparkSession, sf: str) -> DataFrame:
    found = P.elements(R.table(spark, sf, "pages"))
    return found.groupBy("page_id", "tag").agg(F.count("*").alias("n"))


@query("""
SELECT page_id, 'li' AS tag, (unnest(range(len(items))))::BIGINT AS place,
  unnest(items) AS href
FROM (SELECT page_id, regexp_extract_all(regexp_extract(html, '<nav>(.*?)</nav>', 1, 's'),
        '<li><a href="([^"]*)"', 1) AS items FROM pages)
""")
def element_tree(spark: SparkSession, sf: str) -> DataFrame:
    """Links by their list item: parent and attribute columns of the element table."""
    found = P.elements(R.table(spark, sf, "pages"))
    items = found.filter("tag = 'li'").select("page_id", F.col("node_id").alias("parent_id"), "tag")
    links = found.filter("tag = 'a'").select("page_id", "parent_id", "node_id", F.col("attrs")["href"].alias("href"))
    rows = links.join(items, ["page_id", "parent_id"])
    # The window stays within one page.
    place = F.row_number().over(Window.partitionBy("page_id").orderBy("node_id")) - 1
    return rows.select("page_id", "tag", place.cast("long").alias("place"), "href")


@query("""
SELECT doc_id, 'https://www.shop.example/mobile-phone/p/itm' || doc_id AS link FROM documents
UNION ALL
SELECT doc_id, 'https://www.shop.example/mobile-phone/p/itm' || doc_id || 'z' FROM documents
""")
def rough_pages(spark: SparkSession, sf: str) -> DataFrame:
    """Links in tags that hold thousands of bare words, and in pages with unclosed quotes."""
    # Words of a text as attributes: whatever could end a tag or open a quote is taken out.
    words = F.repeat(F.concat(F.regexp_replace("text", "[<>\"'=/&]", ""), F.lit(" ")), 5)
    key = F.col("doc_id").cast("string")
    path = F.concat(F.lit("/mobile-phone/p/itm"), key)
    html = F.concat(
        F.lit("<a href='/x' "), words, F.lit(' href="'), path, F.lit('">x</a><p class="open>'),
        F.lit("</p><a class=x href='"), path, F.lit("z'>y</a>"),
    )
    pages = R.table(spark, sf, "documents").select(
        "doc_id", F.lit(f"{R.SITE}/list").alias("final_url"), html.alias("html")
    )
    return P.product_links(pages, R.DOMAIN).select("doc_id", "link")


@query("""
WITH words AS (
  SELECT doc_id, len(regexp_extract_all(text, '[a-z]+')) AS n FROM documents WHERE text IS NOT NULL)
SELECT doc_id, n AS n_items, n AS n_words, 1 AS n_ends, n AS deepest FROM words WHERE n > 0
""")
def large_pages(spark: SparkSession, sf: str) -> DataFrame:
    """Two elements for each word of a text, list items that nothing closes, stray end tags."""
    text = F.regexp_replace("text", "[<>&]", " ")
    items = F.regexp_replace(text, "[a-z]+", "<li></i><b>w</b>")
    pages = R.table(spark, sf, "documents").select(
        "doc_id", F.concat(F.lit("<ul>"), items, F.lit("</li2></ul>")).alias("html")
    )
    found = P.elements(pages)
    is_item = F.col("tag") == "li"
    # Different places are counted as bits, 64 to a row, so that a page leaves fewer rows than it has items.
    word = {c: F.when(is_item, F.shiftright(c, 6)) for c in ("end_id", "parent_id")}
    bits = {c: F.bit_or(F.when(is_item, F.expr(f"shiftleft(1L, {c} & 63)"))) for c in word}
    rows = found.groupBy("doc_id", *[w.alias(f"{c}_word") for c, w in word.items()]).agg(
        F.count_if(is_item).alias("n_items"),
        F.count_if(F.col("tag") == "b").alias("n_words"),
        *[b.alias(f"{c}_bits") for c, b in bits.items()],
    )
    # Words of one column meet again: a word of the one lies with several of the other.
    words = rows.selectExpr(
        "doc_id",
        """inline(array(
            struct('end' AS kind, end_id_word AS word, end_id_bits AS bits, n_items, n_words),
            struct('parent' AS kind, parent_id_word AS word, parent_id_bits AS bits, 0L AS n_items, 0L AS n_words)))""",
    )
    sums = {n: F.sum(n).alias(n) for n in ("n_items", "n_words")}
    words = words.groupBy("doc_id", "kind", "word").agg(F.bit_or("bits").alias("bits"), *sums.values())
    # All items end with the list; each lies in the one before.
    n_of = {k: F.coalesce(F.sum(F.when(F.col("kind") == k, F.bit_count("bits"))), F.lit(0)) for k in ("end", "parent")}
    return (
        words.groupBy("doc_id")
        .agg(*sums.values(), n_of["end"].alias("n_ends"), n_of["parent"].alias("deepest"))
        .where("n_items > 0")
    )


_TEXT_ONLY_SQL = """'Fine thing, ' || (c_custkey % 5 + 1) || ' stars, says Nm' || c_custkey || ', '
    || (c_custkey % 28 + 1) || ' March 2023 in a long enough review.'
    || CASE WHEN c_custkey % 4 = 0 THEN '' ELSE ' Color: C' || c_custkey || ' |' END
    || CASE WHEN c_custkey % 3 = 0 THEN '' ELSE ' 1,' || (c_custkey % 900 + 100) || ' people found this helpful.' END
    || ' read more'"""


@query(f"""
SELECT c_custkey // 5 AS page_id,
  CAST(row_number() OVER (PARTITION BY c_custkey // 5 ORDER BY c_custkey) - 1 AS INT) AS pos,
  CAST(c_custkey % 5 + 1 AS INT) AS rating, '' AS title, {_TEXT_ONLY_SQL} AS review_text,
  'says Nm' || c_custkey AS reviewer, (c_custkey % 28 + 1) || ' March 2023' AS review_date,
  CASE WHEN c_custkey % 4 = 0 THEN '' ELSE 'C' || c_custkey END AS variant,
  CASE WHEN c_custkey % 3 = 0 THEN NULL ELSE CAST(1000 + c_custkey % 900 + 100 AS INT) END AS helpful_count
FROM customer
""")
def html_text_reviews(spark: SparkSession, sf: str) -> DataFrame:
    """Blocks without inner selectors, so all is read from their text, each twice on its page."""
    key = F.col("c_custkey")
    blob = F.concat(
        F.lit("<b>Fine</b> thing, "), key % 5 + 1, F.lit(" stars, says Nm"), key, F.lit(", "), key % 28 + 1,
        F.lit(" March 2023 in a long enough review."),
        F.when(key % 4 == 0, "").otherwise(F.concat(F.lit(" Color: C"), key, F.lit(" |"))),
        F.when(key % 3 == 0, "").otherwise(
            F.concat(F.lit(" 1,"), key % 900 + 100, F.lit(" people found this helpful."))
        ),
        F.lit(" read more"),
    )
    block = F.concat(F.lit('<div class="_27M-vq"><p>'), blob, F.lit("</p></div>"))
    rows = R.table(spark, sf, "customer").select(
        F.floor(key / 5).alias("page_id"), F.struct(key.alias("k"), block.alias("b")).alias("r")
    )
    blocks = F.expr("array_join(transform(sort_array(collect_list(r)), x -> x.b), '')")
    pages = rows.groupBy("page_id").agg(blocks.alias("html"))
    return P.html_reviews(pages.withColumn("html", F.concat("html", "html")))
