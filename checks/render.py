"""Renders the given tables as pages, sitemaps and files for the round-trip queries.

Everything is built by Spark from the tables, so its size grows with them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SITE = "https://www.shop.example"
DOMAIN = "shop.example"


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    """A given table, on all cores: its one file may be a single row group."""
    return many_tasks(spark.read.parquet(f"{sf}/{name}.parquet"))


def many_tasks(df: DataFrame) -> DataFrame:
    """Render on all cores even where the table is small."""
    return df.repartition(df.sparkSession.sparkContext.defaultParallelism)


def escape_html(text: Column) -> Column:
    for raw, name in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        text = F.replace(text, F.lit(raw), F.lit(name))
    return text


def jsonld(value: Column) -> Column:
    """A JSON-LD script element around a struct column."""
    body = F.replace(F.to_json(value, {"ignoreNullFields": "false"}), F.lit("</"), F.lit("<\\/"))
    return F.concat(F.lit('<script type="application/ld+json">'), body, F.lit("</script>"))


def html_page(*parts: Column) -> Column:
    return F.concat(
        F.lit("<!DOCTYPE html><html><head><!-- <script type=\"application/ld+json\">{}</script> -->"),
        *parts,
        F.lit("</body></html>"),
    )


def product_url(key: Column) -> Column:
    return F.concat(F.lit(f"{SITE}/mobile-phone/p/itm"), key.cast("string"))


def product_pages(spark: SparkSession, sf: str) -> DataFrame:
    """One page per part: JSON-LD product; every third one only as markup."""
    part = table(spark, sf, "part")
    key = F.col("p_partkey")
    price = F.struct(
        F.col("p_retailprice").alias("price"), F.lit("INR").alias("priceCurrency")
    )
    data = jsonld(
        F.struct(
            F.lit("Product").alias("@type"),
            F.col("p_name").alias("name"),
            F.col("p_type").alias("category"),
            price.alias("offers"),
        )
    )
    state = F.concat(
        F.lit('<script>window.s={"superCategory":"null","superCategory":"'),
        F.col("p_brand"),
        F.lit('","category":"Mobiles"}</script>'),
    )
    shown = F.concat(
        F.lit('<div class="a"><h1 class="t"><span>'),
        escape_html(F.col("p_name")),
        F.lit('</span></h1><div class="XQDdHH">'),
        (F.col("p_size") % 5 + 1).cast("string"),
        F.lit('<img src="s.png"></div><span class="Wphh3N">'),
        F.format_number(F.col("p_size") * 1000, 0),
        F.lit(" Ratings</span></div>"),
    )
    markup_only = key % 3 == 0
    return part.select(
        "p_partkey",
        product_url(key).alias("request_url"),
        product_url(key).alias("final_url"),
        F.when(key % 10 == 7, 404)
        .when(key % 10 == 8, 403)
        .when(key % 10 == 9, 500)
        .otherwise(200)
        .alias("status"),
        F.when(
            key % 20 == 8,
            F.lit("<html><title>reCAPTCHA</title><h1>Are you a human?</h1></html>"),
        )
        .otherwise(
            html_page(F.when(markup_only, F.lit("")).otherwise(data), state, F.lit("<body>"), shown)
        )
        .alias("html"),
    )


def reviews(spark: SparkSession, sf: str) -> DataFrame:
    """One review per conversation turn: product = conversation, page = turn / 2."""
    turns = table(spark, sf, "conversations")
    return turns.select(
        F.col("conv_id"),
        F.col("turn"),
        (F.floor(F.col("turn") / 2) + 1).cast("int").alias("page_no"),
        F.concat(F.lit(f"{SITE}/phone/p/itm"), F.col("conv_id").cast("string"), F.lit("?pid=PID"),
                 F.lpad(F.col("conv_id").cast("string"), 10, "0")).alias("product_url"),
        F.col("role").alias("reviewer"),
        F.col("text").alias("body"),
    )


def _review_object() -> Column:
    return F.struct(
        F.lit("Review").alias("@type"),
        F.concat(F.lit("Turn "), F.col("turn").cast("string")).alias("name"),
        F.col("body").alias("reviewBody"),
        F.struct(F.col("reviewer").alias("name")).alias("author"),
        F.struct((F.col("turn") % 5 + 1).cast("double").alias("ratingValue")).alias("reviewRating"),
        F.col("turn").alias("sku"),
    )


def _review_block() -> Column:
    def tag(name: str, css: str, text: Column) -> Column:
        return F.concat(F.lit(f'<{name} class="{css}">'), escape_html(text), F.lit(f"</{name}>"))

    turn = F.col("turn").cast("string")
    return F.concat(
        F.lit('<div class="_27M-vq x"><br>'),
        tag("div", "XQDdHH", (F.col("turn") % 5 + 1).cast("string")),
        tag("p", "z9E0IG", F.concat(F.lit("Turn "), turn)),
        tag("div", "ZmyHeo", F.col("body")),
        tag("p", "_2sc7ZR", F.col("reviewer")),
        tag("p", "_2NsDsF", F.lit("12 Jan, 2024")),
        F.lit("<b>Certified Buyer, his rating and that of all others in this shop counts"),
        F.lit("</div>"),
    )


def review_pages(spark: SparkSession, sf: str, kind: str = "json") -> DataFrame:
    """Pages of rendered reviews: ``json``, ``html``, or ``mixed`` (even ids JSON).

    Mixed JSON pages carry markup blocks too, which then must not count.
    """
    page = (
        reviews(spark, sf)
        .withColumn("object", _review_object())
        .withColumn("block", _review_block())
        .groupBy("conv_id", "product_url", "page_no")
        .agg(F.sort_array(F.collect_list(F.struct("turn", "object", "block"))).alias("rs"))
    )
    objects = F.transform("rs", lambda r: r["object"])
    nested = F.struct(F.struct(objects.alias("review"), F.lit("Product").alias("@type")).alias("@graph"))
    flat = F.struct(F.lit("Product").alias("@type"), objects.alias("review"))
    data = F.when(F.col("conv_id") % 7 == 0, jsonld(nested)).otherwise(jsonld(flat))
    blocks = F.array_join(F.transform("rs", lambda r: r["block"]), "")
    even = F.col("conv_id") % 2 == 0
    html = {
        "json": html_page(data, F.lit("<body>")),
        "html": html_page(F.lit("<body>"), blocks),
        "mixed": F.when(even, html_page(data, F.lit("<body>"), blocks)).otherwise(
            html_page(F.lit("<body>"), blocks)
        ),
    }[kind]
    return many_tasks(page).select(
        "conv_id", "product_url", "page_no", F.lit(200).alias("status"), html.alias("html")
    )


def graph_pages(spark: SparkSession, sf: str) -> DataFrame:
    """Customers as product pages that link to two others; some pages are walls."""
    customer = table(spark, sf, "customer")
    n = customer.count()
    key = F.col("c_custkey")

    def link(k: Column) -> Column:
        return F.concat(
            F.lit('<a class=l href="../../mobile-phone/p/itm'), k.cast("string"), F.lit('?x=1">go</a>')
        )

    url = product_url(key)
    return customer.select(
        "c_custkey",
        url.alias("request_url"),
        url.alias("final_url"),
        F.when(key % 11 == 5, 500).otherwise(200).alias("status"),
        F.concat(
            F.lit("<body><!-- <a href='/mobile-phone/p/itm0'> -->"),
            link(key * 2 % n),
            link((key * 3 + 1) % n),
            F.lit('<a href="https://other.example/p/itm1">x</a></body>'),
        ).alias("html"),
    )


# Sitemaps stay short whatever the table size: URLs per shard, shards per index.
SHARD_URLS = 200
INDEX_SHARDS = 5


def sitemap_documents(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """(indexes, shards): parts as URLs, 200 to a shard, five shards to an index."""
    ns = 'xmlns="http://www.sitemaps.org/schemas/sitemap/0.9"'
    part = table(spark, sf, "part")
    shard_no = F.floor(F.col("p_partkey") / SHARD_URLS)
    urls = part.select("p_partkey", shard_no.alias("shard_no"))
    shard_url = F.concat(F.lit(f"{SITE}/map-"), F.col("shard_no").cast("string"), F.lit(".xml"))
    entry = F.concat(
        F.lit("<url><loc> "),
        F.replace(product_url(F.col("p_partkey")), F.lit(SITE), F.lit("http://WWW.Shop.example/hi")),
        F.lit("/ </loc></url>"),
    )
    shards = (
        urls.groupBy("shard_no")
        .agg(F.sort_array(F.collect_list(F.struct("p_partkey", entry.alias("entry")))).alias("es"))
        .select(
            "shard_no",
            shard_url.alias("shard_url"),
            F.lit(200).alias("status"),
            F.concat(
                F.lit(f'<?xml version="1.0"?><urlset {ns}>'),
                F.array_join(F.transform("es", lambda e: e["entry"]), ""),
                F.lit("</urlset>"),
            ).alias("xml"),
        )
    )
    listed = F.concat(
        F.lit("<sitemap><loc>"), F.col("shard_url"), F.lit("</loc>"),
        F.when(F.col("shard_no") % 2 == 0, F.lit("<lastmod> 2024-01-01 </lastmod>"))
        .otherwise(F.lit("")),
        F.lit("</sitemap>"),
    )
    indexes = (
        shards.withColumn("entry", listed)
        .groupBy(F.floor(F.col("shard_no") / INDEX_SHARDS).alias("index_ord"))
        .agg(F.sort_array(F.collect_list(F.struct("shard_no", "entry"))).alias("es"))
        .select(
            "index_ord",
            F.lit(200).alias("status"),
            F.concat(
                F.lit(f"<sitemapindex {ns}>"),
                F.array_join(F.transform("es", lambda e: e["entry"]), ""),
                F.lit("<sitemap><lastmod>x</lastmod></sitemap></sitemapindex>"),
            ).alias("xml"),
        )
    )
    return indexes, shards.drop("shard_no")
