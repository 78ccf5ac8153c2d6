"""Sitemap indexes and URL sets, from files (gz by ending) or from landed documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sitefold.functions.text import normalize_space, strip
from sitefold.session import settle
from sitefold.settings import FIRST_ERROR_STATUS

INDEX = "sitemap array<struct<loc string, lastmod string>>"
URLSET = "url array<struct<loc string>>"
_ROOT_PREFIX = r"<([A-Za-z_][\w.\-]*):(?:urlset|sitemapindex)[\s>]"


def read_xml_files(spark: SparkSession, path: str) -> DataFrame:
    """(file, xml); files that end in .gz are unpacked by Spark."""
    return spark.read.text(path, wholetext=True).select(
        F.col("_metadata.file_path").alias("file"), F.col("value").alias("xml")
    )


def plain_names(xml: Column) -> Column:
    """The document without the namespace prefix of its root element; other prefixes stay."""
    prefix = F.regexp_extract(xml, _ROOT_PREFIX, 1)
    bare = F.replace(xml, F.concat(F.lit("<"), prefix, F.lit(":")), F.lit("<"))
    bare = F.replace(bare, F.concat(F.lit("</"), prefix, F.lit(":")), F.lit("</"))
    return F.when(prefix != "", bare).otherwise(xml)


def parsed_documents(documents: DataFrame, schema: str) -> DataFrame:
    """The documents with ``_doc``; its ``_corrupt_record`` is set where the XML does not parse."""
    parsed = F.from_xml(
        plain_names(F.col("xml")), F.lit(f"{schema}, _corrupt_record string"), {"mode": "PERMISSIVE"}
    )
    # The one-row generator keeps later filters from parsing again.
    return documents.select("*", F.explode(F.array(parsed)).alias("_doc"))


def _read(documents: DataFrame, schema: str, entries: str, place: str) -> DataFrame:
    """Entries of landed documents: their columns, the place and ``_e``.

    Each document is parsed once. Documents with an HTTP error or whose XML does not parse
    are set aside; they do not end the job.
    """
    if "status" in documents.columns:
        documents = documents.filter(F.col("status") < FIRST_ERROR_STATUS)
    keep = [c for c in documents.columns if c not in ("xml", "status")]
    rows = parsed_documents(documents.filter(strip(F.col("xml")) != ""), schema)
    good = rows.filter("_doc._corrupt_record IS NULL")
    return good.select(*keep, F.posexplode(f"_doc.{entries}").alias(place, "_e"))


def sitemap_index(documents: DataFrame) -> DataFrame:
    """Shards the indexes list: document columns, ``shard_ord``, ``loc``, ``lastmod``.

    Entries without a location are skipped, a missing date becomes ''.
    """
    rows = _read(documents, INDEX, "sitemap", "shard_ord")
    return rows.select(
        *[c for c in rows.columns if c != "_e"],
        strip(F.col("_e.loc")).alias("loc"),
        normalize_space(F.col("_e.lastmod")).alias("lastmod"),
    ).filter("loc <> ''")


def sitemap_urls(documents: DataFrame) -> DataFrame:
    """URLs of the shards: document columns, ``url_ord``, ``loc``."""
    rows = _read(documents, URLSET, "url", "url_ord")
    return rows.select(
        *[c for c in rows.columns if c != "_e"], normalize_space(F.col("_e.loc")).alias("loc")
    ).filter("loc <> ''")


def read_index_entries(spark: SparkSession, path: str) -> DataFrame:
    """Entries of index files (gz by ending): ``file``, ``shard_ord``, ``loc``, ``lastmod``.

    The XML reader streams them, so no task holds a whole file, however long. Places count from
    0 in each file, as those of ``sitemap_index``. Elements must not carry a namespace prefix.
    """
    rows = _entries(spark, path, "sitemap", "loc string, lastmod string", "shard_ord")
    return rows.select(
        "file",
        "shard_ord",
        strip(F.coalesce("loc", F.lit(""))).alias("loc"),
        normalize_space(F.col("lastmod")).alias("lastmod"),
    ).filter("loc <> ''")


def read_url_entries(spark: SparkSession, path: str) -> DataFrame:
    """URLs of URL set files, streamed likewise: ``file``, ``url_ord``, ``loc``.

    For ``sitemap_candidates`` join the list of (file, shard_url) of whatever landed the files.
    """
    rows = _entries(spark, path, "url", "loc string", "url_ord")
    return rows.select("file", "url_ord", normalize_space(F.col("loc")).alias("loc")).filter(
        "loc <> ''"
    )


def _entries(spark: SparkSession, path: str, tag: str, schema: str, place: str) -> DataFrame:
    """Entries with ``file`` and their place in it.

    A file is one split, whose rows have consecutive ids; settled, since both sides of the join
    must see the same ids.
    """
    found = spark.read.format("xml").option("rowTag", tag).schema(schema).load(path)
    rows = settle(
        found.select(
            F.col("_metadata.file_path").alias("file"),
            F.monotonically_increasing_id().alias("_id"),
            *found.columns,
        ),
        f"entries-{tag}",
    )
    firsts = rows.groupBy("file").agg(F.min("_id").alias("_first"))
    return rows.join(firsts, "file").withColumn(place, F.col("_id") - F.col("_first")).drop(
        "_id", "_first"
    )
