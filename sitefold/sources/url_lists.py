"""URL lists from text, CSV and JSON files, and seed lists: (file, ordinal, url)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sitefold.functions.text import extract_urls, normalize_space, strip
from sitefold.session import ordered_ids

def _lines(spark: SparkSession, path: str) -> DataFrame:
    """Text lines with their place; large files are read in splits."""
    return spark.read.text(path).select(
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("_start"),
        # Rises within a split, which is all the order needs.
        F.monotonically_increasing_id().alias("_line"),
        F.col("value").alias("line"),
    )


def _numbered(rows: DataFrame, *place: str) -> DataFrame:
    return ordered_ids(rows, "file", "_start", "_line", *place).select("file", "ordinal", "url")


def read_url_text(spark: SparkSession, path: str) -> DataFrame:
    """All URLs of each file; from files without any, the lines that are no comment."""
    lines = _lines(spark, path).withColumn("_urls", extract_urls(F.col("line")))
    with_urls = lines.groupBy("file").agg(F.max(F.size("_urls") > 0).alias("_any"))
    line = strip(F.col("line"))
    plain = F.when((line != "") & ~line.startswith("#"), F.array(line))
    rows = lines.join(with_urls, "file").select(
        "file", "_start", "_line",
        F.posexplode(F.when(F.col("_any"), F.col("_urls")).otherwise(plain)).alias("_no", "url"),
    )
    return _numbered(rows, "_no")


def read_url_csv(spark: SparkSession, path: str) -> DataFrame:
    """CSV with a header; the URL is in ``url``, else in ``product_url``.

    Ordinals rise by file, then by the place in it.
    """
    table = spark.read.csv(path, header=True, multiLine=True, escape='"')
    for name in ("url", "product_url"):
        if name in table.columns:
            break
    else:
        raise ValueError("CSV input must have a 'url' or 'product_url' column")
    rows = table.select(
        F.col("_metadata.file_path").alias("file"),
        # Values may span lines, so a file is one split, in which ids rise.
        F.monotonically_increasing_id().alias("_line"),
        strip(F.coalesce(F.col(name), F.lit(""))).alias("url"),
    )
    ordered = ordered_ids(rows.filter("url <> ''"), "file", "_line")
    return ordered.select("file", "ordinal", "url")


def read_url_json(spark: SparkSession, path: str) -> DataFrame:
    """JSON array per file; anything but an array is an error."""
    files = spark.read.text(path, wholetext=True).select(
        F.col("_metadata.file_path").alias("file"), F.col("value").alias("text")
    )
    text = strip(F.col("text"))
    items = F.from_json(F.col("text"), "array<string>")
    bad = F.raise_error(F.lit("JSON input must be an array of URLs")).cast("array<string>")
    checked = F.when(text.startswith("[") & items.isNotNull(), items).when(text != "", bad)
    rows = files.select("file", F.posexplode(checked).alias("ordinal", "url"))
    return rows.select(
        "file",
        F.col("ordinal").cast("long").alias("ordinal"),
        strip(F.coalesce("url", F.lit("None"))).alias("url"),
    ).filter("url <> ''")


def read_url_list(spark: SparkSession, path: str) -> DataFrame:
    """Pick the reader by the file ending."""
    low = path.lower()
    if low.endswith(".json"):
        return read_url_json(spark, path)
    if low.endswith(".csv"):
        return read_url_csv(spark, path)
    return read_url_text(spark, path)


def read_seeds(spark: SparkSession, path: str) -> DataFrame:
    """One URL per line; blank and '#' lines are skipped, a missing file is an error."""
    lines = _lines(spark, path).withColumn("url", normalize_space(F.col("line")))
    return _numbered(lines.filter("url <> '' AND NOT startswith(url, '#')"))
