"""Result files: reviews as JSONL and CSV, also one folder per product; catalog CSV."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sitefold.functions.text import safe_product_id
from sitefold.session import settle
from sitefold.settings import CATALOG_COLUMNS, REVIEW_COLUMNS, REVIEW_FORMATS
from sitefold.sources.staged import StagedAppend

_JSON_OPTIONS = {"ignoreNullFields": "false", "writeNonAsciiCharacterAsCodePoint": "true"}
_CSV_OPTIONS = {"header": "true", "escape": '"', "emptyValue": "", "lineSep": "\r\n"}


def _ordered(df: DataFrame, columns: tuple[str, ...]) -> DataFrame:
    return df.select(*[c for c in columns if c in df.columns])


def write_jsonl(reviews: DataFrame, path: str, partition: str | None = None) -> None:
    """Append JSON lines: fixed key order, nulls written, ASCII only."""
    writer = reviews.write.mode("append").options(**_JSON_OPTIONS)
    (writer.partitionBy(partition) if partition else writer).json(path)


def write_csv(rows: DataFrame, path: str, partition: str | None = None) -> None:
    """Append CSV with a header per file."""
    writer = rows.write.mode("append").options(**_CSV_OPTIONS)
    (writer.partitionBy(partition) if partition else writer).csv(path)


def write_reviews(
    reviews: DataFrame,
    folder: str,
    fmt: str = "both",
    per_product: bool = False,
    run_id: str | None = None,
) -> None:
    """Append reviews as ``csv``, ``jsonl`` or ``both``; no file is written for no rows.

    ``per_product`` makes one sub-folder per product. A rebalance by product keeps the
    number of files low and splits a large product over several tasks. With a ``run_id`` a
    run repeated after a failure leaves each row once in each format (``StagedAppend``).
    """
    if fmt not in REVIEW_FORMATS:
        raise ValueError(f"fmt must be one of {REVIEW_FORMATS}")
    rows = _ordered(reviews, REVIEW_COLUMNS)
    if run_id is None:
        _write_reviews(rows, folder, fmt, per_product)
    else:
        staged = StagedAppend(reviews.sparkSession, folder, run_id)
        staged.append(lambda path: _write_reviews(rows, path, fmt, per_product))


def _write_reviews(rows: DataFrame, folder: str, fmt: str, per_product: bool) -> None:
    if fmt == "both":
        rows = settle(rows, "reviews-out")
    if rows.isEmpty():
        return
    partition = None
    if per_product:
        partition = "safe_product_id"
        rows = rows.withColumn(partition, safe_product_id(F.col("product_id")))
        rows = rows.hint("rebalance", partition)
    if fmt in ("jsonl", "both"):
        write_jsonl(rows, f"{folder}/jsonl", partition)
    if fmt in ("csv", "both"):
        write_csv(rows, f"{folder}/csv", partition)


def write_catalog(catalog: DataFrame, path: str, run_id: str | None = None) -> None:
    """Append catalog rows as CSV; with a ``run_id`` once, however often the run is repeated."""
    rows = _ordered(catalog, CATALOG_COLUMNS)
    if run_id is None:
        write_csv(rows, path)
    else:
        staged = StagedAppend(catalog.sparkSession, path, run_id)
        staged.append(lambda folder: write_csv(rows, folder))
