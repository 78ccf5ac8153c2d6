"""Continuous forms of the two jobs: pages land, new rows are appended once.

Each micro-batch goes to a ``query_id`` and ``batch_id`` folder of a Parquet target and
replaces that folder, so a batch that runs again after a failure leaves no second
copy, and a second stream or a new checkpoint on the same target replaces nothing of an
earlier one. Keys of all other batches count as seen; they come from the target's key store,
of which a batch reads the hash prefixes it touches. What a batch did not read goes to the
target's ``_refused`` folder, by query and batch, and the numbers of pages and rows, observed
while they were read and written, to ``_counts``. Stop rules need all pages of a product and
stay with the batch job.
"""

from __future__ import annotations

from collections.abc import Callable

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from sitefold.functions.classify import page_outcome
from sitefold.functions.text import iso_utc
from sitefold.functions.urls import canonicalize_url, extract_pid
from sitefold.operators.dedupe import dedupe_catalog, dedupe_reviews, only_new
from sitefold.operators.parse_pages import page_reviews, products
from sitefold.operators.refused import product_page_reason, refused_inputs, review_page_reason
from sitefold.session import Workspace
from sitefold.streaming.keys import KeyStore
from sitefold.settings import FIRST_ERROR_STATUS, REVIEW_COLUMNS


def _observed(run: Observation, *names: str) -> dict[str, int]:
    """The counters of a finished write; 0 where its plan turned out to be empty."""
    try:
        found = run.get
    except Py4JJavaError:
        found = {}
    return {name: found.get(name, 0) for name in names}


def _append_new(
    rows_of: Callable[[DataFrame], DataFrame],
    reason: Callable[[Column, Column], Column],
    source: str,
    key: str,
    target: str,
) -> Callable[[DataFrame, int], None]:
    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        # Spark names the stream in a local property of the thread that runs the batch.
        query_id = spark.sparkContext.getLocalProperty("sql.streaming.queryId")
        own = f"query_id={query_id}/batch_id={batch_id}"
        work, store = Workspace(spark, "stream-batch"), KeyStore(spark, target, key)
        # Pages are parsed once; what follows reads the narrow rows.
        landed, written = Observation(), Observation()
        why = reason(F.col("status"), F.col("html"))
        counted = batch.observe(
            landed, F.count(F.lit(1)).alias("landed"), F.count(why).alias("refused")
        )
        rows = work.settle(rows_of(counted), "rows")
        new, seen = rows, store.seen(rows, query_id, batch_id)
        if seen is not None:
            new = only_new(rows, seen, key)
        new = new.observe(written, F.count(F.lit(1)).alias("written"))
        new.write.mode("overwrite").parquet(f"{target}/{own}")
        # After the rows: keys without rows would hide them from the batch that runs again.
        store.add(rows, query_id, batch_id)
        refused = refused_inputs(batch, reason, source)
        refused.write.mode("overwrite").parquet(f"{target}/_refused/{own}")
        counts = {**_observed(landed, "landed", "refused"), **_observed(written, "written")}
        schema = ", ".join(f"{c} long" for c in counts)
        frame = spark.createDataFrame([tuple(counts.values())], schema)
        frame.write.mode("overwrite").parquet(f"{target}/_counts/{own}")
        work.close()

    return write


def read_refused(spark: SparkSession, target: str) -> DataFrame:
    """What the streams of a target did not read: source, part, stage, reason, query_id, batch_id."""
    return spark.read.parquet(f"{target}/_refused")


def read_counts(spark: SparkSession, target: str) -> DataFrame:
    """Counters of each batch of the streams of a target: landed, refused, written."""
    return spark.read.parquet(f"{target}/_counts")


def _start(pages: DataFrame, write, checkpoint: str, trigger: dict) -> StreamingQuery:
    return (
        pages.writeStream.foreachBatch(write)
        .option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"availableNow": True}))
        .start()
    )


def batch_reviews(pages: DataFrame) -> DataFrame:
    """First-wins reviews of one batch of landed review pages."""
    good = pages.filter(F.col("status") < FIRST_ERROR_STATUS).select(
        canonicalize_url(F.col("product_url")).alias("product_url"),
        F.col("page_no").cast("int").alias("review_page"),
        "html",
    )
    rows = page_reviews(good).withColumn("product_id", extract_pid(F.col("product_url")))
    firsts = dedupe_reviews(rows).withColumn("scraped_at", iso_utc())
    return firsts.select(*REVIEW_COLUMNS)


def batch_catalog(pages: DataFrame, include_accessories: bool = False) -> DataFrame:
    """First kept product per id of one batch of landed product pages (with ``ordinal``)."""
    good = pages.filter(page_outcome(F.col("status"), F.col("html")) == "parsed")
    rows = products(good.select("request_url", "ordinal", "html"))
    firsts = dedupe_catalog(rows, "ordinal", include_accessories)
    return firsts.withColumn("scraped_at", iso_utc())


def ingest_reviews_stream(
    pages: DataFrame, target: str, checkpoint: str, **trigger
) -> StreamingQuery:
    write = _append_new(batch_reviews, review_page_reason, "product_url", "review_id_hash", target)
    return _start(pages, write, checkpoint, trigger)


def catalog_stream(
    pages: DataFrame, target: str, checkpoint: str, include_accessories: bool = False, **trigger
) -> StreamingQuery:
    def rows(batch: DataFrame) -> DataFrame:
        return batch_catalog(batch, include_accessories)

    write = _append_new(rows, product_page_reason, "request_url", "product_id", target)
    return _start(pages, write, checkpoint, trigger)
