"""Keys that earlier runs wrote: review hashes (JSONL) and product ids (CSV)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.errors import AnalysisException

from sitefold.functions.text import normalize_space


def _empty(spark: SparkSession, column: str) -> DataFrame:
    return spark.createDataFrame([], T.StructType([T.StructField(column, T.StringType())]))


def _missing(error: AnalysisException) -> bool:
    return error.getCondition() == "PATH_NOT_FOUND"


def read_seen_hashes(spark: SparkSession, path: str) -> DataFrame:
    """Distinct ``review_id_hash`` strings of JSON lines; blank and malformed ones are skipped."""
    try:
        lines = spark.read.text(path)
    except AnalysisException as error:
        if _missing(error):
            return _empty(spark, "review_id_hash")
        raise
    value = F.try_variant_get(F.try_parse_json("value"), "$.review_id_hash", "variant")
    kinds = lines.select(
        F.schema_of_variant(value).alias("kind"), value.try_cast("string").alias("review_id_hash")
    )
    return (
        kinds.filter("kind = 'STRING' AND review_id_hash <> ''").select("review_id_hash").distinct()
    )


def read_seen_hashes_csv(spark: SparkSession, path: str) -> DataFrame:
    """Distinct non-blank ``review_id_hash`` of CSV files; none when there is no file."""
    return _csv_keys(spark, path, "review_id_hash")


def read_seen_ids(spark: SparkSession, path: str) -> DataFrame:
    """Distinct non-blank ``product_id`` of catalog files; none when there is no file."""
    return _csv_keys(spark, path, "product_id")


def _csv_keys(spark: SparkSession, path: str, column: str) -> DataFrame:
    try:
        table = spark.read.csv(path, header=True, multiLine=True, escape='"')
    except AnalysisException as error:
        if _missing(error):
            return _empty(spark, column)
        raise
    if column not in table.columns:
        return _empty(spark, column)
    keys = table.select(normalize_space(F.col(column)).alias(column))
    return keys.filter(F.col(column) != "").distinct()
